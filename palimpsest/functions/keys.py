"""Byte encodings of row keys and version keys, as column expressions. Binary columns order by unsigned bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * width, "0"))


def table_prefix(table: str) -> bytes:
    return f"/{table}/".encode()


def row_key(table: str, key: Column, of_text: bool = False) -> Column:
    """``/table/`` and the key: eight big-endian bytes of a whole number, or the bytes of a text."""
    body = F.encode(key, "UTF-8") if of_text else _bytes(key.cast("long"), 8)
    return F.concat(F.lit(bytearray(table_prefix(table))), body)


def row_key_value(table: str, encoded: Column, of_text: bool = False) -> Column:
    """The key that row_key() encoded; null if the bytes belong to another table or are no whole number."""
    prefix = bytearray(table_prefix(table))
    body = F.substring(encoded, len(prefix) + 1, 2**30)
    mine = F.substring(encoded, 1, len(prefix)) == F.lit(prefix)
    if of_text:
        return F.when(mine, F.decode(body, "UTF-8"))
    digits = F.hex(body)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    signed = F.when(high >= 2**31, high - 2**32).otherwise(high)
    return F.when(mine & (F.length(body) == 8), signed * F.lit(2**32) + low)


def table_range(table: str) -> tuple[bytes, bytes]:
    """First key and end of a table's range. The end itself is the key of -1, which scans by range leave out."""
    return table_prefix(table), table_prefix(table) + b"\xff" * 8


def version_key(raw: Column, wall: Column, logical: Column) -> Column:
    """The raw key, a zero byte and the complemented timestamp, so that newer versions of a key sort first."""
    return F.concat(raw, F.lit(bytearray(1)), _bytes(F.bitwise_not(wall.cast("long")), 8), F.unhex(F.substring(F.lpad(F.hex(F.bitwise_not(logical.cast("int")).cast("long")), 16, "0"), 9, 8)))


def version_parts(encoded: Column) -> Column:
    """struct<raw, wall, logical> of a version key; a key without a version has null timestamps and no zero byte."""
    n = F.length(encoded)
    versioned = (n >= 13) & (F.substring(encoded, n - 12, F.lit(1)) == F.lit(bytearray(1)))
    digits = F.hex(F.substring(encoded, n - 11, F.lit(12)))

    def part(at: int) -> Column:
        return F.conv(F.substring(digits, at, 8), 16, 10).cast("long")

    high = F.when(part(1) >= 2**31, part(1) - 2**32).otherwise(part(1))
    wall = F.bitwise_not(high * F.lit(2**32) + part(9))
    logical = (F.lit(2**32 - 1) - part(17)).cast("int")
    raw = F.when(versioned, F.substring(encoded, F.lit(1), n - 13)).otherwise(F.substring(encoded, F.lit(1), n - 1))
    return F.struct(raw.alias("raw"), F.when(versioned, wall).alias("wall"), F.when(versioned, logical).alias("logical"))


def successor(key: Column) -> Column:
    """The least key after ``key``."""
    return F.concat(key, F.lit(bytearray(1)))


def checksum(data: Column) -> Column:
    return F.crc32(data)
