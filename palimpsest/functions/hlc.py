"""Hybrid logical timestamps as struct<wall: bigint, logical: int>, which Spark compares wall first, then logical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LOGICAL = 2**31 - 1
HLC = T.StructType([T.StructField("wall", T.LongType()), T.StructField("logical", T.IntegerType())])


def hlc(wall: Column | int, logical: Column | int = 0) -> Column:
    wall, logical = (x if isinstance(x, Column) else F.lit(x) for x in (wall, logical))
    return F.struct(wall.cast("long").alias("wall"), logical.cast("int").alias("logical"))


def is_empty(ts: Column) -> Column:
    """Whether the timestamp is zero, which marks inline (unversioned) values."""
    return (ts["wall"] == 0) & (ts["logical"] == 0)


def following(ts: Column) -> Column:
    """The least timestamp after ``ts``; the logical part carries into the wall part."""
    full = ts["logical"] == MAX_LOGICAL
    return hlc(F.when(full, ts["wall"] + 1).otherwise(ts["wall"]), F.when(full, 0).otherwise(ts["logical"] + 1))


def preceding(ts: Column) -> Column:
    """The greatest timestamp before ``ts`` (not defined for zero)."""
    low = ts["logical"] == 0
    return hlc(F.when(low, ts["wall"] - 1).otherwise(ts["wall"]), F.when(low, MAX_LOGICAL).otherwise(ts["logical"] - 1))


def to_text(ts: Column) -> Column:
    return F.format_string("%d.%010d", ts["wall"], ts["logical"])


def wall_of(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without zone, whatever the session's time zone."""
    day = f"unix_date(cast({ts} AS date)) * 86400000000000L"
    clock = f"hour({ts}) * 3600000000000L + minute({ts}) * 60000000000L + cast(extract(SECOND FROM {ts}) * 1000000 AS bigint) * 1000L"
    return F.expr(f"{day} + {clock}")


def clock_offset(server_wall: Column, sent_wall: Column, round_trip: Column) -> Column:
    """How far a remote clock is ahead: its reading less the local middle of the round trip (whole nanoseconds)."""
    return server_wall - (sent_wall + F.floor(round_trip / 2))


def is_healthy(offset: Column, most: int) -> Column:
    """Within the bound; an offset that was never measured counts as healthy."""
    return F.coalesce(F.abs(offset) <= most, F.lit(True))
