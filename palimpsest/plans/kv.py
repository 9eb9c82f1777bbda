"""Batches of key-value requests over a version log, as tables: ordinal, op, key, value, start, end, max_keys.

A batch runs in order at one timestamp and stops at its first error; what came before keeps its effect. Reads and
writes do not mix. All requests are answered by joins, not one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import conflicts, versions

READS, WRITES = ("get", "scan"), ("put", "delete")


class MixedBatch(ValueError):
    pass


def check(requests: DataFrame) -> str:
    """``read``, ``write`` or ``empty``; reads and writes together, or an unknown op, are an error."""
    ops = {r["op"] for r in requests.select("op").distinct().collect()}  # as many as there are kinds of request
    if unknown := ops - {*READS, *WRITES}:
        raise ValueError(f"unknown requests: {sorted(map(str, unknown))}")
    if ops & set(READS) and ops & set(WRITES):
        raise MixedBatch("one batch holds either reads (get, scan) or writes (put, delete)")
    return "empty" if not ops else "read" if ops & set(READS) else "write"


#: Ranges of scans that are broadcast at once; more are answered in as many blocks as that takes.
RANGES = 10_000


def _asked(log: DataFrame, gets: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parts of the log that gets and scans can see, so that no other key's versions are merged.

    Requested keys are a semi-join, which Spark broadcasts only if their size allows; the scans' outer bounds are
    one row and reach the files.
    """
    own = gets.select(F.col("asked").alias("_asked")).distinct()
    bounds = scans.agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n"), F.count("start").alias("n_lo"), F.count("end").alias("n_hi")).first()
    part = log if bounds["n"] else log.limit(0)
    part = part.filter(F.col("key") >= F.lit(bounds["lo"])) if bounds["n"] and bounds["n_lo"] == bounds["n"] else part
    part = part.filter(F.col("key") < F.lit(bounds["hi"])) if bounds["n"] and bounds["n_hi"] == bounds["n"] else part
    return log.join(own, F.col("key") == F.col("_asked"), "left_semi"), part


def read(log: DataFrame, requests: DataFrame, ts: versions.Stamp, own: object | None = None) -> DataFrame:
    """ordinal, key, value, found: a row for each get (found or not) and for each key that a scan finds."""
    gets = requests.filter("op = 'get'").select("ordinal", F.col("key").alias("asked"))
    scans = requests.filter("op = 'scan'").select("ordinal", "start", "end", "max_keys")
    of_gets, of_scans = (versions.as_of(part, ["key"], ts, own).select("key", "value") for part in _asked(log, gets, scans))
    got = gets.join(of_gets, F.col("asked") == F.col("key"), "left").select("ordinal", F.col("asked").alias("key"), "value", F.col("key").isNotNull().alias("found"))
    inside = (F.coalesce(F.col("key") >= F.col("start"), F.lit(True))) & (F.coalesce(F.col("key") < F.col("end"), F.lit(True)))
    blocks = max(1, -(-scans.count() // RANGES))
    rows = None
    for k in range(blocks):
        block = scans.filter(F.pmod(F.xxhash64("ordinal"), F.lit(blocks)) == k) if blocks > 1 else scans
        each = of_scans.join(F.broadcast(block), inside)  # about RANGES rows: their number was counted
        rows = each if rows is None else rows.unionAll(each)
    place = F.row_number().over(Window.partitionBy("ordinal").orderBy("key"))
    rows = rows.withColumn("_n", place)
    rows = rows.filter((F.coalesce("max_keys", F.lit(0)) <= 0) | (F.col("_n") <= F.col("max_keys")))
    return got.unionAll(rows.select("ordinal", "key", "value", F.lit(True).alias("found")))


def write(log: DataFrame, requests: DataFrame, ts: versions.Stamp, txn: object | None = None) -> tuple[DataFrame, DataFrame]:
    """The versions to append, and the batch's answer: ordinal, outcome of every request up to the first error.

    A key that the batch has written before is too old at the second time, as both have one timestamp.
    """
    asked = requests.select("ordinal", "op", "key", "value", F.lit(ts[0]).cast("long").alias("wall"), F.lit(ts[1]).cast("int").alias("logical"), F.lit(txn).cast("long").alias("txn_id"))
    judged = conflicts.classify_writes(asked, log, ["key"])
    again = F.row_number().over(Window.partitionBy("key").orderBy("ordinal")) > 1
    judged = judged.withColumn("outcome", F.when((F.col("outcome") == "ok") & again & F.lit(txn is None), "write_too_old").otherwise(F.col("outcome")))
    first = judged.filter("outcome <> 'ok'").agg(F.min("ordinal").alias("_stop"))
    upto = judged.join(F.broadcast(first), F.col("_stop").isNull() | (F.col("ordinal") <= F.col("_stop")))  # one row
    done = upto.filter("outcome = 'ok'")
    last = Window.partitionBy("key").orderBy(F.desc("ordinal"))
    done = done.withColumn("_k", F.row_number().over(last)).filter("_k = 1")  # a transaction has one intent for a key
    rows = done.select("key", "wall", "logical", (F.col("op") == "delete").alias("tombstone"), F.when(F.col("op") == "put", F.col("value")).alias("value"), "txn_id")
    return rows, upto.select("ordinal", "outcome")
