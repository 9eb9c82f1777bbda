"""Conflict rules over DataFrames: what happens to proposed writes, reads and commits.

Proposals have a key, wall, logical and txn_id (null: not in a transaction). Logs are aggregated to a row for each key
before they are joined, so a proposal meets one row however many versions its key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hlc
from .versions import Stamp, at_most, stamp


def _keyed(df: DataFrame, keys: Sequence[str], *values: Column) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *values)


def _left(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left").drop(*(f"_k_{k}" for k in keys))


def newest_stamps(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _keyed(log.groupBy(*keys).agg(F.max(stamp()).alias("_newest")), keys, F.col("_newest"))


def open_intents(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The provisional version of each key that has one (a key has one at most)."""
    mine = log.filter(F.col("txn_id").isNotNull())
    return _keyed(mine.groupBy(*keys).agg(F.max_by("txn_id", stamp()).alias("_holder"), F.max(stamp()).alias("_intent")), keys, F.col("_holder"), F.col("_intent"))


def classify_writes(proposals: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds outcome, and existing_wall / existing_logical of the version in the way.

    write_intent: another transaction (or any, for a write outside one) holds a provisional version, whatever the
    times. write_too_old: no provisional version, and the newest version, deletions included, is at or after the
    write. ok: neither.
    """
    out = _left(_left(proposals, newest_stamps(log, keys), keys), open_intents(log, keys), keys)
    held = F.col("_holder").isNotNull()
    foreign = held & ~F.col("_holder").eqNullSafe(F.col("txn_id"))
    old = ~held & (F.struct("wall", "logical") <= F.col("_newest"))
    outcome = F.when(foreign, "write_intent").when(F.coalesce(old, F.lit(False)), "write_too_old").otherwise("ok")
    way = F.when(F.col("outcome") == "write_intent", F.col("_intent")).when(F.col("outcome") == "write_too_old", F.col("_newest"))
    out = out.withColumn("outcome", outcome).withColumn("_way", way)
    return out.select(*proposals.columns, "outcome", F.col("_way.wall").alias("existing_wall"), F.col("_way.logical").alias("existing_logical"))


def uncertain(log: DataFrame, keys: Sequence[str], read: Stamp, most: Stamp, own: object | None = None) -> DataFrame:
    """Keys whose newest version lies in (read, most] and is not the reader's own: a read there must restart.

    Only the newest version counts: with one beyond ``most``, an older one inside the window is not uncertain.
    """
    top = log.groupBy(*keys).agg(F.max(stamp()).alias("_ts"), *([F.max_by("txn_id", stamp()).alias("_txn")] if "txn_id" in log.columns else []))
    inside = (F.col("_ts") > hlc.hlc(*read)) & (F.col("_ts") <= hlc.hlc(*most))
    if own is not None and "txn_id" in log.columns:
        inside &= ~F.col("_txn").eqNullSafe(F.lit(own))
    return top.filter(inside).select(*keys, F.col("_ts.wall").alias("wall"), F.col("_ts.logical").alias("logical"))


def blocked(log: DataFrame, keys: Sequence[str], ts: Stamp, own: object | None = None) -> DataFrame:
    """Keys that a read at ``ts`` may not pass: a provisional version of another transaction up to then."""
    held = log.filter(F.col("txn_id").isNotNull() & at_most(ts))
    held = held if own is None else held.filter(F.col("txn_id") != F.lit(own))
    top = held.groupBy(*keys).agg(F.max_by("txn_id", stamp()).alias("txn_id"), F.max(stamp()).alias("_ts"))
    return top.select(*keys, "txn_id", F.col("_ts.wall").alias("wall"), F.col("_ts.logical").alias("logical"))


class BlockedRead(RuntimeError):
    """A read met another transaction's provisional version."""


def assert_unblocked(log: DataFrame, keys: Sequence[str], ts: Stamp, own: object | None = None) -> None:
    """Raises BlockedRead if a read of ``log`` at ``ts`` meets an intent; runs a job that stops at the first one."""
    if found := blocked(log, keys, ts, own).head(1):
        raise BlockedRead(f"key {[found[0][k] for k in keys]} is held by transaction {found[0]['txn_id']}")


def push_by_reads(proposals: DataFrame, reads: DataFrame, keys: Sequence[str], low_water: Stamp = (0, 0)) -> DataFrame:
    """Moves writes past the last read of their key: adds pushed, and wall / logical as they may be written.

    ``reads``: key, wall, logical and txn_id; a transaction's own reads do not push it. Keys without reads count as
    read at ``low_water``.
    """
    by_txn = reads.groupBy(*keys, "txn_id").agg(F.max(stamp()).alias("_read"))
    one = F.struct(F.col("_read"), F.col("txn_id").alias("_by"))
    # of each key the last read, and the last one by any other transaction
    top = by_txn.groupBy(*keys).agg(F.max(one).alias("_first"))
    other = _left(by_txn, _keyed(top, keys, F.col("_first")), keys).filter(~F.col("txn_id").eqNullSafe(F.col("_first._by"))).groupBy(*keys).agg(F.max("_read").alias("_second"))
    out = _left(_left(proposals, _keyed(top, keys, F.col("_first")), keys), _keyed(other, keys, F.col("_second")), keys)
    own = F.col("txn_id").isNotNull() & (F.col("txn_id") == F.col("_first._by"))
    floor = F.coalesce(F.greatest(F.when(own, F.col("_second")).otherwise(F.col("_first._read")), hlc.hlc(*low_water)), hlc.hlc(*low_water))
    write = hlc.hlc(F.col("wall"), F.col("logical"))
    out = out.withColumn("pushed", write <= floor).withColumn("_to", F.when(write <= floor, hlc.following(floor)).otherwise(write))
    plain = [c for c in proposals.columns if c not in ("wall", "logical")]
    return out.select(*plain, "pushed", F.col("_to.wall").alias("wall"), F.col("_to.logical").alias("logical"))


def read_cache(reads: DataFrame, keys: Sequence[str], size: int) -> tuple[DataFrame, DataFrame]:
    """The ``size`` keys read last, and the low-water mark (one row) that stands for all others."""
    last = reads.groupBy(*keys).agg(F.max(stamp()).alias("_ts")).select(*keys, F.col("_ts.wall").alias("wall"), F.col("_ts.logical").alias("logical"))
    kept = last.orderBy(F.desc("wall"), F.desc("logical"), *keys).limit(size)
    rest = last.join(kept.select(*keys), list(keys), "left_anti").agg(F.coalesce(F.max(stamp()), hlc.hlc(0, 0)).alias("_ts"))
    return kept, rest.select(F.col("_ts.wall").alias("wall"), F.col("_ts.logical").alias("logical"))


def commit_outcome(iso: Column, status: Column, read_ts: Column, write_ts: Column) -> Column:
    """committed, or retry: an aborted transaction, or a serializable one (SSI) whose writes were pushed."""
    return F.when(status == "ABORTED", "retry").when((iso == "SSI") & (read_ts < write_ts), "retry").otherwise("committed")


def write_write(status: Column, priority: Column, blocker_priority: Column) -> Column:
    """What a writer does about an intent in its way, by the holder's status (null: no record).

    clean_abort, clean_commit: finish the intent and go on; abort_blocker: strictly higher priority wins; retry.
    """
    return F.when(status.isNull() | (status == "ABORTED"), "clean_abort").when(status == "COMMITTED", "clean_commit").when(priority > blocker_priority, "abort_blocker").otherwise("retry")


def read_write(status: Column, iso: Column, blocker_read: Column, priority: Column, blocker_priority: Column, read_ts: Column) -> Column:
    """What a reader does about an intent in its way.

    As write_write() for finished holders. A pending one is pushed past the read (push) unless it is serializable and
    the push would pass its own read time; then priority decides.
    """
    fight = F.when(priority > blocker_priority, "abort_blocker").otherwise("retry")
    restarts = (iso == "SSI") & (blocker_read < hlc.following(read_ts))
    return F.when(status.isNull() | (status == "ABORTED"), "clean_abort").when(status == "COMMITTED", "clean_commit").when(restarts, fight).otherwise("push")
