"""Reads over a version log: a row is one version of a key, with wall, logical, tombstone and, if provisional, txn_id.

All functions take and return DataFrames and run no job. The newest version of a key is an aggregate (max_by over the
timestamp), which Spark combines before the shuffle: a key with very many versions sends one row from each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stamp = tuple[int, int]


def stamp() -> Column:
    return F.struct("wall", "logical")


def at_most(ts: Stamp) -> Column:
    """wall and logical up to ``ts``, as comparisons that reach the scan."""
    wall, logical = ts
    return (F.col("wall") < wall) | ((F.col("wall") == wall) & (F.col("logical") <= logical))


def pick(df: DataFrame, keys: Sequence[str], order: Column, last: bool = True) -> DataFrame:
    """Of each key the row that is last (or first) by ``order``, with the columns of ``df``.

    Every column is an aggregate of its own, so columns that nobody reads are not read from the files. Give an order
    that is unique within a key.
    """
    best = F.max_by if last else F.min_by
    found = df.groupBy(*keys).agg(*(best(F.col(f"`{c}`"), order).alias(c) for c in df.columns if c not in keys))
    return found.select(*(found[f"`{c}`"] for c in df.columns))


def newest(log: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """The last row of each key by ``order`` (the timestamp unless given), with the columns of ``log``."""
    return pick(log, keys, stamp() if order is None else order)


def committed(log: DataFrame, own: object | None = None) -> DataFrame:
    """Versions without a transaction, and those of the reader's own one."""
    if "txn_id" not in log.columns:
        return log
    free = F.col("txn_id").isNull()
    return log.filter(free if own is None else free | (F.col("txn_id") == F.lit(own)))


def as_of(log: DataFrame, keys: Sequence[str], ts: Stamp, own: object | None = None, tombstones: bool = False) -> DataFrame:
    """The state at ``ts``: of each key the newest version up to then, deleted keys left out.

    Intents of others are not read; blocked() names the keys where they stand. Inline values are no versions.
    """
    seen = newest(committed(log, own).filter(at_most(ts) & ~((F.col("wall") == 0) & (F.col("logical") == 0))), keys)
    return seen if tombstones else seen.filter(~F.col("tombstone"))


def latest(log: DataFrame, keys: Sequence[str], tombstones: bool = False) -> DataFrame:
    seen = newest(committed(log), keys)
    return seen if tombstones else seen.filter(~F.col("tombstone"))


def get(log: DataFrame, keys: Sequence[str], key: Sequence[object], ts: Stamp, own: object | None = None) -> DataFrame:
    """One key's version at ``ts``, or no row. At (0, 0) the inline value."""
    mine = log.filter(" AND ".join(f"`{k}` = {{}}" for k in keys).format(*(_literal(v) for v in key)))
    return inline(mine, keys) if tuple(ts) == (0, 0) else as_of(mine, keys, ts, own)


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bytes | bytearray):
        return f"X'{bytes(value).hex()}'"
    return str(value)


def inline(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unversioned values: those at timestamp zero, the last one written of each key (column ``seq``, if there is one)."""
    rows = log.filter((F.col("wall") == 0) & (F.col("logical") == 0))
    return newest(rows, keys, F.col("seq")) if "seq" in log.columns else rows


def scan(log: DataFrame, key: str, ts: Stamp, start: object = None, end: object = None, max_keys: int = 0, own: object | None = None) -> DataFrame:
    """Live rows of keys in [start, end) at ``ts``, in key order; None is unbounded, max_keys <= 0 no limit.

    The range reaches the scan; a limit becomes a top-n, so nothing is sorted whole.
    """
    part = log if start is None else log.filter(F.col(key) >= F.lit(start))
    part = part if end is None else part.filter(F.col(key) < F.lit(end))
    rows = as_of(part, [key], ts, own).orderBy(key)
    return rows.limit(max_keys) if max_keys > 0 else rows


def scan_back(log: DataFrame, key: str, ts: Stamp, start: object = None, end: object = None) -> DataFrame:
    """scan() from the last key to the first."""
    return scan(log, key, ts, start, end).orderBy(F.desc(key))


def as_of_each(log: DataFrame, keys: Sequence[str], times: Sequence[Stamp]) -> DataFrame:
    """The states at several times (a short list), with the columns at_wall and at_logical."""
    each = F.explode(F.array(*(F.struct(F.lit(w).cast("long").alias("wall"), F.lit(n).cast("int").alias("logical")) for w, n in times)))
    rows = committed(log).withColumn("_at", each).filter(stamp() <= F.struct("_at.wall", "_at.logical"))
    rows = rows.select(F.col("_at.wall").alias("at_wall"), F.col("_at.logical").alias("at_logical"), *log.columns)
    return newest(rows, ["at_wall", "at_logical", *keys]).filter(~F.col("tombstone"))


def metadata(log: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """Per key: newest timestamp, whether that version is a deletion, its size, and the number of versions."""
    out = log.groupBy(*keys).agg(F.max(stamp()).alias("_ts"), F.max_by("tombstone", stamp()).alias("deleted"), F.max_by(size, stamp()).alias("value_bytes"), F.count("*").alias("versions"))
    return out.select(*keys, F.col("_ts.wall").alias("wall"), F.col("_ts.logical").alias("logical"), "deleted", "value_bytes", "versions")


def _newest_first(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.desc("wall"), F.desc("logical"))


def history(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All versions with version_rank (1 is the newest) and the timestamp of the version before."""
    w = _newest_first(keys)
    return log.select("*", F.row_number().over(w).cast("long").alias("version_rank"), F.lead("wall").over(w).alias("prev_wall"), F.lead("logical").over(w).alias("prev_logical"))


def _gc_marked(log: DataFrame, keys: Sequence[str], threshold: Stamp, keep_visible: bool) -> DataFrame:
    """Marks rows to keep. Per-key maxima are aggregated and joined, so a key with many versions is not one task's work."""
    old = at_most(threshold)
    tops = log.groupBy(*keys).agg(F.max(stamp()).alias("_top"), F.max_by("tombstone", stamp()).alias("_top_dead"), F.max(F.when(old, stamp())).alias("_top_old"))
    tops = tops.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_top", "_top_dead", "_top_old")
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = log.join(tops, match).drop(*(f"_k_{k}" for k in keys))
    gone = F.col("_top_dead") & F.coalesce(F.col("_top") == F.col("_top_old"), F.lit(False))
    keep = ~gone & (~old | (stamp() == F.col("_top")) | (F.lit(keep_visible) & F.coalesce(stamp() == F.col("_top_old"), F.lit(False))))
    return joined.withColumn("_keep", keep).drop("_top", "_top_dead", "_top_old")


def gc_retained(log: DataFrame, keys: Sequence[str], threshold: Stamp, keep_visible: bool = False) -> DataFrame:
    """Versions that collection at ``threshold`` keeps.

    A key whose newest version is a deletion up to the threshold goes whole; else its newest version stays and every
    other one up to the threshold goes. Reads between the threshold and the oldest kept version then find nothing;
    with ``keep_visible`` the newest version up to the threshold stays too, and reads from the threshold on are as before.
    """
    return _gc_marked(log, keys, threshold, keep_visible).filter("_keep").drop("_keep")


def gc_dropped(log: DataFrame, keys: Sequence[str], threshold: Stamp, keep_visible: bool = False) -> DataFrame:
    return _gc_marked(log, keys, threshold, keep_visible).filter("NOT _keep").drop("_keep")


def upsert(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with new versions appended: writing is appending, the newest version wins when read."""
    return log.unionByName(rows, allowMissingColumns=True)


def deletions(state: DataFrame, ts: Stamp) -> DataFrame:
    """Tombstones at ``ts`` for the rows of ``state``, to be appended to their log."""
    return state.withColumn("wall", F.lit(ts[0]).cast("long")).withColumn("logical", F.lit(ts[1]).cast("int")).withColumn("tombstone", F.lit(True))
