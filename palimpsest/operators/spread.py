"""Mergeable cluster state: last infos, liveness, high-water marks, clocks and quorums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hlc
from .versions import pick


def latest_infos(infos: DataFrame, arrival: Column | str = "arrival") -> DataFrame:
    """Of each key the info with the highest stamp; of equal stamps the first to arrive stays."""
    first = F.col(arrival) if isinstance(arrival, str) else arrival
    return pick(infos, ["key"], F.struct("stamp", -first))


def unexpired(infos: DataFrame, now: int) -> DataFrame:
    """Infos whose time to live has not run out; 0 is for ever."""
    return infos.filter((F.col("ttl") == 0) | (F.lit(now) <= F.col("created") + F.col("ttl")))


def high_water(infos: DataFrame) -> DataFrame:
    """Highest stamp of each origin node."""
    return infos.groupBy("node").agg(F.max("stamp").alias("stamp"))


def delta(infos: DataFrame, peer: DataFrame) -> DataFrame:
    """Infos that a peer with the high-water marks ``peer`` (node, stamp) has not seen."""
    known = peer.select(F.col("node").alias("_node"), F.col("stamp").alias("_stamp"))
    out = infos.join(known, F.col("node") == F.col("_node"), "left").filter(F.col("stamp") > F.coalesce(F.col("_stamp"), F.lit(0)))
    return out.select(*infos.columns)


def liveness(records: DataFrame, now: int) -> DataFrame:
    """Of each node the record with the highest epoch, then the latest expiration, and whether it is live at ``now``."""
    top = records.groupBy("node").agg(F.max(F.struct("epoch", "expiration")).alias("_top"))
    return top.select("node", F.col("_top.epoch").alias("epoch"), F.col("_top.expiration").alias("expiration"), (F.lit(now) < F.col("_top.expiration")).alias("live"))


def quorum_index(matches: DataFrame, group: str) -> DataFrame:
    """Of each group the highest index that a majority of its members has reached, and the lowest of any.

    A group's members are few (replicas of one range), so their indexes are one short array.
    """
    out = matches.groupBy(group).agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("_all"), F.min("match_index").alias("slowest"))
    return out.select(group, F.expr("element_at(_all, cast(size(_all) div 2 + 1 AS int))").alias("commit_index"), "slowest")


def peer_offsets(heartbeats: DataFrame, most: int) -> DataFrame:
    """Of each peer the clock offset of its last heartbeat (seq, sent, server, rtt), their number, and whether it is healthy."""
    offset = hlc.clock_offset(F.col("server"), F.col("sent"), F.col("rtt"))
    out = heartbeats.groupBy("peer").agg(F.max_by(offset, "seq").alias("clock_offset"), F.count("*").alias("heartbeats"))
    return out.withColumn("healthy", hlc.is_healthy(F.col("clock_offset"), most))


def clock_series(readings: DataFrame, wall: str, order: Column | str, group: str) -> DataFrame:
    """The clock's timestamps for each group's wall readings in ``order``: hlc_wall and hlc_logical.

    A reading that is not past the highest so far keeps that wall time and counts up.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = readings.withColumn("hlc_wall", F.max(wall).over(so_far))
    return out.withColumn("hlc_logical", F.row_number().over(Window.partitionBy(group, "hlc_wall").orderBy(order)).cast("long") - 1)
