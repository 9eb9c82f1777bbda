"""Provisional versions (rows with txn_id): resolving, pushing and describing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hlc


def resolve(log: DataFrame, txns: DataFrame) -> DataFrame:
    """The log after finished transactions' intents are resolved.

    ``txns``: txn_id, status, write_wall, write_logical. A committed one's intents become plain versions at its write
    time; an aborted or unknown one's vanish, so that the version before shows again; a pending one's stay.
    """
    named = txns.select(F.col("txn_id").alias("_t"), F.col("status").alias("_status"), F.col("write_wall").alias("_wall"), F.col("write_logical").alias("_logical"))
    plain = log.filter(F.col("txn_id").isNull())
    held = log.filter(F.col("txn_id").isNotNull()).join(named, F.col("txn_id") == F.col("_t"), "left").filter(F.col("_status").isin("COMMITTED", "PENDING"))
    done = F.col("_status") == "COMMITTED"
    moved = {"wall": F.when(done, F.col("_wall")).otherwise(F.col("wall")), "logical": F.when(done, F.col("_logical")).otherwise(F.col("logical")), "txn_id": F.when(~done, F.col("txn_id"))}
    return plain.unionByName(held.select(*(moved.get(c, F.col(c)).alias(c) for c in log.columns)))


def push(log: DataFrame, pushes: DataFrame) -> DataFrame:
    """Moves intents forward, never back: ``pushes`` has txn_id, to_wall and to_logical. Others stay as they are."""
    top = pushes.groupBy(F.col("txn_id").alias("_t")).agg(F.max(hlc.hlc(F.col("to_wall"), F.col("to_logical"))).alias("_to"))
    out = log.join(top, F.col("txn_id") == F.col("_t"), "left")
    to = F.when(F.col("_to").isNotNull(), F.greatest(hlc.hlc(F.col("wall"), F.col("logical")), F.col("_to"))).otherwise(hlc.hlc(F.col("wall"), F.col("logical")))
    moved = {"wall": F.col("_new.wall"), "logical": F.col("_new.logical")}
    return out.withColumn("_new", to).select(*(moved.get(c, F.col(c)).alias(c) for c in log.columns))
