"""Layered sorted data: newest-wins merging, compaction, level thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import pick

#: Files in level 0 that start a compaction, and the growth of that number from level to level.
L0_FILES, GROWTH = 4, 10


def merged(layers: DataFrame, keys: Sequence[str], priority: Column | str, tombstones: bool = False) -> DataFrame:
    """Of each key the row of the least ``priority`` (0 is the newest layer); deletions hide their key or are kept.

    The winner is an aggregate, combined before the shuffle. Ties within a layer go to the first in ``priority``,
    so give one that is unique for a key.
    """
    order = F.col(priority) if isinstance(priority, str) else priority
    out = pick(layers, keys, order, last=False)
    return out if tombstones else out.filter(~F.col("tombstone"))


def stack(*layers: DataFrame) -> DataFrame:
    """Layers from newest to oldest as one table with the column layer."""
    out = layers[0].withColumn("layer", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        out = out.unionByName(layer.withColumn("layer", F.lit(k)))
    return out


def compacted(upper: DataFrame, lower: DataFrame, keys: Sequence[str], bottom: bool) -> DataFrame:
    """Two adjacent levels as one: the upper one's rows win. Deletions are dropped at the bottom level only."""
    return merged(stack(upper, lower), keys, "layer", tombstones=not bottom).drop("layer")


def level_threshold(level: int) -> int:
    """threshold() of one level."""
    return L0_FILES * GROWTH**level


def threshold(level: Column) -> Column:
    """Files at which a level is compacted into the next."""
    return (F.lit(L0_FILES) * F.pow(F.lit(float(GROWTH)), level)).cast("long")


def level_counts(files: DataFrame) -> DataFrame:
    """level, files, threshold and whether the level is due, from a table of files (level, name)."""
    out = files.groupBy("level").agg(F.count("*").alias("files")).withColumn("threshold", threshold(F.col("level")))
    return out.withColumn("due", F.col("files") >= F.col("threshold"))
