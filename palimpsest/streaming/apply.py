"""Structured Streaming into version logs: batches in order, each applied once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions
from ..sources.store import VersionStore


def apply_batch(store: VersionStore, rows: DataFrame, batch: int) -> bool:
    """Commits a batch unless it, or a later one, has been applied; says whether it did.

    The manifest that publishes the rows carries the batch's number, so a batch repeated after a failure changes nothing.
    """
    seen = store.manifest()
    if batch <= seen["applied"]:
        return False
    store.append(rows, applied=batch, seen=seen)
    return True


def apply_log(stream: DataFrame, store: VersionStore, checkpoint: str, **trigger):
    """Starts a query that appends a stream of versions to a store; offsets and progress are in ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: apply_batch(store, rows, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def apply_log_with_snapshots(stream: DataFrame, store: VersionStore, checkpoint: str, every: int = 8, **trigger):
    """apply_log() that, after each ``every`` batches, merges the levels that have become due and vacuums.

    Only a due level's folders are rewritten, so a version is rewritten once for each level it passes.
    """

    def step(rows: DataFrame, batch: int) -> None:
        if apply_batch(store, rows, batch) and (batch + 1) % every == 0:
            store.compact_due()
            store.vacuum(keep=2)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def on_prefix(stream: DataFrame, callbacks: dict[str, Callable[[DataFrame], None]], checkpoint: str, **trigger):
    """Calls each callback with the batch's rows whose key starts with its prefix."""

    def step(rows: DataFrame, _: int) -> None:
        for prefix, call in callbacks.items():
            call(rows.filter(F.col("key").startswith(prefix)))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_versions(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key so far, as a streaming aggregate (output mode update or complete)."""
    rest = [c for c in stream.columns if c not in keys]
    top = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), versions.stamp()).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.`{c}`").alias(c) for c in rest))
