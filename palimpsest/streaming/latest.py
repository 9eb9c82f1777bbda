"""Keyed state over streams: the last info of each key with a time to live, and nodes' liveness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "stamp long, node long, value string"
_OUT = "key string, stamp long, node long, value string, live boolean"


def _keep_latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        stamp, node, value = state.get
        state.remove()
        yield pd.DataFrame([(key[0], stamp, node, value, False)], columns=["key", "stamp", "node", "value", "live"])
        return
    now = state.get if state.exists else None
    fresh = False
    for frame in frames:
        if len(frame):
            top = frame.iloc[int(frame["stamp"].to_numpy().argmax())]  # the first of equal stamps
            if now is None or top["stamp"] > now[0]:  # an equal stamp keeps what is there
                now, fresh = (int(top["stamp"]), int(top["node"]), top["value"]), True
    if fresh:
        state.update(now)
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], *now, True)], columns=["key", "stamp", "node", "value", "live"])


def latest_infos(stream: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Infos (key, stamp, node, value) that are newer than what their key had, as they come; with ``ttl_ms`` a key that
    gets none for so long is reported once with live = false and forgotten. Output mode update."""

    def step(key, frames, state):
        return _keep_latest(key, frames, state, ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return stream.select("key", "stamp", "node", "value").groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "update", timeout)


def liveness(stream: DataFrame) -> DataFrame:
    """Of each node the record with the highest epoch, then the latest expiration (output mode update or complete)."""
    top = stream.groupBy("node").agg(F.max(F.struct("epoch", "expiration")).alias("_top"))
    return top.select("node", "_top.epoch", "_top.expiration")
