"""Streams of change events: batching, bursts, sessions, incremental tables.

Time is arrival time. A window opens with the first event after the last
flush and holds what arrives within its length; more than the cap of distinct
keys, or more events in the rolling burst window than its cap, make it one full
rebuild.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BATCHES = "scope string, opened double, n_events long, n_keys long, keys string, full_rebuild boolean"


def fold(times: list[float], keys: list[str], length: float, most_keys: int, burst: float, most_burst: int, state: tuple | None = None, flush: bool = True) -> tuple[list[tuple], tuple]:
    """Batches of events in order of time: (opened, events, keys, rebuild), and the state to go on from.

    Caps are strictly-greater tests. The rolling window is not cleared by a
    normal flush, only by a rebuild.
    """
    opened, pending, n, rebuild, recent = state or (None, [], 0, False, [])
    pending, recent, out = set(pending), list(recent), []

    def close() -> None:
        nonlocal opened, pending, n, rebuild, recent
        out.append((opened, n, sorted(pending), rebuild))
        if rebuild:
            recent = []
        opened, pending, n, rebuild = None, set(), 0, False

    for t, k in zip(times, keys, strict=True):
        if opened is not None and t >= opened + length:
            close()
        if opened is None:
            opened = t
        recent = [x for x in recent if t - x <= burst] + [t]
        pending.add(k)
        n += 1
        rebuild = rebuild or len(pending) > most_keys or len(recent) > most_burst
    if flush and opened is not None:
        close()
    return out, (opened, sorted(pending), n, rebuild, recent)


def _rows(scope: str, batches: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(scope, o, n, len(k), "" if r else ",".join(k), r) for o, n, k, r in batches], columns=["scope", "opened", "n_events", "n_keys", "keys", "full_rebuild"])


def batches(events: DataFrame, length: float = 5.0, most_keys: int = 200, burst: float = 2.0, most_burst: int = 1000) -> DataFrame:
    """The batches that the stream would give for a whole table (scope, t, key); scopes are independent."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "key"])
        return _rows(key[0], fold(frame["t"].tolist(), frame["key"].tolist(), length, most_keys, burst, most_burst)[0])

    return events.select("scope", "t", "key").groupBy("scope").applyInPandas(run, BATCHES)


def batch_stream(events: DataFrame, length: float = 5.0, most_keys: int = 200, burst: float = 2.0, most_burst: int = 1000, flush_after_ms: int = 5000) -> DataFrame:
    """The same over a stream of (scope, t, key): open windows are state, flushed by the next event or by a timer."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, pending, n, rebuild, recent = state.get
            state.remove()
            yield _rows(key[0], [(opened, n, list(pending), rebuild)])
            return
        frame = pd.concat(list(frames)).sort_values(["t", "key"])
        found, kept = fold(frame["t"].tolist(), frame["key"].tolist(), length, most_keys, burst, most_burst, tuple(state.get) if state.exists else None, flush=False)
        state.update(kept)
        state.setTimeoutDuration(flush_after_ms)
        yield _rows(key[0], found)

    kind = "opened double, pending array<string>, n long, rebuild boolean, recent array<double>"
    return events.groupBy("scope").applyInPandasWithState(run, BATCHES, kind, "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files at a time: the bound on what is in flight."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def usage(events: DataFrame) -> DataFrame:
    """Counters of each session (session, event_type, value): the streaming aggregate, complete mode."""
    return events.groupBy("session").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.approx_count_distinct("event_type").alias("kinds"))


def apply_serially(stream: DataFrame, step, checkpoint: str):
    """Run step(batch, number) on one micro-batch after the other; a restart goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
