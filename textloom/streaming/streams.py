"""Structured Streaming forms: event-time windows, sessions, online class counts, step alarms kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums per window; with ``late`` a watermark bounds the state of a stream."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, size: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.window("ts", size, step), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "total")


def first_alarms(steps: DataFrame, tau: float) -> DataFrame:
    """(episode_id, alarm_step, n_steps) as a stream of updates: state is two numbers an episode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        alarm, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            n += len(pdf)
            hit = pdf.loc[pdf["score"] >= tau, "step"]
            if len(hit):
                alarm = int(hit.min()) if alarm is None else min(alarm, int(hit.min()))
        state.update((alarm, n))
        yield pd.DataFrame({"episode_id": [key[0]], "alarm_step": pd.array([alarm], dtype="Int64"), "n_steps": [n]})

    kind = dict(steps.dtypes)["episode_id"]
    return steps.groupBy("episode_id").applyInPandasWithState(step, f"episode_id {kind}, alarm_step long, n_steps long", "alarm_step long, n_steps long", "update", "NoTimeout")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a bounded stream to its end into a table in memory: for tests and backfills of small results."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A ledger that a replayed batch can't repeat: each micro-batch appends only keys it lacks."""
    from ..sources.writers import append_new

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, path, key, batch.sparkSession)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
