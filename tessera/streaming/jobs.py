"""Streaming forms: telemetry counters over event time, sliding normalisation with state, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.lineage import fresh_path
from tessera.sources.sinks import upserted


def telemetry(events: DataFrame, window: str = "1 hour", late: str = "2 hours", bounds: tuple[float, ...] = (10.0, 50.0, 100.0)) -> DataFrame:
    """Counts, sums and cumulative value buckets of each window and event type; batch and stream alike. Late events beyond the watermark drop."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), *[F.count_if(F.col("value") <= b).alias(f"le_{b:g}") for b in bounds])
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"), *[f"le_{b:g}" for b in bounds])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(spark: SparkSession, path: str, build, out: str, state: str, mode: str = "append", files_per_trigger: int = 1) -> None:
    """Run a streaming query over the Parquet files of a folder to its end, and write its rows to `out`; `state` is its checkpoint.

    In append mode rows are appended as Parquet; in complete mode each micro-batch replaces the table by the whole result, so that a
    retry changes nothing. Composite state needs the RocksDB store, which the query takes for itself. A query with processing-time
    timers never ends by itself and is started with a trigger of its own instead.
    """
    schema = spark.read.parquet(path).schema
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        writer = writer.format("parquet").option("path", out) if mode == "append" else writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def replay(spark: SparkSession, path: str, build, mode: str = "complete", files_per_trigger: int = 1) -> DataFrame:
    """The rows of a streaming query over the Parquet files of a folder, run to its end and written in the shared folder."""
    out = fresh_path(spark, ".parquet")
    run_to_end(spark, path, build, out, fresh_path(spark), mode, files_per_trigger)
    return spark.read.parquet(out)


def recurrent_activity(frames: DataFrame, share: int = 10, threshold: int = 500) -> DataFrame:
    """(utt, at, level, speech) of frames(utt, at, energy): a level in thousandths that moves by one part in `share` towards each frame's energy.

    Energies count in whole thousandths and steps are rounded down, so that levels are exact. Frames of an utterance must arrive in
    order of `at`; the state is one number for each utterance. `frontend.online_activity` takes chunks of samples in any order.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0
        frames = pd.concat(list(batches)).sort_values("at")
        levels = []
        for e in frames["energy"]:
            level += (int(e) - level) // share
            levels.append(level)
        state.update((level,))
        yield pd.DataFrame({"utt": key[0], "at": frames["at"].to_numpy(), "level": levels, "speech": np.array(levels) >= threshold})

    whole = frames.select("utt", "at", F.floor(F.col("energy") * 1000 + 0.5).cast("long").alias("energy"))
    return whole.groupBy("utt").applyInPandasWithState(step, "utt string, at long, level long, speech boolean", "level long", "append", "NoTimeout")


def window_scores(x: np.ndarray, new: int, window: int) -> np.ndarray:
    """The last `new` rows of x less the mean, over the deviation, of the last `window` rows up to each; 1,024 rows at a time."""
    known, out = len(x) - new, []
    padded = np.concatenate([np.zeros((window - 1, x.shape[1])), x])  # row i of x is the last of the window that begins at i
    for at in range(known, len(x), 1024):
        end = np.arange(at, min(at + 1024, len(x)))
        rows = padded[end[:, None] + np.arange(window)]
        n = np.minimum(end + 1, window)[:, None]
        there = (np.arange(window) >= window - n)[:, :, None]
        mean = rows.sum(axis=1) / n
        variance = (np.where(there, rows - mean[:, None], 0.0) ** 2).sum(axis=1) / n
        out.append((x[end] - mean) / np.sqrt(np.maximum(variance, 1e-10)))
    return np.concatenate(out)


def sliding_normalised(frames: DataFrame, window: int) -> DataFrame:
    """frames(utt, at, values array<double>) less the mean, over the deviation, of the last `window` frames: a stream's state is these frames.

    Frames of an utterance must arrive in order of `at`; deviations are of the population, at least 1e-5.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = [list(v) for v in state.get[0]] if state.exists else []
        batch = pd.concat(list(batches)).sort_values("at")
        new = [list(map(float, v)) for v in batch["values"]]
        out = window_scores(np.array((held[-(window - 1) :] if window > 1 else []) + new, float), len(new), window).tolist()
        state.update(((held + new)[-window:],))
        yield pd.DataFrame({"utt": key[0], "at": batch["at"].to_numpy(), "values": out})

    return frames.groupBy("utt").applyInPandasWithState(step, "utt string, at long, values array<double>", "held array<array<double>>", "append", "NoTimeout")


def upsert_stream(updates: DataFrame, path: str, key: str, version: str):
    """A writer that merges each micro-batch into the table at path. Each batch writes a folder of its own and a retry overwrites it, so the merge is repeatable."""

    def merge(batch: DataFrame, number: int) -> None:
        from tessera.sources.readers import optional_table

        spark = batch.sparkSession
        old = optional_table(spark, f"{path}/{number - 1}.parquet") if number else None
        rows = batch if old is None else upserted(old, batch, key, version)
        upserted(rows.limit(0), rows, key, version).write.mode("overwrite").parquet(f"{path}/{number}.parquet")

    return updates.writeStream.foreachBatch(merge)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last merged micro-batch left it."""
    from tessera.sources.readers import optional_table

    number, found = 0, optional_table(spark, f"{path}/0.parquet")
    while (after := optional_table(spark, f"{path}/{number + 1}.parquet")) is not None:
        number, found = number + 1, after
    if found is None:
        raise ValueError(f"{path}: nothing merged yet")
    return found
