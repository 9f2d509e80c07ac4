"""Streams of observations (px, ts, value): windows, running reductions, states, and files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def observations(spark: SparkSession, path: str, schema: str, key: str, ts: str, value: str, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as they arrive."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.select(F.col(key).cast("long").alias("px"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))


def fixed_periods(obs: DataFrame, step: str, late: str) -> DataFrame:
    """Mean, extremes and number by key and period; dates later than `late` behind the newest are dropped by the watermark."""
    return obs.withWatermark("ts", late).groupBy("px", F.window("ts", step)).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")).select("px", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "min", "max", "n")


def sliding_windows(obs: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    return obs.withWatermark("ts", late).groupBy("px", F.window("ts", length, slide)).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).select("px", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "n")


def runs(obs: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of dates that are never further apart than `gap`."""
    return obs.withWatermark("ts", late).groupBy("px", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("value").alias("max")).select("px", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "max")


def running_reduction(obs: DataFrame) -> DataFrame:
    """The reduction so far, for output modes update and complete."""
    return obs.groupBy("px").agg(F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


def joined_streams(left: DataFrame, right: DataFrame, within: str, late: str) -> DataFrame:
    """Pairs of dates of one key that are at most `within` apart, between two streams."""
    a = left.withWatermark("ts", late).select("px", "ts", "value")
    b = right.withWatermark("ts", late).select(F.col("px").alias("other_px"), F.col("ts").alias("other_ts"), F.col("value").alias("other"))
    near = F.expr(f"px = other_px and other_ts >= ts - interval {within} and other_ts <= ts + interval {within}")
    return a.join(b, near).select("px", "ts", "value", "other_ts", "other")


class Persistence(StatefulProcessor):
    """Whether a key's last k values are all above a limit: a count for each key is all the state there is."""

    def __init__(self, limit: float, k: int):
        self.limit, self.k = limit, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for t, v in zip(frame["ts"], frame["value"], strict=True):
            if pd.notna(v):
                n = n + 1 if v > self.limit else 0
            out.append((key[0], t, int(n), n >= self.k))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["px", "ts", "run", "persists"])

    def close(self) -> None:
        pass


def persistence(obs: DataFrame, limit: float, k: int) -> DataFrame:
    """Monitoring of each key in near real time; needs the RocksDB state store."""
    return obs.groupBy("px").transformWithStateInPandas(Persistence(limit, k), "px long, ts timestamp, run long, persists boolean", "Append", "None")


def ewma_state(obs: DataFrame, weight: float, limit: float) -> DataFrame:
    """Exponentially weighted mean of each key, and an alarm when a value leaves it by more than `limit`."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (0.0, 0)
        out = []
        for frame in frames:
            for t, v in frame.sort_values("ts", kind="stable")[["ts", "value"]].itertuples(index=False):
                if pd.isna(v):
                    continue
                alarm = n >= 3 and abs(v - mean) > limit
                mean, n = (v if n == 0 else (1 - weight) * mean + weight * v), n + 1
                out.append((key[0], t, float(mean), bool(alarm)))
        state.update((float(mean), int(n)))
        yield pd.DataFrame(out, columns=["px", "ts", "mean", "alarm"])

    return obs.groupBy("px").applyInPandasWithState(step, "px long, ts timestamp, mean double, alarm boolean", "mean double, n long", "append", "NoTimeout")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """What has arrived so far, once: for jobs that are started again and go on where they were."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode results by batch: `newest` reads the table that holds the last row of each key.  A batch that is run again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row of the last batch for each key of what `logged` wrote."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v")).select(*keys, "v.*")
