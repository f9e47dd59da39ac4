"""Stateful jobs on event streams.

Event times are cast to timestamps, which watermarks need. ``run_once`` reads a
folder to its end into a table, for tests and backfills.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryleaf.settings import DEFAULTS
from quarryleaf.sources.shared import shared_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """path may be a folder or one file; a file stream takes a file only as a
    pattern."""
    schema = spark.read.parquet(path).schema
    name = path.rstrip("/")
    one = name.endswith(".parquet")
    # A folder is read as one; a lone file is named by a pattern that only it meets.
    source = f"{name[:-1]}[{name[-1]}]" if one else name
    return spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return tumbling_like(events, F.window("ts", width, step), late)


def tumbling_like(events: DataFrame, window, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def skip_if_seen(events: DataFrame, keys: list[str], ttl: str = "5 minutes") -> DataFrame:
    """One event for each key within the time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def visit_counts(events: DataFrame, key: str = "user_id", threshold: int = DEFAULTS.visit_hint) -> DataFrame:
    """Running visits of each key, and whether to suggest a profile."""
    return events.groupBy(key).agg(F.count("*").alias("visits")).withColumn("suggest", F.col("visits") >= threshold)


def host_ceilings(events: DataFrame, host: str = "user_id", ms: str = "ms") -> DataFrame:
    """The time limit of each host after every batch, from a ring of its last
    samples held as state."""
    keep = DEFAULTS.host_samples

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        # The batch is sorted by time first: frames come in any order.
        batch = pd.concat(list(frames)).sort_values("ts")
        ring = [*ring, *(int(x) for x in batch[ms] if 0 <= x <= DEFAULTS.sane_ms)][-keep:]
        state.update((ring,))
        p95 = float(pd.Series(ring).quantile(0.95)) if ring else 0.0
        limit = DEFAULTS.host_default_ms if len(ring) < DEFAULTS.host_least_samples else min(max(int(p95 * 1.5), DEFAULTS.ceiling_low_ms), DEFAULTS.ceiling_high_ms)
        yield pd.DataFrame({host: [key[0]], "samples": [len(ring)], "ceiling_ms": [limit]})

    kind = dict(events.dtypes)[host]
    return events.groupBy(host).applyInPandasWithState(update, f"{host} {kind}, samples int, ceiling_ms int", "ring array<int>", "update", GroupStateTimeout.NoTimeout)


def telemetry_by_day(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.percentile_approx("value", 0.95).alias("p95"))


def upsert_latest(stream: DataFrame, key: str, at: str, path: str, checkpoint: str):
    """Keep a table of the last row of each key: each batch is merged with what
    the table has and written as its next version (path/v=N)."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v={n - 1}") if n else None
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c != key]
        rows.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*").write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def run_once(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """What a stream gives when its source is read to its end, as a table in the
    shared folder. Append mode goes to a file sink; of the other modes each
    batch replaces the last, which complete mode means."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "stream")
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/state")
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/out")
    else:
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
