"""Streams over arriving events and sources (an extension): windows, sessions, deduplication, last write wins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.session import shared_dir


def tumbling_counts(events: DataFrame) -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame) -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame) -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"])


def latest_per_key(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Last event by time of every key, kept in state across batches."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        best = state.get if state.exists else None
        for pdf in batches:
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            now = (row["ts"].value, int(row["event_id"]))
            best = now if best is None or now > tuple(best) else best
        state.update(tuple(best))
        yield pd.DataFrame({key: [k[0]], "event_id": [best[1]]})

    return events.groupBy(key).applyInPandasWithState(keep, f"{key} long, event_id long", "at long, event_id long", "update", "NoTimeout")


def run_available(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over the Parquet file or folder at ``path`` until what is there is read; the result as a table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs a zone; texts without one are UTC here
    out = f"{shared_dir(spark)}/landweave/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/data")

    run = transform(source).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    done = spark.read.parquet(f"{out}/data")
    return done.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in done.dtypes])


def ingest_arrivals(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> None:
    """Append files that arrived in ``folder`` to the catalogue folder ``target``, each file once."""
    stream = spark.readStream.schema(schema).json(folder)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
