"""Incremental ingest, resumable queues, and event-time windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .links import STORE


def ingest(spark: SparkSession, path: str, schema: str, write: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 4000) -> StreamingQuery:
    """Read new JSON files in bounded batches and hand each to `write(batch, batch_id)`.

    A batch is repeated with the same id after a failure, so `write` has to be idempotent, as upserts are.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FirstSeen(StatefulProcessor):
    """The first row of each id, once for all batches; ids of the initial state are taken as seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.seen.exists()
        for b in rows:
            if new and len(b):
                self.seen.update((True,))
                yield b.head(1)
                new = False

    def close(self) -> None:
        pass


def append_new(spark: SparkSession, queue: str, schema: str, done: str, compute: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int = 4000) -> StreamingQuery:
    """Compute rows of a queue whose id is not in the table at `done` yet, and append them there; rows without an id are left out.

    What is done is a keyed state of the stream: a batch looks up its own ids only, however large the table is. A new
    checkpoint takes the ids of the table once, as its initial state. Each batch is a folder of its own, which a batch
    that is repeated after a failure replaces.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = spark.read.parquet(done).select("id").distinct().groupBy("id") if _exists(spark, done) else None
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(queue).where("id is not null")
    fresh = rows.groupBy("id").transformWithStateInPandas(FirstSeen(), rows.schema, "Append", "None", known)
    run = f"run={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"
    write = lambda batch, n: compute(batch).write.mode("overwrite").parquet(f"{done}/{run}/batch={n}")
    return fresh.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; as a stream, rows later than the watermark are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
