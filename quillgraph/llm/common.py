"""Helpers that several operators share: the shared scratch folder, joins that survive hot keys, and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null doc_id inside joins; results carry the null again.
NO_ID = -(2**63)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only where none is named and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-quillgraph-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Tables written inside the innermost passing().
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def _place(table: DataFrame):
    """The file system and path of a table that materialise() wrote."""
    sc = table.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(table._written)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; the table goes with passing() or when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quillgraph-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    files, where = _place(table)
    files.deleteOnExit(where)
    if _made.get() is not None:
        _made.get().append(table)
    return table


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that materialise() writes inside are deleted at the end, but for those put into the list this gives.

    What is read later may only derive from the tables in the list.
    """
    outer, made, keep = _made.get(), [], []
    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        for t in made:
            if not any(t is k for k in keep):
                files, where = _place(t)
                files.delete(where, True)
            elif outer is not None:
                outer.append(t)


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose two sides are both dealt by the join itself, so that adaptive execution can split a hot key.

    The extra key keeps Spark from reusing the partitioning of an aggregate below, which could not be split.
    """
    key = F.xxhash64(*on)
    return left.withColumn("_deal", key).join(right.withColumn("_deal", key), ["_deal", *on], how).drop("_deal")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with column pos, their places in the whole order: ranges are numbered by themselves, then shifted."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id() % F.lit(2**33))
    dealt = materialise(dealt)
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = dealt.groupBy("part").count().select("part", before.alias("start"))  # a row for each partition
    return dealt.join(F.broadcast(heads), "part").withColumn("pos", F.col("start") + F.col("idx")).drop("start", "idx", "part")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and a row key (did, th): rows with one id and other texts stay apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), *more)


def batches_of(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` characters each; a longer text is alone."""
    at = n = 0
    for i, t in enumerate(texts):
        if i > at and n + len(t) > size:
            yield at, i
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)


#: What tasks keep in their worker for the next of their kind.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What tasks of one kind keep in their worker, made once; it goes when a lean task begins there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def trim() -> None:
    """Give freed memory back to the system: workers outlive their stage, and what they hold counts beside the next one's."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if free:
        free(0)


def lean(step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """step over batches, in a worker without what other stages kept there, trimmed before and after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _kept.clear()
        trim()
        yield from step(batches)
        trim()

    return run


def with_null_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with NO_ID as null again. Ids pass through pandas without nulls, which would make them inexact numbers."""
    return df.withColumn(name, F.nullif(name, F.lit(NO_ID)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
