"""Proportional stratified interleaving: every shard gets the mixture of sources that the whole table has.

Rows of a source are shuffled by a seeded hash and ranked; row r of n gets the fractional rank (r + u) / n, where u is a
number of the source's own in [0, 1), so that sources of one row do not all fall in the middle. Sorting all rows by that
fraction interleaves the sources in proportion, and equal cuts of the sorted table are the shards.
Both ranks are found by ranges: rows are dealt into ranges of their sort value, each range is ranked by itself, and the
counts of the ranges before it are added. The first goes by even ranges of the hash within each source, the second by
sampled ranges of the whole order, so neither one large source nor very many tiny ones end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered


def _ranges(n: int, rows_per_range: int) -> int:
    return max(1, min(65536, -(-n // rows_per_range)))


def _global_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], total: str, name: str) -> DataFrame:
    """Add the rank of each row (from 0) within its group and the group's size, by ranges of the sort value."""
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias(total))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1
    return df.withColumn("_r", rank).join(counts, [*group, "_b"]).withColumn(name, F.col("_r") + F.col("_before")).drop("_b", "_r", "_before", "_n")


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, rows_per_range: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot for every row; shard sizes differ by one row at most.

    Null or missing sources are one stratum of their own; null text has size 8 and the crc of the empty text; repeated
    rows each get their own slot, and ties in the shuffle go by doc_id, size and checksum. Only keys and sizes are
    shuffled, never texts; other columns are not read. An empty table gives no rows; with fewer rows than shards, some
    shards stay empty. The shuffle goes by the md5 of seed, doc_id, size and checksum.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary")))
    n = docs.count()
    b = _ranges(n, rows_per_range)
    in_unit = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("double") / 2.0**32  # noqa: E731  # in [0, 1), evenly
    own = in_unit(F.md5(F.concat_ws("|", F.lit(str(seed)), "source").cast("binary")))
    ties = ["h", "doc_id", "size", "text_crc32"]
    ranked = _global_rank(rows, ["source"], F.floor(in_unit(F.col("h")) * b), ties, "_of", "_rank")
    ranked = ranked.select("doc_id", "size", "text_crc32", "source", "h", ((F.col("_rank") + own) / F.col("_of")).alias("f"))
    placed = numbered(ranked, ["f", "source", *ties]).withColumn("shard", F.expr(f"int(pos * {shards} div {max(n, 1)})"))
    start = F.expr(f"(shard * {n}L + {shards} - 1) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("pos") - start).alias("slot"))
