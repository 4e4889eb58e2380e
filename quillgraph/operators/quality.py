"""Reports on graphs and vector tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cosine
from ..graph import Graph, numbered
from .references import hubs, in_degrees


def verify_graph(graph: Graph) -> DataFrame:
    """what, n: nodes, edges, dangling edges, empty texts."""
    e, ids = graph.edges, graph.nodes.select("id")
    dangling = e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select("id").unionByName(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id")).distinct()
    row = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return row("nodes", graph.nodes).unionByName(row("edges", e)).unionByName(row("dangling", dangling)).unionByName(row("untitled", graph.nodes.where("coalesce(primary_text, '') = ''")))


def edge_samples(graph: Graph, rel_type: str, most: int = 3) -> DataFrame:
    """id, src, src_text, dst, dst_text of the first edges of a type by id: what a look at the references shows."""
    first = graph.only([rel_type]).edges.orderBy("id").limit(most).select("id", "src", "dst")
    ends = graph.nodes.join(F.broadcast(first.select(F.explode(F.array("src", "dst")).alias("id")).distinct()), "id").select("id", "primary_text")  # 2 * most rows
    named = first.join(ends.toDF("src", "src_text"), "src", "left").join(ends.toDF("dst", "dst_text"), "dst", "left")
    return named.select("id", "src", "src_text", "dst", "dst_text")


def audit_references(graph: Graph, rel_type: str, over: int = 200) -> DataFrame:
    """targets, edges, mean in-degree, hubs and the share of edges into these."""
    d = in_degrees(graph.edges, rel_type).withColumn("hub", F.col("n") > over)
    return d.agg(F.count("*").alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.round(F.sum("n") / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean"), F.count_if("hub").alias("hubs"), F.round(F.sum(F.when(F.col("hub"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("hub_share"))


def label_histogram(vectors: DataFrame) -> DataFrame:
    """label, n of a vector table, the most frequent first."""
    return vectors.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def page(rows: DataFrame, order: Sequence[str], skip: int, limit: int) -> DataFrame:
    """`limit` rows after the first `skip` in a stated order."""
    return rows.orderBy(*order).offset(max(0, skip)).limit(max(0, limit))


def middle_samples(nodes: DataFrame, bodies: DataFrame, most: int = 3) -> DataFrame:
    """id, label, has_body: of each label `most` nodes from the middle of its ids, so that a load which only reached its
    first part shows; labels with few nodes give their first.
    """
    totals = nodes.groupBy("label").agg(F.count("*").alias("total"))
    placed = numbered(nodes.select("label", "id"), ["label", "id"])
    first = placed.groupBy("label").agg(F.min("pos").alias("start"))
    skip = F.when(F.col("total") > most, F.floor(F.col("total") / 2)).otherwise(0)
    at = placed.join(F.broadcast(totals.join(first, "label")), "label").where((F.col("pos") - F.col("start") >= skip) & (F.col("pos") - F.col("start") < skip + most))  # a row for each label
    return at.select("id", "label").join(bodies.where("text <> ''").select("id", F.lit(True).alias("has")).distinct(), "id", "left").select("id", "label", F.coalesce("has", F.lit(False)).alias("has_body"))


def verify_vectors(vectors: DataFrame, queue: DataFrame) -> DataFrame:
    """present, total, missing of queued ids, and how many vectors do not match themselves."""
    has = queue.select("id").distinct().join(vectors.select("id", F.lit(1).alias("has")).distinct(), "id", "left")
    bad = vectors.agg(F.count_if(cosine(F.col("embedding"), F.col("embedding")) < 0.99).alias("unlike_self"))
    return has.agg(F.count("has").alias("present"), F.count("*").alias("total"), (F.count("*") - F.count("has")).alias("missing")).join(F.broadcast(bad))


__all__ = ["audit_references", "hubs", "label_histogram", "middle_samples", "page", "verify_graph", "verify_vectors"]
