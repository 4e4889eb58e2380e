"""Upserts, deletions, batching: new tables from old ones. Nothing is changed in place."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import truncated
from ..graph import Graph, cut, first_per, running


def merged_properties(old: str, new: str):
    """Keys of the new map replace those of the old one; keys it does not have stay."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def upsert_nodes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge by (label, id); of updates with one id the last by seq counts (a repeated update changes nothing)."""
    last = first_per(updates, ["label", "id"], F.desc("seq")).select("label", "id", F.col("primary_text").alias("new_text"), F.col("properties").alias("new"))
    both = nodes.join(last, ["label", "id"], "full")
    return both.select("id", "label", F.coalesce("new_text", "primary_text").alias("primary_text"), merged_properties("properties", "new").alias("properties"))


def upsert_edges(graph: Graph, updates: DataFrame) -> DataFrame:
    """Merge edges by (src, rel_type, id, dst); updates whose ends are not both there give nothing."""
    ids = graph.nodes.select("id")
    key = ["src", "rel_type", "id", "dst"]
    ok = updates.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    last = first_per(ok, key, F.desc("seq")).select(*key, F.col("src_label").alias("sl"), F.col("dst_label").alias("dl"), F.col("properties").alias("new"))
    both = graph.edges.join(last, key, "full")
    return both.select("id", "rel_type", "src", F.coalesce("src_label", "sl").alias("src_label"), "dst", F.coalesce("dst_label", "dl").alias("dst_label"), merged_properties("properties", "new").alias("properties"))


def upsert_vectors(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """The last row of an id stays: updates by seq, then what was there."""
    both = vectors.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(updates)
    return first_per(both, ["id"], F.desc("seq")).drop("seq")


def without_properties(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    return nodes.withColumn("properties", F.map_filter("properties", lambda k, v: ~k.isin(list(names))))


def property_counts(nodes: DataFrame, name: str) -> DataFrame:
    """The dry run of without_properties: label and n of nodes that have the property."""
    return nodes.where(F.map_contains_key("properties", name)).groupBy("label").agg(F.count("*").alias("n"))


def detach_delete(graph: Graph, first_id: int) -> Graph:
    """The graph without nodes from an id on and without edges at them."""
    gone = graph.nodes.where(F.col("id") >= first_id).select("id")
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(graph.nodes.where(F.col("id") < first_id), edges.select(graph.edges.columns))


def prune_into(edges: DataFrame, hubs: DataFrame, rel_type: str) -> DataFrame:
    """edges without those of a type that lead to a hub (column id); edges of other types are not joined."""
    mine = F.coalesce(F.col("rel_type") == rel_type, F.lit(False))
    kept = edges.where(mine).join(hubs.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti").select(edges.columns)
    return edges.where(~mine).unionByName(kept)


def resume(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Queue rows whose id is not done yet, the first by ord of each id."""
    return first_per(queue.join(done.select("id"), "id", "left_anti"), ["id"], "ord")


def split_bodies(nodes: DataFrame, names: Sequence[str] = ("content", "description", "body", "text")) -> tuple[DataFrame, DataFrame]:
    """(nodes without body properties, bodies: id, text with the non-empty parts joined by a blank line)."""
    parts = [F.nullif(F.try_element_at("properties", F.lit(n)), F.lit("")) for n in names]
    bodies = nodes.select("id", F.concat_ws("\n\n", *parts).alias("text")).where("text <> ''")
    return without_properties(nodes, names), bodies


def attach_bodies(nodes: DataFrame, bodies: DataFrame, inline: str = "content") -> DataFrame:
    """nodes with column body: what they hold themselves, else what the body table has."""
    own = F.nullif(F.try_element_at("properties", F.lit(inline)), F.lit(""))
    return nodes.join(bodies.select("id", F.col("text").alias("_text")), "id", "left").withColumn("body", F.coalesce(own, "_text")).drop("_text")


def truncate_properties(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("properties", F.transform_values("properties", lambda k, v: truncated(v, most)))


def size_batches(rows: DataFrame, most_bytes: int, most_rows: int, block: int = 65536) -> DataFrame:
    """rows with column batch: greedy runs within each part (columns part, ord, bytes), in the order of ord; a larger row is alone.

    Null bytes count as 0; rows that are equal in part and ord stand in any order. Where a batch that starts at a row
    ends follows from running sums, so each row points at the start of the next batch; the end of a part is the start of
    the next. All rows are one chain of such pointers, which is followed in blocks of `block` rows: each block tells where
    its rows leave it, doubling these few pointers gives where the chain enters each block, and each block then marks its
    own starts. So a part may have any number of rows, and no task holds more than a block.
    """
    every = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    size = F.greatest(F.coalesce("bytes", F.lit(0)).cast("bigint"), F.lit(0))
    at = running(every.select("part", "ord", "_id", size.alias("size")), ["part", "ord", "_id"], i=F.lit(1), before=F.col("size"))
    parts = at.groupBy("part").agg((F.max("i") + 1).alias("part_end"))
    ends = at.select("i", F.lit(0).alias("kind"), (F.col("before") + F.col("size")).alias("value"))
    asks = at.select("i", F.lit(1).alias("kind"), (F.col("before") + most_bytes).alias("value"))
    fits = running(ends.unionByName(asks), ["value", "kind", "i"], fit=1 - F.col("kind")).where("kind = 1").select("i", "fit")
    same = F.col("part").eqNullSafe(F.col("_part"))
    to = at.join(parts.withColumnRenamed("part", "_part"), same).join(fits, "i")
    to = to.select("i", F.least(F.greatest("fit", F.col("i") + 1), F.col("i") + most_rows, "part_end").alias("next"), F.expr(f"i div {block}").alias("b"))
    to = cut(to)

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        low, out = int(pdf.i.iloc[0]), pdf.next.tolist()
        for k in range(len(out) - 1, -1, -1):
            if out[k] - low < len(out):
                out[k] = out[out[k] - low]
        return pd.DataFrame({"i": pdf.i, "leaves": out})

    jump = cut(to.groupBy("b").applyInPandas(lambda pdf: leave(pdf), "i bigint, leaves bigint"))
    entries = cut(jump.select(F.col("leaves").alias("i")).distinct())
    jump = cut(jump.join(entries, "i", "left_semi").unionByName(jump.where("i = 0")).distinct())
    reached = to.where("i = 0").select("i")
    for _ in range(max(0, to.select("b").distinct().count() - 1).bit_length()):
        reached = cut(reached.unionByName(reached.join(jump, "i").select(F.col("leaves").alias("i"))).distinct())
        jump = cut(jump.join(jump.toDF("leaves", "then"), "leaves").select("i", F.col("then").alias("leaves")))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        low, to = int(pdf.i.iloc[0]), pdf.next.tolist()
        first, k = [0] * len(to), next(iter(pdf.i[pdf.enters.to_numpy(bool)] - low), len(to))
        while k < len(to):
            first[k] = 1
            k = to[k] - low
        return pd.DataFrame({"i": pdf.i, "first": first})

    marked = to.join(reached.withColumn("enters", F.lit(True)), "i", "left").withColumn("enters", F.coalesce("enters", F.lit(False)))
    marked = marked.groupBy("b").applyInPandas(lambda pdf: starts(pdf), "i bigint, first int")
    counted = cut(running(marked, ["i"], ahead=F.col("first")).select("i", (F.col("ahead") + F.col("first")).alias("number")).join(at.select("i", "_id", "part"), "i"))
    base = counted.groupBy("part").agg(F.min("number").alias("base")).withColumnRenamed("part", "_part")
    found = counted.join(base, same).select("_id", (F.col("number") - F.col("base")).alias("batch"))
    return every.join(found, "_id").drop("_id")


def chunks(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with column chunk: the position in the key's order divided by size."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))
