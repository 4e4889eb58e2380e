"""A graph over the star-schema tables, and the tables as typed views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import stable_id
from ..graph import Graph, shared_folder
from ..operators import names, ranking

#: label, table, key column, text column.
NODES = (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("order", "orders", "o_orderkey", "o_orderstatus"))
#: type, table, source label and key column, target label and key column.
EDGES = (
    ("PART_OF", "nation", "nation", "n_nationkey", "region", "n_regionkey"),
    ("LOCATED_IN", "customer", "customer", "c_custkey", "nation", "c_nationkey"),
    ("BASED_IN", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    ("PLACED", "orders", "customer", "o_custkey", "order", "o_orderkey"),
    ("CONTAINS", "lineitem", "order", "l_orderkey", "part", "l_partkey"),
    ("SUPPLIED_BY", "lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(label: str, key: Column) -> Column:
    """stable_id of a node, told to be never null: else a join computes it twice, the first time to look for nulls."""
    return F.coalesce(stable_id(label, key), F.lit(0))


def star_graph(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None, repeats: bool = False) -> Graph:
    """All nodes, and edges of the asked types (all by default); equal edges are one, or may stay apart (`repeats`), which
    spares a shuffle.
    """
    nodes = edges = None
    for label, name, key, text in NODES:
        k = F.col(key).cast("string")
        part = table(spark, sf_dir, name).select(_id(label, k).alias("id"), F.lit(label).alias("label"), F.col(text).alias("primary_text"), F.create_map(F.lit("key"), k).alias("properties"))
        nodes = part if nodes is None else nodes.unionByName(part)
    for kind, name, sl, sk, dl, dk in EDGES:
        if types is not None and kind not in types:
            continue
        s, d = F.col(sk).cast("string"), F.col(dk).cast("string")
        rows = table(spark, sf_dir, name).select(sk, dk)
        rows = rows.distinct() if name == "lineitem" and not repeats else rows
        part = rows.select(stable_id(kind, F.concat_ws("-", s, d)).alias("id"), F.lit(kind).alias("rel_type"), _id(sl, s).alias("src"), F.lit(sl).alias("src_label"), _id(dl, d).alias("dst"), F.lit(dl).alias("dst_label"), F.create_map().cast("map<string,string>").alias("properties"))
        edges = part if edges is None else edges.unionByName(part)
    return Graph(nodes, edges)


#: Folders that this application has stored, by application, kind, tables and the tables' state.
_stored: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> tuple:
    """When each table was last written, and its size."""
    sc, out = spark.sparkContext, []
    for name in names:
        where = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = where.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(where)
        out.append((status.getModificationTime(), status.getLen()))
    return tuple(out)


def _once(spark: SparkSession, sf_dir: str, kind: str, names: Sequence[str], write: Callable[[str], None]) -> str:
    """The folder that `write` filled in the shared folder, at the first call of an application and after the tables changed."""
    key = (spark.sparkContext.applicationId, kind, sf_dir, _state(spark, sf_dir, names))
    if key not in _stored:
        path = f"{shared_folder(spark)}/quillgraph-{kind}-{uuid.uuid4().hex}"
        write(path)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _stored[key] = path
    return _stored[key]


STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star graph as a stored one, which reads are pruned on."""
    return Graph.load(spark, _once(spark, sf_dir, "graph", STAR, lambda path: star_graph(spark, sf_dir).save(path)))


def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of the star graph's names."""
    return spark.read.parquet(_once(spark, sf_dir, "names", STAR, lambda path: names.save(names.index(star_graph(spark, sf_dir, ()).nodes), path)))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, label, norm of the embeddings, stored by label."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return ranking.load_vectors(spark, _once(spark, sf_dir, "vectors", ("embeddings",), lambda path: ranking.save_vectors(rows, path)), rows.schema)


def id_sql(kind: str, key: str) -> str:
    """stable_id in DuckDB's SQL."""
    return f"(('0x' || substr(md5('{kind}:' || {key}::varchar), 1, 12))::bigint + 10000)"


def nodes_sql() -> str:
    return " union all ".join(f"select {id_sql(label, key)} as id, '{label}' as label, {text} as primary_text from {name}" for label, name, key, text in NODES)


def edges_sql(types: tuple[str, ...] | None = None) -> str:
    parts = []
    for kind, name, sl, sk, dl, dk in EDGES:
        if types is None or kind in types:
            edge = id_sql(kind, f"({sk}::varchar || '-' || {dk}::varchar)")
            parts.append(f"select distinct {edge} as id, '{kind}' as rel_type, {id_sql(sl, sk)} as src, '{sl}' as src_label, {id_sql(dl, dk)} as dst, '{dl}' as dst_label from {name}")
    return " union all ".join(parts)
