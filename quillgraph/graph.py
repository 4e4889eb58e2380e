"""A property graph as two DataFrames, and its lookups.

nodes: id, label, primary_text, properties (map of strings). edges: id, rel_type, src, src_label, dst, dst_label,
properties. Stored partitioned by label and rel_type, so that those filters prune files; and edges once more as seen
from both ends, sorted by the end that looks, so that a small frontier reads a few row groups only.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import KINDS, GraphSchema, identifier

NODE = "id bigint, label string, primary_text string, properties map<string,string>"
EDGE = "id bigint, rel_type string, src bigint, src_label string, dst bigint, dst_label string, properties map<string,string>"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    ends: DataFrame | None = None  # edges seen from both ends, as stored

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("nodes", "edges", "ends")))

    def save(self, path: str) -> None:
        """Nodes partitioned by label and sorted by id; edges by type; their two views by type and own end, made from the
        edges as written, so that these are derived once.
        """
        self.nodes.repartitionByRange("label", "id").sortWithinPartitions("label", "id").write.partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.partitionBy("rel_type").parquet(f"{path}/edges")
        written = self.edges.sparkSession.read.parquet(f"{path}/edges")
        ends = self._ends(written).repartitionByRange("rel_type", "at", "id").sortWithinPartitions("rel_type", "at")
        ends.write.partitionBy("rel_type").option("parquet.block.size", 8 << 20).parquet(f"{path}/ends")

    def only(self, rel_types: Sequence[str]) -> Graph:
        """The graph with edges of these types; a stored one reads their files only."""
        mine = F.col("rel_type").isin(list(rel_types))
        return Graph(self.nodes, self.edges.where(mine), None if self.ends is None else self.ends.where(mine))

    # lookups

    def by_label(self, label: str, limit: int | None = None) -> DataFrame:
        """Nodes of a label, by id; a limit under 1 counts as 1."""
        found = self.nodes.where(F.col("label") == identifier(label))
        return found if limit is None else found.orderBy("id").limit(max(1, int(limit)))

    def by_id(self, label: str, node_id: int) -> DataFrame:
        return self.nodes.where((F.col("label") == identifier(label)) & (F.col("id") == node_id))

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """Nodes of a table of ids (column id); an id that is there twice gives two rows."""
        return ids.select("id").join(self.nodes, "id")

    def by_property(self, label: str, name: str, value: str, limit: int = 50) -> DataFrame:
        return self.by_label(label).where(self.value(name) == value).orderBy("id").limit(limit)

    @staticmethod
    def value(name: str) -> Column:
        return F.col("primary_text") if name == "primary_text" else F.try_element_at("properties", F.lit(identifier(name)))

    def typed(self, schema: GraphSchema, label: str) -> DataFrame:
        """The label's declared properties as columns; others are left out of this view."""
        spec = schema.label(label)
        props = {} if spec is None else {k: v for k, v in spec.properties.items() if k not in ("id", "label", "primary_text")}
        return self.by_label(label).select("id", "label", "primary_text", *[self.value(k).try_cast(KINDS[v]).alias(k) for k, v in props.items()])

    def label_counts(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count("*").alias("n"))

    def rel_type_counts(self) -> DataFrame:
        return self.edges.where(F.col("rel_type").isNotNull()).groupBy("rel_type").agg(F.count("*").alias("n"))

    @staticmethod
    def _ends(e: DataFrame) -> DataFrame:
        rest = ["id", "rel_type", "src", "dst", "properties"]
        out = e.select(F.col("src").alias("at"), F.col("src_label").alias("at_label"), F.col("dst").alias("to"), F.col("dst_label").alias("to_label"), *rest, F.lit(True).alias("out"))
        back = e.select(F.col("dst").alias("at"), F.col("dst_label").alias("at_label"), F.col("src").alias("to"), F.col("src_label").alias("to_label"), *rest, F.lit(False).alias("out"))
        return out.unionByName(back)

    def adjacency(self, rel_types: Sequence[str] | None = None, direction: str = "both") -> DataFrame:
        """at, at_label, to, to_label, and the edge with its true orientation, seen from its source, target or both."""
        if direction not in ("outgoing", "incoming", "both"):
            raise ValueError(f"unknown direction: {direction!r}")
        e = self._ends(self.edges) if self.ends is None else self.ends
        e = e if rel_types is None else e.where(F.col("rel_type").isin(list(rel_types)))
        e = e if direction == "both" else e.where(F.col("out") == (direction == "outgoing"))
        return e.select("at", "at_label", "to", "to_label", "id", "rel_type", "src", "dst", "properties")


def few_ids(ids: DataFrame, most: int = 1000) -> list[int] | None:
    """The distinct ids (column id), if there are no more than `most` of them."""
    found = [r["id"] for r in ids.select("id").where("id is not null").distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def at_ids(adjacency: DataFrame, ids: DataFrame, most: int = 1000) -> DataFrame:
    """Rows of an adjacency at a table of ids: up to `most` ids go into the scan as a filter, which prunes; more are joined."""
    few = few_ids(ids, most)
    if few is not None:
        return adjacency.where(F.col("at").isin(few) if few else F.lit(False))
    return adjacency.join(ids.select(F.col("id").alias("at")).distinct(), "at", "left_semi")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with column pos, their place in the whole order: ranges are numbered by themselves, then shifted."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_idx": F.monotonically_increasing_id() % F.lit(2**33)}))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = dealt.groupBy("_part").count().select("_part", before.alias("_start"))  # a row for each partition
    return dealt.join(F.broadcast(heads), "_part").withColumn("pos", F.col("_start") + F.col("_idx")).drop("_start", "_idx", "_part")


def running(rows: DataFrame, order: Sequence[str], **weights: Column) -> DataFrame:
    """rows with a column for each weight, the sum of the weight in front of them in the whole order: ranges are summed by
    themselves, then shifted by the sums of the ranges before. Rows that are equal in `order` may share a range boundary
    anywhere, so name columns that tell them apart.
    """
    held = {f"_w{i}": w.cast("bigint") for i, w in enumerate(weights.values())}
    dealt = rows.withColumns(held).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_idx": F.monotonically_increasing_id()}))
    ahead = lambda c, by: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in held])  # a row for each partition
    heads = heads.select("_part", *[ahead(c, Window.orderBy("_part")).alias(f"{c}s") for c in held])
    own = dealt.withColumns({f"{c}o": ahead(c, Window.partitionBy("_part").orderBy("_idx")) for c in held}).join(F.broadcast(heads), "_part")
    return own.select(*rows.columns, *[(F.col(f"{c}s") + F.col(f"{c}o")).alias(name) for c, name in zip(held, weights)])


def first_per(df: DataFrame, keys: Sequence[str], *order: Column | str, most: int = 1) -> DataFrame:
    """The first rows of each key in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only where none is named and all run in one process."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="spark-quillgraph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
