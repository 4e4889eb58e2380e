"""Ingest of raw documents in phases that survive a stop: nodes, then references, then done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import link_tokens, stable_id
from ..graph import Graph
from ..sources import adapters, files
from . import links
from .incremental import _exists

PHASES = ("nodes", "references", "done")


def reached(spark: SparkSession, folder: str, name: str) -> str | None:
    """The last phase that the named ingest has finished."""
    return next((p for p in reversed(PHASES) if _exists(spark, f"{folder}/phases/{name}/{p}")), None)


def _finish(spark: SparkSession, folder: str, name: str, phase: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/phases/{name}/{phase}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)


def document_tokens(docs: DataFrame) -> DataFrame:
    """links.TOKEN rows of normalised documents: keys that they declare, in lower case, and tokens of their links in order."""
    ids = docs.withColumn("id", stable_id("doc", "dsid"))
    declared = ids.select("id", F.explode("keys").alias("key")).select(F.lower("key").alias("token"), F.col("id").alias("dst"))
    cited = ids.select("id", F.concat_ws(" ", "links").alias("text")).select(F.col("id").alias("src"), F.posexplode(link_tokens("text")).alias("pos", "token"))
    return links.tokens(cited, declared)


def ingest(spark: SparkSession, path: str, folder: str, name: str, files_per_batch: int = 4000, most_declarers: int = 3, most_citations: int = 200) -> Graph:
    """The graph of the raw JSON documents under `path`, stored under `folder`.

    Nodes: new files are read in bounded batches; each writes its nodes, edges and tokens to folders of its own.
    References: the tokens go through the keyed state of streaming.links. Done: links become edges, nodes and edges that
    several batches have are one, and the graph is stored. A phase that a stopped run has finished is not done again, and
    within a phase the checkpoint tells the batches that are done. A later ingest of further files takes another name
    and goes on from the same state.
    """
    at = reached(spark, folder, name)
    graph = f"{folder}/graph-{name}"
    if at is None:

        def write(batch: DataFrame, n: int) -> None:
            docs = adapters.normalise(batch).persist()
            g = adapters.graph_rows(docs)
            for rows, kind in ((g.nodes, "nodes"), (g.edges, "edges"), (document_tokens(docs), "tokens")):
                rows.write.mode("overwrite").parquet(f"{folder}/{kind}/batch={n}")
            docs.unpersist()

        files.raw_stream(spark, path, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state/nodes").trigger(availableNow=True).start().awaitTermination()
        _finish(spark, folder, name, at := "nodes")
    if at == "nodes":
        stream = spark.readStream.schema(links.TOKEN).parquet(f"{folder}/tokens")
        links.maintain(stream, f"{folder}/changes", f"{folder}/state/references", most_declarers).awaitTermination()
        _finish(spark, folder, name, at := "references")
    if at == "references":
        nodes, edges = (spark.read.parquet(f"{folder}/{kind}").drop("batch").dropDuplicates(["id"]) for kind in ("nodes", "edges"))
        found = links.current(spark, f"{folder}/changes", most_citations)
        label = nodes.select("id", "label")
        found = found.join(label.toDF("src", "src_label"), "src").join(label.toDF("dst", "dst_label"), "dst")
        key = F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string"))
        refs = found.select(stable_id("references", key).alias("id"), F.lit("REFERENCES").alias("rel_type"), "src", "src_label", "dst", "dst_label", F.create_map(F.lit("token"), F.col("token")).alias("properties"))
        Graph(nodes, edges.unionByName(refs).dropDuplicates(["id"])).save(graph)
        _finish(spark, folder, name, "done")
    return Graph.load(spark, graph)
