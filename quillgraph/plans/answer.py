"""The question pipeline: resolve, search, expand, judge conflicts, cut evidence, synthesize."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, first_per
from ..operators import conflicts, evidence, names, ranking, traversal, writes
from ..schema import GraphSchema
from .models import Embedder, extract_answer, overlap_rank, plan_question


@dataclass
class Answer:
    text: str
    claims: list[tuple[str, list[int]]]
    nodes: DataFrame
    edges: DataFrame
    conflicts: DataFrame
    found: bool


def resolve(graph: Graph, mentions: list[str], vectors: DataFrame | None, embedder: Embedder, per_label: int = 50, index: DataFrame | None = None) -> DataFrame:
    """mention, id, confidence, rank, resolved, ambiguous of each mention's candidates: the 20 nearest vectors, then nodes
    that share a word prefix, `per_label` of each label by id. index: names.index of the graph's nodes, stored or not.
    """
    spark = graph.nodes.sparkSession
    asked = spark.createDataFrame([(m,) for m in mentions], "mention string")
    found = names.lookup(names.index(graph.nodes) if index is None else index, asked)
    listed = first_per(found, ["mention", "label"], "id", most=per_label).withColumn("ord", F.col("id"))
    semantic = listed.limit(0)
    if vectors is not None and mentions:
        embedded = spark.createDataFrame(list(zip(mentions, embedder(mentions).tolist())), "question_id string, embedding array<double>")
        near = ranking.search_many(vectors, embedded, 20).select(F.col("question_id").alias("mention"), "id", F.lit(0).cast("bigint").alias("ord"))
        semantic = near.join(vectors.select("id", "label", F.col("primary_text").alias("text")), "id")
    pool = ranking.shortlist(ranking.candidate_pool(semantic, listed))
    return ranking.confident(overlap_rank(pool))


def answer(graph: Graph, question: str, vectors: DataFrame, bodies: DataFrame, embedder: Embedder, synthesize: Callable = extract_answer, floor: float = 0.4, keep: int = 8, schema: GraphSchema | None = None) -> Answer:
    """Resolve, search, expand, judge, cut and synthesize. With a schema the question's types are walked, and the schema's
    conflict types; without one, or if the question names none, all. Only budgeted results are collected: at most 40
    nodes of evidence.
    """
    plan = plan_question(question, schema or GraphSchema((), ()))
    found = resolve(graph, plan.mentions or [question], vectors, embedder)
    q = embedder([question])[0].tolist()
    content = ranking.above(ranking.search(vectors, q, 5), floor).select("id")
    seeds = found.where("resolved").select("id").unionByName(content).distinct()
    reached, edges = traversal.budgeted(graph, seeds, traversal.focus_types(plan.focus, schema) if schema else None)
    reached = reached.cache()
    full = writes.attach_bodies(graph.nodes.join(F.broadcast(reached.select("id", "hop")), "id"), bodies)
    timed = full.select("id", "label", F.try_element_at("properties", F.lit("source")).alias("source"), conflicts.node_time().alias("at"))
    at = graph.edges.join(F.broadcast(reached.select(F.col("id").alias("src"))), "src").join(F.broadcast(reached.select(F.col("id").alias("dst"))), "dst")
    fights = conflicts.detect(timed, at.select("id", "rel_type", "src", "dst"))
    content_ids = full.where(F.map_contains_key("properties", "dsid")).select("id")
    cut = ranking.relevance_cut(content_ids, vectors, q, keep).select("id").unionByName(full.join(content_ids, "id", "left_anti").select("id"))
    lines = full.join(F.broadcast(cut), "id").select("id", F.concat_ws(" ", evidence.node_line(), "body").alias("line")).orderBy("id").collect()
    text, claims = synthesize(question, [(r.id, r.line) for r in lines]) if lines else ("", [])
    claims = [c for c in claims if c[0] in text]
    cited = sorted({i for _, ids in claims for i in ids})
    own = F.broadcast(found.where("resolved").select("id", F.lit(True).alias("res")).distinct())
    ids = F.broadcast(fights.select(F.explode(F.array("a", "b")).alias("id"), F.lit(True).alias("con")).distinct())
    flags = full.join(own, "id", "left").join(ids, "id", "left")
    role = evidence.role(F.coalesce("res", F.lit(False)), F.coalesce("con", F.lit(False)), F.col("id").isin(cited) if cited else F.lit(False), F.lit("hop"))
    return Answer(text, claims, flags.withColumn("role", role).drop("res", "con"), edges, fights, bool(lines))
