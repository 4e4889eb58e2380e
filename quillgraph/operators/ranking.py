"""Exact cosine search, restricted re-ranking, cuts, and entity candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import cosine, norm, token_overlap
from ..graph import few_ids, first_per
from .evidence import subtitle


def with_norm(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    return vectors.withColumn("norm", norm(F.col(vec)))


def save_vectors(vectors: DataFrame, path: str) -> None:
    """The vector table with its norms, in folders by label and sorted by id: labels prune files, ids prune row groups."""
    with_norm(vectors).repartitionByRange("label", "id").sortWithinPartitions("label", "id").write.partitionBy("label").option("parquet.block.size", 16 << 20).parquet(path)


def load_vectors(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table that save_vectors wrote; schema is that of the vectors before, which gives the labels their type."""
    return spark.read.schema(StructType([*schema.fields, StructField("norm", DoubleType())])).parquet(path)


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, labels: Sequence | None = None, vec: str = "embedding") -> DataFrame:
    """The vectors with a score, the k highest, ties by id. Labels filter before scoring; an empty list matches nothing.

    A zero query has no matches; a zero vector scores 0. The order goes by full scores; they are rounded after it.
    """
    if k < 1 or not any(query):
        return vectors.withColumn("score", F.lit(0.0)).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    found = vectors if labels is None else vectors.where(F.col("label").isin(list(labels)))
    na = F.col("norm") if "norm" in vectors.columns else None
    best = found.withColumn("score", cosine(F.col(vec), q, na, F.lit(length))).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("score", F.round("score", 6))


def above(matches: DataFrame, least: float) -> DataFrame:
    """The floor comes after the top-k, as a filter on its result."""
    return matches.where(F.col("score") >= least)


def among(vectors: DataFrame, query: Sequence[float], ids: DataFrame, k: int, vec: str = "embedding") -> DataFrame:
    """Search restricted to a table of ids; unknown ids are ignored, an id that is there twice is scored twice."""
    few = few_ids(ids)
    near = vectors if few is None else vectors.where(F.col("id").isin(few) if few else F.lit(False))
    return search(ids.select("id").join(near, "id"), query, k, vec=vec)


def search_many(vectors: DataFrame, questions: DataFrame, k: int, vec: str = "embedding", rows: int = 8192, asked: int = 1024) -> DataFrame:
    """question_id, id, score, rank: the k vectors with the highest cosine of each question (question_id, embedding).

    Vectors and questions are dealt into blocks of about `rows` and `asked` by the hash of their ids; every two blocks
    meet in a task of their own, as one product of matrices, which gives k rows for a question. So a task's work is
    bounded, and what is merged is k rows for each question and block of vectors. Scores are rounded to 12 places before
    they are compared; ties go by id. A zero vector, or one of another dimension, scores 0.
    """
    nv, nq = (max(1, -(-df.count() // n)) for df, n in ((vectors, rows), (questions, asked)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = vectors.where(F.col(vec).isNotNull()).select("id", F.col(vec).cast("array<double>").alias("v"), block("id", nv).alias("vb"), every(nq).alias("qb"))
    q = questions.where("embedding is not null").select("question_id", F.col("embedding").cast("array<double>").alias("q"), block("question_id", nq).alias("qb")).withColumn("vb", every(nv))

    def unit(rows: list[np.ndarray], dim: int) -> np.ndarray:
        m = np.array([x if len(x) == dim else np.zeros(dim) for x in rows]).reshape(len(rows), dim)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return m / np.where(n == 0, 1, n)

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        v, out = v.sort_values("id", kind="stable"), []
        ids = v.id.to_numpy()
        for dim, part in q.groupby(q.q.map(len)):
            m = unit(v.v.tolist(), dim) if len(v) else np.zeros((0, dim))
            for name, score in zip(part.question_id, (unit(part.q.tolist(), dim) @ m.T).round(12)):
                floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -2.0
                at = np.concatenate([np.flatnonzero(score > floor), np.flatnonzero(score == floor)])[:k]
                out += [(name, ids[i], score[i]) for i in at]
        return pd.DataFrame(out, columns=["question_id", "id", "score"])

    out = StructType([StructField("question_id", questions.schema["question_id"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("score", DoubleType())])
    near = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(lambda a, b: best(a, b), out)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def relevance_cut(ids: DataFrame, vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The k best ids that have a vector, and all that have none (score null)."""
    best = among(vectors, query, ids, k).select("id", "score")
    return best.unionByName(ids.select("id").join(vectors.select("id"), "id", "left_anti").withColumn("score", F.lit(None).cast("double")))


def hydrate(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matches with their nodes' columns and their rank by score; matches without a node go."""
    ranked = matches.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a top-k result
    return ranked.select("id", "score", "rank").join(nodes, "id").orderBy("rank")


def candidate_pool(semantic: DataFrame, listed: DataFrame) -> DataFrame:
    """mention, id, text, ord: semantic candidates first, then listed ones; the first of an id stays."""
    both = semantic.select("mention", "id", "text", F.lit(0).alias("src"), "ord").unionByName(listed.select("mention", "id", "text", F.lit(1).alias("src"), "ord"))
    return first_per(both, ["mention", "id"], "src", "ord")


def shortlist(pool: DataFrame, most: int = 8) -> DataFrame:
    """Candidates that overlap with the mention by word prefix; where none does, the first of the pool."""
    flagged = pool.withColumn("hit", token_overlap("mention", "text").cast("int"))
    return first_per(flagged, ["mention"], F.desc("hit"), "src", "ord", "id", most=most).transform(_best_hits)


def _best_hits(first: DataFrame) -> DataFrame:
    """Of each mention's first rows, hits before others, those as good as the first."""
    return first.withColumn("any_hit", F.max("hit").over(Window.partitionBy("mention"))).where("hit = any_hit").drop("any_hit")


def neighbour_summary(hops: DataFrame, most_edges: int = 12, most_names: int = 6) -> DataFrame:
    """id, summary from (id, edge, other, text, label): distinct `text (label)` of the first edges, the node itself left out."""
    first = first_per(hops.where("other <> id"), ["id"], "edge", "other", most=most_edges)
    named = first.withColumn("name", F.concat("text", F.lit(" ("), "label", F.lit(")")))
    named = first_per(named.groupBy("id", "name").agg(F.min(F.struct("edge", "other")).alias("at")), ["id"], "at", most=most_names)
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ", ").alias("summary"))


def confident(ranked: DataFrame, least: float = 0.02, most: int = 5, drop_under: float = 0.08, overrides: DataFrame | None = None) -> DataFrame:
    """mention, id, confidence, rank, resolved, ambiguous: what remains of each mention's ranked candidates.

    The first always stays, others from `least` on, `most` in all; a mention whose best is under `drop_under` goes,
    overridden or not. overrides: mention, id of choices that count instead of the first (an id that did not remain
    leaves no row resolved).
    """
    w = Window.partitionBy("mention")
    r = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "ord", "id"))).withColumn("top", F.max("confidence").over(w))
    kept = r.where(((F.col("rank") == 1) | (F.col("confidence") >= least)) & (F.col("rank") <= most) & (F.col("top") >= drop_under))
    n = F.count("*").over(w)
    kept = kept.select("mention", "id", "confidence", "rank", (F.col("rank") == 1).alias("resolved"), ((n > 1) & (F.col("top") < 0.85)).alias("ambiguous"))
    if overrides is None:
        return kept
    chosen = overrides.groupBy("mention").agg(F.min("id").alias("_id"))
    return kept.join(chosen, "mention", "left").withColumn("resolved", F.coalesce(F.col("id") == F.col("_id"), F.col("resolved"))).drop("_id")


def mention_matches(vectors: DataFrame, nodes: DataFrame, text: str, query: Sequence[float], k: int = 8, least: float = 0.15) -> DataFrame:
    """id, label, name, subtitle for completing a mention: the k nearest with a score of at least `least`; blank: none."""
    found = above(search(vectors, query, k if text.strip() else 0), least).select("id", "score")
    own = subtitle(names=("title", "name", "summary", "status"))
    return hydrate(found, nodes).select("id", "label", F.col("primary_text").alias("name"), F.when(own != F.col("primary_text"), own).alias("subtitle"), "rank")


def documents_of(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """matches with the document id (dsid) of their nodes; a match without one stays, with null."""
    ids = nodes.select("id", F.try_element_at("properties", F.lit("dsid")).alias("dsid"))
    return matches.join(ids, "id", "left")


def baseline(vectors: DataFrame, nodes: DataFrame, bodies: DataFrame, questions: DataFrame, labels: Sequence[str], k: int = 5, most_text: int = 4000) -> DataFrame:
    """question_id, document_ids, context: plain vector retrieval of the k nearest content nodes of each question.

    questions: question_id, embedding. The context has a title and body of each, cut to `most_text` characters.
    """
    top = documents_of(search_many(vectors.where(F.col("label").isin(list(labels))), questions, k), nodes)
    texts = nodes.select("id", "primary_text").join(bodies.select("id", F.col("text").alias("body")), "id", "left")
    part = F.substring(F.concat_ws("\n", F.nullif("primary_text", F.lit("")), F.nullif("body", F.lit(""))), 1, most_text)
    line = F.concat(F.lit("[Doc "), F.col("rank").cast("string"), F.lit("] "), F.coalesce(part, F.lit("")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    top = top.join(texts, "id", "left").withColumn("line", line)
    return top.groupBy("question_id").agg(F.array_compact(in_order("dsid")).alias("document_ids"), F.array_join(in_order("line"), "\n\n").alias("context"))


def has_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """id, has: whether each distinct id is in the vector table."""
    return ids.select("id").distinct().join(vectors.select("id", F.lit(True).alias("has")).distinct(), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has"))


def fallback(pool: DataFrame, most: int = 5) -> DataFrame:
    """The first of the pool with confidence 1, the next with 0."""
    first = first_per(pool, ["mention"], "src", "ord", "id", most=most)
    rank = F.row_number().over(Window.partitionBy("mention").orderBy("src", "ord", "id"))
    return first.withColumn("confidence", F.when(rank == 1, 1.0).otherwise(0.0))
