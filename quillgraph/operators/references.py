"""Cross-document references by shared keys, with caps that keep over-used keys out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import distinctive_key
from ..graph import cut, first_per

#: Bytes of keys that are broadcast.
MOST_BROADCAST = 16_000_000


def usable_keys(declared: DataFrame, most_declarers: int = 3, digits: bool = True) -> DataFrame:
    """token, dst: keys of (token, dst) that at most `most_declarers` distinct documents declare; others go altogether.

    A key carries one more of its documents than it may have, and goes if it has that many; so the table is read once
    and no key is heavier than that after the first step.
    """
    fine = declared.where(distinctive_key("token")) if digits else declared
    few = first_per(fine.select("token", "dst").distinct(), ["token"], "dst", most=most_declarers + 1)
    return few.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).where(F.col("_n") <= most_declarers).select("token", "dst")


def resolve_links(cited: DataFrame, declared: DataFrame, most_declarers: int = 3, most_citations: int = 200, digits: bool = True) -> DataFrame:
    """src, dst, token of resolved references. cited: src, pos, token.

    A reference belongs to the first token, by position and then token, that reaches its target. A token that then has
    more than `most_citations` references is dropped with them, even where another token reaches a target as well. Few
    keys survive their cap; where these are small, they are told to all tasks and no other token is exchanged.
    """
    keys = cut(usable_keys(declared, most_declarers, digits))
    size = keys.agg(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()[0]
    hits = cited.join(F.broadcast(keys) if size <= MOST_BROADCAST else keys, "token").where("src <> dst")
    first = hits.groupBy("src", "dst").agg(F.min(F.struct("pos", "token")).alias("at")).select("src", "dst", "at.token")
    few = first_per(first, ["token"], "src", "dst", most=most_citations + 1)  # one more than may be shows that there are too many
    return few.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).where(F.col("_n") <= most_citations).select("src", "dst", "token")


def fan_out(links: DataFrame, most: int = 15) -> DataFrame:
    return links.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def in_degrees(edges: DataFrame, rel_type: str | None = None) -> DataFrame:
    e = edges if rel_type is None else edges.where(F.col("rel_type") == rel_type)
    return e.groupBy(F.col("dst").alias("id"), F.col("dst_label").alias("label")).agg(F.count("*").alias("n"))


def histogram(degrees: DataFrame) -> DataFrame:
    """bucket, targets, edges, pct: in-degrees in the ranges 1, 2-5, 6-20, 21-100, 101-1000 and more."""
    n = F.col("n")
    bucket = F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").when(n <= 1000, "101-1000").otherwise(">1000")
    per = degrees.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("targets"), F.sum("n").alias("edges"))  # six rows
    total = per.agg(F.sum("edges").alias("total"))  # one row
    return per.join(F.broadcast(total)).select("bucket", "targets", "edges", F.round(100.0 * F.col("edges") / F.col("total"), 1).alias("pct"))


def hubs(degrees: DataFrame, over: int = 200) -> DataFrame:
    return degrees.where(F.col("n") > over)


def contradictions(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """src, dst, question_id from gold questions about conflicting information with exactly two expected documents."""
    two = questions.where((F.col("question_type") == "conflicting_info") & (F.size("expected") == 2))
    ids = docs.select("dsid", "id")
    out = two.select("question_id", F.col("expected")[0].alias("a"), F.col("expected")[1].alias("b"))
    return out.join(ids.toDF("a", "src"), "a").join(ids.toDF("b", "dst"), "b").select("src", "dst", "question_id")
