"""Retrieval evaluation: recall, surplus, completeness, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(expected: str, found: str) -> Column:
    """Share of expected items that were found, repeats counted; null where nothing is expected."""
    hit = F.size(F.filter(expected, lambda x: F.array_contains(F.col(found), x)))
    return F.when(F.size(expected) > 0, hit / F.size(expected))


def surplus(expected: str, found: str) -> Column:
    """Number of found items that are not expected, repeats counted."""
    return F.size(F.filter(found, lambda x: ~F.array_contains(F.col(expected), x))).cast("bigint")


def completeness(facts: str) -> Column:
    """Share of an array of booleans that is true; 1 where there are none."""
    return F.when(F.size(facts) == 0, F.lit(1.0)).otherwise(F.size(F.filter(facts, lambda x: x)) / F.size(facts))


def with_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers; a missing or empty answer makes the answer's columns null."""
    real = answers.where(F.coalesce(F.trim("answer"), F.lit("")) != "")
    return questions.join(real, "question_id", "left")


def summary(rows: DataFrame, by: str, *metrics: str) -> DataFrame:
    """Overall (by null) and for each group: count, answered, and means over non-null values, rounded to 6 places."""
    sets = rows.groupingSets([[], [F.col(by)]], F.col(by))
    return sets.agg(F.count("*").alias("n"), F.count(metrics[0]).alias("answered"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def leaderboard(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.avg(F.col("correct") * F.col("completeness")), 6).alias("score"))


def completeness_by(facts: DataFrame, key: str, fact: str) -> DataFrame:
    """key, completeness: the share of each key's facts (a boolean column) that are covered; null ones are no facts, and
    without any the share is 1. Only partial counts are exchanged.
    """
    n = F.count(fact)
    return facts.groupBy(key).agg(F.when(n == 0, F.lit(1.0)).otherwise(F.round(F.count_if(fact) / n, 6)).alias("completeness"))
