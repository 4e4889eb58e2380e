"""Mentions and names that share a word prefix, by an index of prefixes: equi-joins instead of comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is listed under its beginnings of these lengths, as far as it has them; the longest is its own.
LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)


def word_keys(df: DataFrame, text: str) -> DataFrame:
    """df with word, key, own: each distinct word of a text in lower case under each of its beginnings; own marks the longest."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    rows = df.withColumn("word", F.explode(words))
    sizes = F.filter(F.array(*[F.lit(n) for n in LENGTHS]), lambda n: n <= F.length("word"))
    rows = rows.withColumn("_sizes", sizes).withColumn("_n", F.explode("_sizes"))
    return rows.withColumns({"key": F.substring(F.col("word"), F.lit(1), F.col("_n")), "own": F.col("_n") == F.array_max("_sizes")}).drop("_sizes", "_n")


def index(nodes: DataFrame) -> DataFrame:
    """key, own, word, id, label, text of the words of all nodes; a node without text is not listed."""
    return word_keys(nodes.select("id", "label", F.col("primary_text").alias("text")), "text").select("key", "own", "word", "id", "label", "text")


def save(names: DataFrame, path: str) -> None:
    """The index in the order of its keys, so that a few keys read a few row groups."""
    names.repartitionByRange("key", "id").sortWithinPartitions("key").write.option("parquet.block.size", 8 << 20).parquet(path)


def lookup(names: DataFrame, mentions: DataFrame, most_keys: int = 1000) -> DataFrame:
    """mention, id, label, text: each node with a word that is a prefix of a word of the mention, or the other way round.

    Two words that share a prefix meet where the shorter one's own key is: once, under a beginning of at least two
    thirds of its length (or all of it, up to six letters), and are compared there. The keys of a few mentions go into
    the scan of the index as a filter; those of many are joined only. A mention without words has no nodes.
    """
    asked = word_keys(mentions.select("mention").distinct(), "mention").withColumnsRenamed({"word": "asked", "own": "asked_own"})
    few = [r["key"] for r in asked.select("key").distinct().limit(most_keys + 1).collect()]
    names = names.where(F.col("key").isin(few) if few else F.lit(False)) if len(few) <= most_keys else names
    prefix = F.col("word").startswith(F.col("asked")) | F.col("asked").startswith(F.col("word"))
    ours = asked.where("asked_own").join(names, "key").where(prefix)
    theirs = asked.where("not asked_own").join(names.where("own"), "key").where(prefix)
    return ours.unionByName(theirs).select("mention", "id", "label", "text").distinct()
