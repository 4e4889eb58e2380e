"""A corpus pipeline: language, near duplicates, repeated passages, packed sequences.

Each stage takes what its predecessor kept and returns documents again; the last returns the packed pieces. Stages are
written as Parquet in the shared folder and reread, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import ship
from quillgraph.llm import langid, minhash_dedup, packing, suffix_dedup
from quillgraph.llm.common import materialise, passing


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Documents in a language the network has learned; texts without letters, null ones or with a score below `least` go.

    Repeated rows go or stay together; the columns stay as they are, whatever their names; an empty table stays empty,
    and without any labelled row to learn from nothing stays.
    """
    model = langid.fit(docs, ~langid.held_out())
    seen = docs.select(F.struct("*").alias("row"), langid.predict_column(model).alias("p"))
    return seen.where((F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.score") >= least)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 or more) stays, that with the smallest id; see minhash_dedup
    for nulls, repeated rows and clashing names."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur twice in what is left are cut out of the texts; all documents stay; see
    suffix_dedup for nulls, repeated rows and clashing names."""
    return suffix_dedup.strip_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it; see packing for nulls, long texts and repeated rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", keep_known_languages), ("near_dedup", drop_near_duplicates), ("repeat_removal", cut_repeats), ("packing", pack_sequences)]

#: No stage but the last filters by rules that SQL can state; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with passing() as keep:  # a stage's own tables go once its documents are written
            docs = materialise(stage(spark, docs, sf_dir))
            keep.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
