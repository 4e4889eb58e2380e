"""Raw JSON documents in folders by source, JSON lines, and samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import numbered

QUESTION = "question_id string, question_type string, question string, expected array<string>, facts array<string>"
ANSWER = "question_id string, answer string, document_ids array<string>"


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """dsid, source_type, rel_path, raw of every JSON file under a folder; source_type is the first folder.

    raw is a map of the top-level fields as JSON text or plain strings. The id falls back to the path. Files that are no
    JSON object are left out.
    """
    return _documents(_whole_files(spark.read).text(path), path)


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 4000) -> DataFrame:
    """raw_documents of the files under a folder as they arrive, so many at a time."""
    return _documents(_whole_files(spark.readStream).option("maxFilesPerTrigger", files_per_batch).text(path), path)


def _whole_files(reader):
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true")


def _documents(files: DataFrame, path: str) -> DataFrame:
    root = path.rstrip("/").rsplit("/", 1)[-1]
    rel = F.substring_index(F.expr("_metadata.file_path"), f"/{root}/", -1)
    raw = F.from_json("value", "map<string,string>")
    found = files.select(F.url_decode(rel).alias("rel_path"), raw.alias("raw")).where(F.col("raw").isNotNull() & (F.size("raw") > 0))
    return found.select(F.coalesce(F.try_element_at("raw", F.lit("dataset_doc_uuid")), "rel_path").alias("dsid"), F.substring_index("rel_path", "/", 1).alias("source_type"), "rel_path", "raw")


def strided(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every n-th row in order, so that at most `most` remain. Only the order column is dealt, by ranges, for the ranks."""
    stride = max(1, df.count() // max(1, most))
    keep = numbered(df.select(order), [order]).where(F.col("pos") % stride == 0).orderBy("pos").limit(most)
    return df.join(keep.drop("pos"), order, "left_semi")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path).where("question_id is not null")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question id: of several the last line counts."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("line"), F.from_json("value", ANSWER).alias("a"))
    return lines.where("a.question_id is not null").groupBy("a.question_id").agg(F.max_by("a", "line").alias("a")).select("a.*")


def queue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).dropDuplicates(["id"])


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, null fields included; what is there is replaced."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_bodies(bodies: DataFrame, path: str) -> None:
    """The body table (id, text) in ranges of ids, sorted by id, so that look-ups prune; of an id that is there twice the
    longer text stays, then the greater.
    """
    last = bodies.groupBy("id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("b")).select("id", F.col("b.text").alias("text"))
    last.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)
