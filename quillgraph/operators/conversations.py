"""Conversations as two tables: conversations (id, title, created_at) and messages (id, conversation_id, position, role,
text, pending, result). Changes give new tables; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import short_title


def listing(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """id, title, created_at, messages (in their order) of every conversation, the newest first, then by id."""
    rows = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "role", "text", "pending"))).alias("messages"))
    empty = F.array().cast(rows.schema["messages"].dataType)
    return conversations.join(rows, "id", "left").withColumn("messages", F.coalesce("messages", empty)).orderBy(F.desc("created_at"), "id")


def titles(messages: DataFrame, most: int = 42) -> DataFrame:
    """id, title: the first text of a user, cut; conversations without one are not there."""
    first = messages.where("role = 'user'").groupBy(F.col("conversation_id").alias("id")).agg(F.min_by("text", "position").alias("text"))
    return first.select("id", short_title("text", most).alias("title"))


def replace_messages(messages: DataFrame, updates: DataFrame) -> DataFrame:
    """messages with those of the updated conversations replaced; positions are the places in the update's order (ord)."""
    ids = updates.select("conversation_id").distinct()
    place = (F.row_number().over(Window.partitionBy("conversation_id").orderBy("ord")) - 1).cast("int")
    return messages.join(ids, "conversation_id", "left_anti").select(messages.columns).unionByName(updates.withColumn("position", place).select(messages.columns))


def delete(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations of a table of ids."""
    return conversations.join(ids.select("id"), "id", "left_anti"), messages.join(ids.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti").select(messages.columns)


def rename(conversations: DataFrame, names: DataFrame) -> DataFrame:
    """conversations with the titles of (id, title); unknown ids are ignored."""
    return conversations.join(names.select("id", F.col("title").alias("_new")).dropDuplicates(["id"]), "id", "left").withColumn("title", F.coalesce("_new", "title")).select(conversations.columns)


def repaired(messages: DataFrame, result: str = '{"error": "interrupted"}') -> DataFrame:
    """messages without pending ones: an interrupted turn gets a result that says so, as nothing resumes it."""
    return messages.withColumns({"result": F.when(F.col("pending"), F.lit(result)).otherwise(F.col("result")), "pending": F.lit(False)})
