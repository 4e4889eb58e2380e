"""Threads and sections in texts: one row to many, inside the row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import looks_like_name, unescaped


def islands(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """df with column run: the number of the run of equal successive values within a key."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def _sections(df: DataFrame, opens: Callable[[Column], Column], head: Callable[[Column], Column], rest: Callable[[Column], Column]) -> DataFrame:
    """id, seq, head, body: lines from one that opens a section to the next; lines before the first have the head ''.

    All of it happens inside the row. Lines get a letter in front, `o` for the head of a section and `c` for what belongs
    to its body, so that cutting the text before each `o` at the start of a line gives the sections, whatever is in them.
    """
    part = lambda x: F.when(F.coalesce(opens(x), F.lit(False)), F.concat(F.lit("o"), head(x), F.lit("\nc"), rest(x))).otherwise(F.concat(F.lit("c"), x))
    lines = F.concat(F.lit("\n"), F.array_join(F.transform(F.split(unescaped("text"), "\n"), part), "\n"))
    found = df.select("id", F.posexplode(F.split(lines, "\no")).alias("seq", "part"))
    name = F.substring_index("part", "\n", 1)
    body = F.replace(F.substring(F.col("part"), F.length(name) + 1, F.length("part")), F.lit("\nc"), F.lit("\n"))
    return found.select("id", F.col("seq").cast("bigint").alias("seq"), name.alias("head"), F.regexp_replace(body, r"^\s+|\s+\z", "").alias("body"))


#: Lines that open a message and a section.
SPEAKER = r"^([^:]{1,40}):[ \t]+(.*)$"
TITLE = r"^([A-Z][A-Za-z0-9 _-]{0,40}):$"


def chat_messages(df: DataFrame) -> DataFrame:
    """id, seq, speaker, body from (id, text) with lines `Name: text`; other lines continue the message before.

    A null text has no messages, and lines before the first name are one without a speaker.
    """
    name = lambda x: F.regexp_extract(x, SPEAKER, 1)
    out = _sections(df, lambda x: x.rlike(SPEAKER) & looks_like_name(name(x)), name, lambda x: F.regexp_extract(x, SPEAKER, 2))
    return out.where("body <> ''").withColumnRenamed("head", "speaker")


def field_sections(df: DataFrame) -> DataFrame:
    """id, seq, title, body from (id, text) with lines that are only `Title:`."""
    out = _sections(df, lambda x: x.rlike(TITLE), lambda x: F.regexp_extract(x, TITLE, 1), lambda x: F.lit(""))
    return out.where("body <> '' or head <> ''").withColumnRenamed("head", "title")


def email_messages(df: DataFrame) -> DataFrame:
    """id, seq, sender, to_, subject, date, body of each mail in (id, text); a mail starts at a line `From: `."""
    parts = df.select("id", F.posexplode(F.split(unescaped("text"), r"(?:^|\n)(?=From:[ \t])")).alias("seq", "mail")).where("mail like 'From:%'")
    clean = F.regexp_replace("mail", r"(?m)^---+[ \t]*$\n?", "")
    head = F.regexp_extract(clean, r"^((?:[A-Z][A-Za-z-]*:[^\n]*(?:\n|$))+)", 1)
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*([^\n]*)$", 1))
    body = F.trim(F.regexp_replace(F.substring(clean, F.length(head) + 1, F.length(clean)), r"^\s+|\s+$", ""))
    return parts.select("id", F.col("seq").cast("bigint").alias("seq"), field("From").alias("sender"), field("To").alias("to_"), field("Subject").alias("subject"), field("Date").alias("date"), body.alias("body"))


def thread_counts(messages: DataFrame) -> DataFrame:
    """id, messages, speakers, groups of each chat (id, seq, speaker): runs of one speaker are a group."""
    runs = islands(messages, "id", "speaker", "seq")
    return runs.groupBy("id").agg(F.count("*").alias("messages"), F.count_distinct("speaker").alias("speakers"), F.max("run").cast("bigint").alias("groups"))


def content_kind(source: str, chats: str, mails: str) -> Column:
    """How a body is shown: as a thread or mails where its source is one and something was parsed, else as a document."""
    return F.when((F.col(source) == "slack") & (F.col(chats) > 0), "thread").when((F.col(source) == "gmail") & (F.col(mails) > 0), "mail").otherwise("document")


def claim_segments(df: DataFrame) -> DataFrame:
    """id, seq, start, end, claim from (id, answer, claims): claims that stand in the answer after each other.

    claim is null for the text between claims; a claim that is not found after the one before gives no row.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, answer, claims in zip(b.id, b.answer, b.claims):
                at, out = 0, []
                for n, c in enumerate(claims if claims is not None else []):
                    p = (answer or "").find(c, at) if c else -1
                    if p >= 0:
                        out += [(at, p, None)] * (p > at) + [(p, p + len(c), n)]
                        at = p + len(c)
                out += [(at, len(answer or ""), None)] * (at < len(answer or ""))
                rows += [(i, s, *x) for s, x in enumerate(out)]
            yield pd.DataFrame(rows, columns=["id", "seq", "start", "end", "claim"]).astype({"claim": "Int64"})

    return df.select("id", "answer", "claims").mapInPandas(cut, "id bigint, seq bigint, start bigint, end bigint, claim bigint")


def verbatim_claims(df: DataFrame) -> DataFrame:
    """id, claim_id, text of claims (id, answer, claims) that are substrings of the answer, numbered after that filter."""
    kept = F.filter("claims", lambda c: F.contains(F.col("answer"), c))
    return df.select("id", F.posexplode(kept).alias("pos", "text")).select("id", F.concat(F.lit("claim-"), F.col("pos").cast("string")).alias("claim_id"), "text")
