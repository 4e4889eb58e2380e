"""Interfaces of the model-backed steps, and defaults that work offline."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import token_overlap
from ..schema import GraphSchema


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class Synthesizer(Protocol):
    def __call__(self, question: str, evidence: Sequence[tuple[int, str]]) -> tuple[str, list[tuple[str, list[int]]]]: ...


class HashingEmbedder:
    """Words hashed into signed dimensions, scaled to length one; the same text always has the same vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def embed(queue: DataFrame, embedder: Embedder) -> DataFrame:
    """id, label, primary_text, embedding of queue rows (with text), in batches on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "label": b.label, "primary_text": b.primary_text, "embedding": list(embedder(b.text.fillna("").tolist()))})

    return queue.select("id", "label", "primary_text", "text").mapInPandas(run, "id bigint, label string, primary_text string, embedding array<float>")


def lexical_mentions(question: str) -> list[str]:
    """Capitalised word runs and bracketed mentions of a question: the offline planner."""
    found = re.findall(r"@\[([^\]]+)\]", question) + re.findall(r"\b[A-Z][\w-]*(?: [A-Z][\w-]*)*", question)
    return list(dict.fromkeys(found))


@dataclass(frozen=True)
class Plan:
    """What a question asks: the names in it, its kind, and the relationship types to walk (none: all)."""

    mentions: list[str]
    kind: str
    focus: list[str]


#: Words that tell the kind of a question, the first kind that fits.
KINDS = (
    ("conflict", ("contradict", "conflict", "supersede", "disagree", "outdated", "replace")),
    ("temporal", ("when", "before", "after", "until", "since", "previous", "latest", "current")),
    ("aggregate", ("many", "count", "number", "list", "all")),
    ("path", ("connect", "related", "between", "path", "link")),
)


def plan_question(question: str, schema: GraphSchema) -> Plan:
    """The offline planner: mentions, the kind by its words, and the schema's types that have a word of the question.

    A word of a type's name counts without its ending: OWNS is in focus of a question that has own, owns, owned or owner.
    """
    words = re.findall(r"[a-z]+", question.lower())
    kind = next((k for k, marks in KINDS if any(w.startswith(m) for w in words for m in marks)), "lookup")
    stem = lambda w: re.sub(r"(ed|s|e)$", "", w) if len(w) > 3 else w
    named = lambda t: any(w.startswith(stem(x)) for x in t.lower().split("_") if len(x) > 3 for w in words)
    return Plan(lexical_mentions(question), kind, [t.name for t in schema.rel_types if named(t.name)])


def overlap_rank(pool: DataFrame) -> DataFrame:
    """pool with a confidence: 0.9 for equal texts, 0.6 for overlapping words, else little, by place: the offline ranker."""
    same = F.lower("mention") == F.lower("text")
    return pool.withColumn("confidence", F.when(same, 0.9).when(token_overlap("mention", "text"), 0.6).otherwise(0.05 / (F.col("ord") + 1)))


def extract_answer(question: str, evidence: Sequence[tuple[int, str]], most: int = 3) -> tuple[str, list[tuple[str, list[int]]]]:
    """The evidence lines with most words of the question, each a claim that cites its node: the offline synthesizer."""
    asked = set(re.findall(r"\w+", question.lower()))
    ranked = sorted(evidence, key=lambda e: (-len(asked & set(re.findall(r"\w+", e[1].lower()))), e[0]))[:most]
    return " ".join(t for _, t in ranked), [(t, [i]) for i, t in ranked]


def contains_fact(answer: str, fact: str) -> bool:
    """The offline judge: every word of the fact is in the answer."""
    words = lambda s: set(re.findall(r"\w+", (s or "").lower()))
    return words(fact) <= words(answer)
