"""Evidence for an answer: roles, subtitles, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODIES = ("content", "description", "body", "text")


def role(resolved: Column, conflict: Column, evidence: Column, otherwise: Column) -> Column:
    """A resolved entity comes first, then a conflict, then evidence."""
    return F.when(resolved, "resolved").when(conflict, "conflict").when(evidence, "evidence").otherwise(otherwise)


def subtitle(properties: str = "properties", names: Sequence[str] = ("title", "name", "summary")) -> Column:
    """The first of some properties that is there, empty or not; content search takes `status` as well."""
    return F.coalesce(*[F.try_element_at(F.col(properties), F.lit(n)) for n in names])


def shown_subtitle(properties: str = "properties", text: str = "primary_text", names: Sequence[str] = ("title", "name", "summary", "status")) -> Column:
    """For display: the first that is not blank and is not the text itself, whatever the case."""
    each = [F.try_element_at(F.col(properties), F.lit(n)) for n in names]
    same = lambda c: F.lower(F.trim(c)) == F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return F.coalesce(*[F.when((F.trim(c) != "") & ~same(c), c) for c in each])


def shown_body(properties: str = "properties") -> Column:
    """The body for display: the first property that is there of content, text, body, description; null if it is empty."""
    return F.nullif(F.coalesce(*[F.try_element_at(F.col(properties), F.lit(n)) for n in ("content", "text", "body", "description")]), F.lit(""))


def compact(properties: str = "properties", most: int = 240, most_body: int = 6000) -> Column:
    """Properties as JSON with values cut to `most` characters, bodies to `most_body`, followed by an ellipsis."""
    limit = lambda k: F.when(k.isin(*BODIES), most_body).otherwise(most)
    return F.to_json(F.transform_values(properties, lambda k, v: F.when(F.length(v) > limit(k), F.concat(F.substring(v, F.lit(1), limit(k)), F.lit("…"))).otherwise(v)))


#: The lines that describe evidence to a model.
NODE_LINE, EDGE_LINE = '- id=%d [%s] "%s" properties=%s', "- %d -[%s%s]-> %d"
CONFLICT_LINE = "%d. Node %d vs node %d (%s edge). Graph reasoning selected node %d as current: %s"


def node_line() -> Column:
    return F.format_string(NODE_LINE, "id", "label", "primary_text", compact())


def edge_line() -> Column:
    """The edge with its properties, if it has any, in the order of their names."""
    pairs = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    props = F.when(F.size(pairs) > 0, F.concat(F.lit(" {"), F.array_join(pairs, ", "), F.lit("}"))).otherwise(F.lit(""))
    return F.format_string(EDGE_LINE, "src", "rel_type", props, "dst")


def conflict_line() -> Column:
    """A line for a conflict (i, a, b, rel_type, winner, reason)."""
    return F.format_string(CONFLICT_LINE, "i", "a", "b", "rel_type", "winner", "reason")


def counts(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """nodes, conflicts: how many of each an answer rests on; one row."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(conflicts.agg(F.count("*").alias("conflicts"))))  # one row by one row


def cited_edges(edges: DataFrame, cited: str) -> DataFrame:
    """Edges of rows (array column `cited`) whose two ends are cited."""
    return edges.where(F.array_contains(cited, F.col("src")) & F.array_contains(cited, F.col("dst")))
