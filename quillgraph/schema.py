"""Graph schema: labels and relationship types with their properties; declared, swappable and advisory."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
KINDS = {"string": "string", "number": "bigint", "boolean": "boolean"}


def identifier(name: str) -> str:
    """The name, if it can name a label, type or property; an error otherwise."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class Label:
    name: str
    properties: dict[str, str]
    display: str = "primary_text"


@dataclass(frozen=True)
class RelType:
    name: str
    sources: tuple[str, ...] = ("*",)
    targets: tuple[str, ...] = ("*",)


@dataclass(frozen=True)
class GraphSchema:
    labels: tuple[Label, ...]
    rel_types: tuple[RelType, ...]
    content_labels: tuple[str, ...] = field(default=("Document", "Message", "Task", "Issue"))

    def label(self, name: str) -> Label | None:
        return next((x for x in self.labels if x.name == name), None)

    def rel_type(self, name: str) -> RelType | None:
        return next((x for x in self.rel_types if x.name == name), None)

    def describe(self) -> str:
        """A text of all labels with their properties and all types with their ends."""
        nodes = "\n".join(f"- {x.name}: {', '.join(x.properties)}" for x in self.labels)
        edges = "\n".join(f"- {x.name}: {'|'.join(x.sources)} -> {'|'.join(x.targets)}" for x in self.rel_types)
        return f"Labels:\n{nodes}\nRelationships:\n{edges}"

    @classmethod
    def from_json(cls, text: str) -> GraphSchema:
        raw = json.loads(text)
        labels = tuple(Label(identifier(x["name"]), {identifier(k): _kind(v) for k, v in x.get("properties", {}).items()}, x.get("display", "primary_text")) for x in raw["labels"])
        types = tuple(RelType(identifier(x["name"]), tuple(x.get("from", ["*"])), tuple(x.get("to", ["*"]))) for x in raw["relationships"])
        return cls(labels, types)


def _kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown property kind: {kind!r}")
    return kind


def _label(name: str, props: str) -> Label:
    return Label(name, {"id": "number"} | dict.fromkeys(props.split(), "string"))


#: The default labels with their properties, and relationship types with their ends.
DEFAULT = GraphSchema(
    (
        _label("Person", "name email title source"),
        _label("Organization", "name kind"),
        _label("Project", "name summary status"),
        _label("Document", "title content url source dsid created_at updated_at"),
        _label("Message", "text source sent_at thread_id dsid"),
        _label("Channel", "name source"),
        _label("Task", "title description status source created_at dsid"),
        _label("Repository", "name url"),
        _label("Issue", "title body status source created_at dsid"),
        _label("Decision", "summary decided_at status"),
        _label("Event", "title starts_at ends_at"),
    ),
    (
        RelType("WORKS_ON", ("Person",), ("Project", "Task")),
        RelType("MEMBER_OF", ("Person",), ("Organization", "Channel")),
        RelType("AUTHORED", ("Person",), ("Document", "Message", "Issue", "Task")),
        RelType("MENTIONED_IN", ("Person", "Project", "Document", "Task", "Issue"), ("Document", "Message")),
        RelType("REFERENCES", ("Decision", "Document"), ("Document", "Message", "Issue", "Task")),
        RelType("PART_OF", ("Task", "Issue", "Document", "Message"), ("Project", "Repository")),
        RelType("OWNS", ("Person", "Organization"), ("Project", "Repository", "Document")),
        RelType("ASSIGNED_TO", ("Task", "Issue"), ("Person",)),
        RelType("DISCUSSED_IN", ("Project", "Task", "Decision"), ("Channel", "Message")),
        RelType("RELATED_TO"),
        RelType("DEPENDS_ON", ("Task", "Issue"), ("Task", "Issue")),
        RelType("CONTRADICTS", ("Decision", "Document", "Message"), ("Decision", "Document", "Message")),
        RelType("SUPERSEDES", ("Decision", "Document"), ("Decision", "Document")),
    ),
)


def out_of_schema(edges: DataFrame, schema: GraphSchema) -> DataFrame:
    """rel_type, src_label, dst_label, n of edges whose type or ends the schema does not have; nothing is enforced."""
    rows = [(t.name, s, d) for t in schema.rel_types for s in t.sources for d in t.targets]
    known = edges.sparkSession.createDataFrame(rows, "rel_type string, s string, d string")
    fits = (F.col("e.rel_type") == F.col("k.rel_type")) & ((F.col("s") == "*") | (F.col("s") == F.col("src_label"))) & ((F.col("d") == "*") | (F.col("d") == F.col("dst_label")))
    return edges.alias("e").join(F.broadcast(known).alias("k"), fits, "left_anti").groupBy("rel_type", "src_label", "dst_label").agg(F.count("*").alias("n"))
