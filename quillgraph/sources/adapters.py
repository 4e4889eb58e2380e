"""Adapters: each source's fields, in one table, to normalised documents and then to graph rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import embedding_text, person_name, stable_id
from ..graph import Graph, cut

ROOT = "root"


@dataclass(frozen=True)
class Adapter:
    label: str
    text: str
    body: str
    fallbacks: tuple[str, ...]
    authored: tuple[str, ...] = ()
    assigned: tuple[str, ...] = ()
    project: tuple[str, ...] = ()
    channel: str | None = None
    company: str | None = None
    keys: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)
    url: tuple[str, ...] = ()
    scheme: str = ""


#: The fields of each source that carry meaning.
ADAPTERS = {
    "confluence": Adapter("Document", "title", "content", ("body",), ("author", "reviewers"), project=("space", "owner_team"), links=("related_pages", "labels"), properties={"created_at": "created_at", "updated_at": "last_updated"}, url=("space",), scheme="confluence://"),
    "google_drive": Adapter("Document", "title", "content", ("content",), ("owner", "collaborators"), project=("team",), links=("linked_artifacts", "tags"), properties={"created_at": "created_at", "updated_at": "last_modified"}, url=("path", "original_location")),
    "fireflies": Adapter("Document", "title", "content", ("summary", "next_steps", "action_items"), ("redwood_owner", "redwood_attendees"), company="customer_company", keys=("meeting_id",), links=("topics", "competitors_mentioned"), properties={"created_at": "recorded_at", "updated_at": "recorded_at"}, url=("meeting_id",)),
    "gmail": Adapter("Message", "subject", "text", ("messages",), ("mailbox_owner", "participants_internal"), company="related_account", keys=("thread_id", "deal_id"), links=("related_links",), properties={"sent_at": "first_email_at", "thread_id": "thread_id"}),
    "slack": Adapter("Message", "text", "text", ("text",), ("participants",), channel="channel", keys=("thread_ts",), properties={"sent_at": "first_message_ts", "thread_id": "thread_ts"}),
    "jira": Adapter("Task", "summary", "description", ("description",), ("reporter",), ("assignee",), ("project",), company="customer_company", keys=("key",), links=("linked_issues", "labels", "components"), properties={"status": "status", "created_at": "created_at"}),
    "linear": Adapter("Task", "title", "description", ("description",), ("creator",), ("assignee",), ("project",), keys=("key",), links=("labels",), properties={"status": "status", "created_at": "created_at"}),
    "github": Adapter("Issue", "title", "body", ("body", "release_notes"), ("author", "reviewers"), project=("repo",), keys=("pr_number",), links=("linked_linear", "labels"), properties={"status": "state", "created_at": "created_at"}),
    "hubspot": Adapter("Document", "company_name", "content", ("next_step", "blockers"), ("owner",), ("se_assigned",), company="company_name", keys=("company_id",), links=("linked_fireflies", "linked_gmail_threads", "linked_support_tickets"), properties={"created_at": "created_at", "updated_at": "updated_at"}, url=("company_domain",)),
}


def _get(name: str) -> Column:
    return F.try_element_at("raw", F.lit(name))


def _text(c: Column) -> Column:
    """A string, or the strings of a list on lines; anything else is empty."""
    listed = F.from_json(c, "array<string>")
    return F.coalesce(F.when(c.startswith("["), F.array_join(listed, "\n")).otherwise(c), F.lit(""))


def _list(name: str, single: bool = False) -> Column:
    """The strings of a list without blank ones; a plain string is a list of itself for `single` fields, else none."""
    none = F.array().cast("array<string>")
    c = _get(name)
    whole = F.when(c.startswith("["), F.from_json(c, "array<string>")).when(F.lit(single), F.array(c))
    return F.filter(F.transform(F.coalesce(whole, none), lambda x: F.trim(x)), lambda x: x != "")


def _people(name: str, relation: str) -> Column:
    return F.transform(_list(name, single=True), lambda n: F.struct(person_name(n).alias("name"), F.lit(relation).alias("relation")))


def body(fallbacks: tuple[str, ...]) -> Column:
    """The declared content fields that hold text, else the fallbacks; of several fields each gets its name as a title."""
    declared = F.from_json(_get("content_field_names"), "array<string>")
    names = F.when(F.size(declared) > 0, declared).otherwise(F.array(*[F.lit(x) for x in fallbacks]))
    parts = F.filter(F.transform(names, lambda n: F.struct(n.alias("n"), _text(F.try_element_at("raw", n)).alias("t"))), lambda p: F.trim(p["t"]) != "")
    title = lambda n: F.array_join(F.transform(F.filter(F.split(n, r"[_\s]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")
    return F.array_join(F.transform(parts, lambda p: F.when(F.size(names) > 1, F.concat(title(p["n"]), F.lit(":\n"), p["t"])).otherwise(p["t"])), "\n\n")


def normalise(raw: DataFrame) -> DataFrame:
    """dsid, source_type, label, primary_text, body, properties, people, project, channel, company, keys, links.

    Rows of sources without an adapter go. Properties that a source has are always there, empty where the field is
    missing. A mail without a body has its subject as text.
    """
    source = F.col("source_type")
    forms = [F.when(source == name, _normal(name, a)) for name, a in ADAPTERS.items()]  # one pass over all sources
    return raw.where(source.isin(list(ADAPTERS))).select("dsid", "source_type", F.coalesce(*forms).alias("d")).select("dsid", "source_type", "d.*")


def _normal(source: str, a: Adapter) -> Column:
    """What one source's document becomes, as a struct."""
    b = body(a.fallbacks)
    if source == "gmail":
        b = F.coalesce(F.nullif(b, F.lit("")), _get("subject"), F.lit(""))
    people = F.concat(*[_people(f, r) for r, fs in (("AUTHORED", a.authored), ("ASSIGNED_TO", a.assigned)) for f in fs])
    one = lambda f: F.nullif(F.trim(_get(f)), F.lit("")) if f else F.lit(None).cast("string")
    project = F.coalesce(*[one(x) for x in a.project]) if a.project else one(None)
    values = {**{k: _get(f) for k, f in a.properties.items()}, "source": F.lit(source), "dsid": F.col("dsid"), a.body: b}
    if a.label != "Message":
        values["title"] = _get(a.text)
    if a.url:
        values["url"] = F.concat(F.lit(a.scheme), F.coalesce(*[F.nullif(_get(f), F.lit("")) for f in a.url], F.lit("")))
    props = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    text = F.substring(b, 1, 140) if source == "slack" else F.coalesce(_get(a.text), F.lit(""))
    return F.struct(
        F.lit(a.label).alias("label"), text.alias("primary_text"), b.alias("body"), props.alias("properties"), people.alias("people"), project.alias("project"), one(a.channel).alias("channel"), one(a.company).alias("company"),
        F.array_compact(F.array(F.col("dsid"), *[one(k) for k in a.keys])).alias("keys"), F.concat(*[_list(x) for x in a.links], F.array().cast("array<string>")).alias("links"),
    )


def graph_rows(docs: DataFrame, organisation: str = "Home") -> Graph:
    """Nodes of documents, people, projects, channels, companies and the root, and their edges, all with stable ids.

    Documents are written once in the shared folder, since every kind of node and edge reads them.
    """
    spark = docs.sparkSession
    d = cut(docs.select(stable_id("doc", "dsid").alias("id"), "label", "primary_text", "properties", "people", "project", "channel", "company"))

    def node(df: DataFrame, kind: str, label: str, key: str) -> DataFrame:
        props = F.create_map(F.lit("name"), F.col(key))
        return df.select(key).distinct().select(stable_id(kind, key).alias("id"), F.lit(label).alias("label"), F.col(key).alias("primary_text"), props.alias("properties"))

    people = d.select("id", "label", F.explode("people").alias("p")).select("id", "label", F.col("p.name").alias("name"), F.col("p.relation").alias("relation"))
    persons = node(people, "person", "Person", "name")
    root = spark.range(1).select(stable_id("org", F.lit(ROOT)).alias("id"), F.lit("Organization").alias("label"), F.lit(organisation).alias("primary_text"), F.create_map(F.lit("name"), F.lit(organisation), F.lit("kind"), F.lit("internal")).alias("properties"))
    parts = [d.select("id", "label", "primary_text", "properties"), persons, root]
    for kind, label, key in (("project", "Project", "project"), ("channel", "Channel", "channel"), ("organization", "Organization", "company")):
        parts.append(node(d.where(F.col(key).isNotNull()), kind, label, key))
    empty = F.create_map().cast("map<string,string>")

    def edge(df: DataFrame, kind: str, src: Column, sl: Column | str, dst: Column, dl: Column | str) -> DataFrame:
        sl, dl = (F.lit(x) if isinstance(x, str) else x for x in (sl, dl))
        key = F.concat_ws("-", src.cast("string"), dst.cast("string"))
        return df.select(stable_id(kind.lower(), key).alias("id"), F.lit(kind).alias("rel_type"), src.alias("src"), sl.alias("src_label"), dst.alias("dst"), dl.alias("dst_label"), empty.alias("properties")).dropDuplicates(["id"])

    pid, label = stable_id("person", "name"), F.col("label")
    edges = [
        edge(people.where("relation = 'AUTHORED'"), "AUTHORED", pid, "Person", F.col("id"), label),
        edge(people.where("relation = 'ASSIGNED_TO'"), "ASSIGNED_TO", F.col("id"), label, pid, "Person"),
        edge(persons, "MEMBER_OF", F.col("id"), "Person", stable_id("org", F.lit(ROOT)), "Organization"),
        edge(d.where("project is not null"), "PART_OF", F.col("id"), label, stable_id("project", "project"), "Project"),
        edge(d.where("channel is not null"), "DISCUSSED_IN", F.col("id"), label, stable_id("channel", "channel"), "Channel"),
        edge(d.where("company is not null"), "REFERENCES", F.col("id"), label, stable_id("organization", "company"), "Organization"),
    ]
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union(dfs[:-1]).unionByName(dfs[-1])
    return Graph(union(parts), union(edges))


def embed_queue(graph: Graph, bodies: DataFrame) -> DataFrame:
    """id, label, primary_text, text: what is embedded of each node, its own text and body."""
    rows = graph.nodes.join(bodies.select("id", F.col("text").alias("body")), "id", "left")
    return rows.select("id", "label", "primary_text", embedding_text("primary_text", "body").alias("text"))

