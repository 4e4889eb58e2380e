"""Sources, adapters, streaming, batching and the question pipeline on small inputs with hand-derived results."""

import json

from pyspark.sql import functions as F

from quillgraph.graph import EDGE, NODE, Graph
from quillgraph.operators import writes
from quillgraph.plans import answer, models
from quillgraph.schema import DEFAULT
from quillgraph.sources import adapters, files
from quillgraph.streaming import incremental

RAW = {
    "slack/support/1.json": {"dataset_doc_uuid": "s1", "channel": "support", "thread_ts": "17", "participants": ["Ann Lee", " "], "text": "Ann: the probe is down", "content_field_names": ["text"]},
    "jira/ops/K-1.json": {"dataset_doc_uuid": "j1", "key": "K-1", "project": "Probe", "summary": "Fix probe", "description": ["one", "two"], "reporter": "Ann Lee", "assignee": "Bo Ray", "labels": ["x"], "customer_company": "Acme", "status": "open"},
    "github/7.json": {"repo": "probe", "pr_number": "7", "title": "Patch", "author": "Bo Ray", "reviewers": [], "content_field_names": ["body", "release_notes"], "body": "B", "release_notes": "N"},
    "unknown/x.json": {"dataset_doc_uuid": "u1"},
    "jira/bad.json": None,
}


def folder(tmp_path):
    for name, doc in RAW.items():
        p = tmp_path / "raw" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("[1, 2" if doc is None else json.dumps(doc))
    return str(tmp_path / "raw")


def test_adapters(spark, tmp_path):
    raw = files.raw_documents(spark, folder(tmp_path))
    assert {(r.dsid, r.source_type) for r in raw.collect()} == {("s1", "slack"), ("j1", "jira"), ("github/7.json", "github"), ("u1", "unknown")}
    docs = {r.dsid: r for r in adapters.normalise(raw).collect()}
    assert set(docs) == {"s1", "j1", "github/7.json"}
    assert docs["s1"].primary_text == docs["s1"].body == "Ann: the probe is down" and docs["s1"].channel == "support" and [p.name for p in docs["s1"].people] == ["Ann Lee"]
    assert docs["j1"].body == "one\ntwo" and docs["j1"].company == "Acme" and docs["j1"].keys == ["j1", "K-1"] and docs["j1"].links == ["x"]
    assert [(p.name, p.relation) for p in docs["j1"].people] == [("Ann Lee", "AUTHORED"), ("Bo Ray", "ASSIGNED_TO")]
    assert docs["github/7.json"].body == "Body:\nB\n\nRelease Notes:\nN" and docs["github/7.json"].project == "probe"

    g = adapters.graph_rows(adapters.normalise(raw))
    assert {r.label: r.n for r in g.label_counts().collect()} == {"Message": 1, "Task": 1, "Issue": 1, "Person": 2, "Organization": 2, "Project": 2, "Channel": 1}
    assert {r.rel_type: r.n for r in g.rel_type_counts().collect()} == {"AUTHORED": 3, "ASSIGNED_TO": 1, "MEMBER_OF": 2, "PART_OF": 2, "DISCUSSED_IN": 1, "REFERENCES": 1}
    ids = {r.id for r in g.nodes.collect()}
    assert len(ids) == g.nodes.count() and all(r.src in ids and r.dst in ids for r in g.edges.collect())


#: One document of each source that the folder above lacks, and what it becomes.
SOURCES = {
    "confluence": (
        {"title": "Plan", "space": "ENG", "owner_team": "Core", "author": "ann_lee", "reviewers": ["Bo Ray", ""], "body": "text", "related_pages": ["P-1"], "labels": ["a", "b"], "created_at": "2026-01-01"},
        ("Document", "Plan", "text", [("Ann Lee", "AUTHORED"), ("Bo Ray", "AUTHORED")], "ENG", None, ["d"], ["P-1", "a", "b"]),
        {"title": "Plan", "url": "confluence://ENG", "content": "text", "created_at": "2026-01-01", "updated_at": ""},
    ),
    "google_drive": (
        {"title": "Sheet", "owner": "Ann Lee", "collaborators": ["cy_oh"], "team": "Core", "content": ["one", "two"], "original_location": "drive/x", "path": "", "last_modified": "2026-02-02", "tags": "loose", "linked_artifacts": ["L-1"]},
        ("Document", "Sheet", "one\ntwo", [("Ann Lee", "AUTHORED"), ("Cy Oh", "AUTHORED")], "Core", None, ["d"], ["L-1"]),
        {"title": "Sheet", "url": "drive/x", "content": "one\ntwo", "created_at": "", "updated_at": "2026-02-02"},
    ),
    "fireflies": (
        {"title": "Call", "meeting_id": "m1", "recorded_at": "2026-03-03", "redwood_owner": "Ann Lee", "redwood_attendees": ["Bo Ray"], "customer_company": "Acme", "topics": ["t"], "competitors_mentioned": ["c"], "summary": "S", "action_items": ["x", "y"]},
        ("Document", "Call", "Summary:\nS\n\nAction Items:\nx\ny", [("Ann Lee", "AUTHORED"), ("Bo Ray", "AUTHORED")], None, "Acme", ["d", "m1"], ["t", "c"]),
        {"title": "Call", "url": "m1", "content": "Summary:\nS\n\nAction Items:\nx\ny", "created_at": "2026-03-03", "updated_at": "2026-03-03"},
    ),
    "gmail": (
        {"subject": "Hello", "thread_id": "t1", "deal_id": "D-9", "mailbox_owner": "bo_ray", "participants_internal": [], "related_account": "Acme", "related_links": ["http://x"], "first_email_at": "2026-04-04"},
        ("Message", "Hello", "Hello", [("Bo Ray", "AUTHORED")], None, "Acme", ["d", "t1", "D-9"], ["http://x"]),
        {"text": "Hello", "sent_at": "2026-04-04", "thread_id": "t1"},
    ),
    "linear": (
        {"key": "L-2", "title": "Fix", "description": "do it", "creator": "Ann Lee", "assignee": "Bo Ray", "project": "Core", "labels": ["bug"], "status": "done", "created_at": "2026-05-05"},
        ("Task", "Fix", "do it", [("Ann Lee", "AUTHORED"), ("Bo Ray", "ASSIGNED_TO")], "Core", None, ["d", "L-2"], ["bug"]),
        {"title": "Fix", "description": "do it", "status": "done", "created_at": "2026-05-05"},
    ),
    "hubspot": (
        {"company_id": "c7", "company_name": "Acme", "company_domain": "acme.example", "owner": "Ann Lee", "se_assigned": "Bo Ray", "next_step": "call", "blockers": ["price", "time"], "linked_fireflies": ["m1"], "linked_support_tickets": ["S-1"], "updated_at": "2026-06-06"},
        ("Document", "Acme", "Next Step:\ncall\n\nBlockers:\nprice\ntime", [("Ann Lee", "AUTHORED"), ("Bo Ray", "ASSIGNED_TO")], None, "Acme", ["d", "c7"], ["m1", "S-1"]),
        {"title": "Acme", "url": "acme.example", "content": "Next Step:\ncall\n\nBlockers:\nprice\ntime", "created_at": "", "updated_at": "2026-06-06"},
    ),
}


def test_every_source(spark):
    plain = lambda v: v if isinstance(v, str) else json.dumps(v)  # noqa: E731  # as raw_documents has them
    raw = spark.createDataFrame([("d", s, {k: plain(v) for k, v in doc.items()}) for s, (doc, _, _) in SOURCES.items()], "dsid string, source_type string, raw map<string,string>")
    got = {r.source_type: r for r in adapters.normalise(raw).collect()}
    assert set(got) == set(SOURCES)
    for s, (_, want, props) in SOURCES.items():
        r = got[s]
        assert (r.label, r.primary_text, r.body, [(p.name, p.relation) for p in r.people], r.project, r.company, r.keys, r.links) == want, s
        assert r.properties == props | {"source": s, "dsid": "d"} and r.channel is None, s


def test_queue_and_storage(spark, tmp_path):
    g = adapters.graph_rows(adapters.normalise(files.raw_documents(spark, folder(tmp_path))))
    nodes, bodies = writes.split_bodies(g.nodes)
    queue = adapters.embed_queue(Graph(nodes, g.edges), bodies)
    assert queue.count() == g.nodes.count()
    vectors = models.embed(queue, models.HashingEmbedder(16))
    assert all(len(r.embedding) == 16 for r in vectors.collect())
    g.save(str(tmp_path / "graph"))
    again = Graph.load(spark, str(tmp_path / "graph"))
    assert sorted(r.id for r in again.nodes.collect()) == sorted(r.id for r in g.nodes.collect()) and again.edges.count() == g.edges.count()


def test_question_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id":"a","question":"Who?"}\n{"question":"no id"}\n')
    (tmp_path / "a.jsonl").write_text('{"question_id":"a","answer":"old"}\n\n{"question_id":"a","answer":"new","document_ids":["d"]}\n{"question_id":"b","answer":"x"}\n')
    assert [r.question_id for r in files.questions(spark, str(tmp_path / "q.jsonl")).collect()] == ["a"]
    assert {r.question_id: r.answer for r in files.answers(spark, str(tmp_path / "a.jsonl")).collect()} == {"a": "new", "b": "x"}


def small_graph(spark):
    """A project, its owner, and two policies of which the second replaces the first."""
    nodes = [
        (1, "Person", "Sam Ode", {"name": "Sam Ode"}), (10, "Project", "Orion", {"name": "Orion"}),
        (41, "Document", "New travel policy", {"dsid": "d41", "created_at": "2026-02-01"}), (42, "Document", "Old travel policy", {"dsid": "d42", "created_at": "2026-01-01"}),
    ]
    edges = [(1, "WORKS_ON", 1, "Person", 10, "Project", {}), (2, "PART_OF", 41, "Document", 10, "Project", {}), (3, "PART_OF", 42, "Document", 10, "Project", {}), (4, "SUPERSEDES", 41, "Document", 42, "Document", {})]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def test_answer(spark):
    g = small_graph(spark)
    bodies = spark.createDataFrame([(41, "Trips need approval by Sam"), (42, "Trips need no approval")], "id bigint, text string")
    embedder = models.HashingEmbedder(64)
    vectors = models.embed(adapters.embed_queue(g, bodies), embedder)
    got = answer.answer(g, "What is the travel policy of Orion?", vectors, bodies, embedder, floor=0.1)
    assert got.found and "travel policy" in got.text
    nodes = {r.id: r for r in got.nodes.collect()}
    assert set(nodes) == {1, 10, 41, 42} and nodes[10].role == "resolved" and nodes[41].role == nodes[42].role == "conflict"
    fight = got.conflicts.collect()
    assert len(fight) == 1 and fight[0].winner == 41
    assert {i for _, ids in got.claims for i in ids} <= set(nodes)
    assert {(r.src, r.rel_type, r.dst) for r in got.edges.collect()} == {(1, "WORKS_ON", 10), (41, "PART_OF", 10), (42, "PART_OF", 10), (41, "SUPERSEDES", 42)}


def test_plan_of_a_question():
    plan = models.plan_question("Who owned Orion before Sam Ode?", DEFAULT)
    assert plan.mentions == ["Who", "Orion", "Sam Ode"] and plan.kind == "temporal" and plan.focus == ["OWNS"]
    assert models.plan_question("Does it contradict the plan?", DEFAULT).kind == "conflict" and models.plan_question("What is it?", DEFAULT) == models.Plan(["What"], "lookup", [])


def test_answer_walks_the_types_of_the_question(spark):
    """Only the asked type and the schema's conflict types are walked."""
    g = small_graph(spark)
    bodies = spark.createDataFrame([(41, "Trips need approval by Sam")], "id bigint, text string")
    embedder = models.HashingEmbedder(64)
    vectors = models.embed(adapters.embed_queue(g, bodies), embedder)
    got = answer.answer(g, "On which project does Sam Ode works?", vectors, bodies, embedder, floor=0.99, schema=DEFAULT)
    assert {(r.src, r.rel_type, r.dst) for r in got.edges.collect()} == {(1, "WORKS_ON", 10)} and {r.id for r in got.nodes.collect()} == {1, 10}


def test_reports_and_bodies(spark, tmp_path):
    bodies = spark.createDataFrame([(1, "short"), (1, "the longer one"), (2, "b")], "id bigint, text string")
    files.write_bodies(bodies, str(tmp_path / "bodies"))
    assert {(r.id, r.text) for r in spark.read.parquet(str(tmp_path / "bodies")).collect()} == {(1, "the longer one"), (2, "b")}
    for n in (3, 2):  # the second replaces the first
        files.write_report(spark.range(n).select("id", F.lit(None).cast("string").alias("none")), str(tmp_path / "report"))
    lines = [json.loads(x) for p in (tmp_path / "report").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [0, 1] and all("none" in x for x in lines)
    nodes = spark.createDataFrame([(1, "A", "", {"x": "123456"}), (2, "A", "", {}), (3, "B", "", {"x": "1"})], NODE)
    assert {(r.label, r.n) for r in writes.property_counts(nodes, "x").collect()} == {("A", 1), ("B", 1)}
    assert {r.properties.get("x") for r in writes.truncate_properties(nodes, 2).collect()} == {"12… [truncated 4 chars]", None, "1"}
    assert "- OWNS: Person|Organization -> Project|Repository|Document" in DEFAULT.describe()


def test_incremental(spark, tmp_path):
    source, done, state = (str(tmp_path / x) for x in ("in", "done", "state"))
    put = lambda name, *ids: (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "text": f"t{i}"}) + "\n" for i in ids))
    (tmp_path / "in").mkdir()
    double = lambda df: df.select("id", (F.col("id") * 2).alias("twice"))
    put("a.json", 1, 2, 2)
    incremental.append_new(spark, source, "id bigint, text string", done, double, state).awaitTermination()
    put("b.json", 2, 3)  # 2 is done
    incremental.append_new(spark, source, "id bigint, text string", done, double, state).awaitTermination()
    incremental.append_new(spark, source, "id bigint, text string", done, double, str(tmp_path / "fresh")).awaitTermination()  # all files again: nothing is new
    assert sorted((r.id, r.twice) for r in spark.read.parquet(done).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_windows_as_stream(spark, tmp_path):
    """As a stream the closed windows equal those of the batch."""
    rows = [(f"2026-01-01 00:{m:02d}:00", u, "view", 1.0) for m, u in ((1, 1), (2, 1), (7, 2), (59, 1))]
    events = spark.createDataFrame(rows, "t string, user_id bigint, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, make, closed in (("w", lambda e: incremental.windowed_counts(e, "5 minutes"), 2), ("s", lambda e: incremental.session_counts(e, "5 minutes"), 2)):
        q = make(stream).writeStream.format("memory").queryName(f"stream_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got, whole = spark.table(f"stream_{name}").collect(), make(events).collect()
        assert len(got) == closed and len(whole) == 3 and set(got) < set(whole)


def test_batches(spark):
    sizes = [5, 4, 3, 20, 1, 1]
    rows = spark.createDataFrame([(p, i, b) for p in (0, 1) for i, b in enumerate(sizes)], "part int, ord int, bytes bigint")
    got = writes.size_batches(rows, most_bytes=10, most_rows=2).collect()
    for p in (0, 1):
        mine = sorted((r.ord, r.batch) for r in got if r.part == p)
        runs = [[sizes[o] for o, b in mine if b == x] for x in dict.fromkeys(b for _, b in mine)]
        assert runs == [[5, 4], [3], [20], [1, 1]]
    assert sorted(r.chunk for r in writes.chunks(rows, "part", "ord", 4).where("part = 0").collect()) == [0, 0, 0, 0, 1, 1]
