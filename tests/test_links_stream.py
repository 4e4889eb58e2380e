"""Links kept up to date by a stream, in batches and over a stop, against resolving all documents at once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import references
from quillgraph.sources import adapters
from quillgraph.streaming import links, phases


@pytest.fixture
def spark(spark):
    """A state for each of two partitions is enough here."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", n)


def test_links_follow_documents(spark, tmp_path):
    rnd = random.Random(2)
    token = lambda: f"key-{rnd.randrange(30)}"
    cited = [(src, pos, token()) for src in range(60) for pos in range(rnd.randint(0, 6))]
    declared = [(token(), dst) for dst in range(50, 85)]
    c, d = spark.createDataFrame(cited, "src long, pos int, token string"), spark.createDataFrame(declared, "token string, dst long")
    batch = lambda doc: F.pmod(F.xxhash64(doc), F.lit(5))
    every = links.tokens(c, d).withColumn("n", batch("doc")).cache()
    source, changes, state = (str(tmp_path / x) for x in ("tokens", "changes", "state"))
    lasts = []
    for n in range(5):  # five batches, and each time a new query that goes on from the checkpoint, as after a kill
        every.where(F.col("n") == n).drop("n").write.mode("append").parquet(source)
        stream = spark.readStream.schema(links.TOKEN).parquet(source)
        links.maintain(stream, changes, state, 2, parts=3).awaitTermination()
        seen = [df.where(batch(who) <= n) for df, who in ((c, "src"), (d, "dst"))]
        want = {tuple(r) for r in references.resolve_links(*seen, most_declarers=2, most_citations=9).collect()}
        assert {tuple(r) for r in links.current(spark, changes, 9).collect()} == want
        lasts.append(want)
    assert any(a - b for a, b in zip(lasts, lasts[1:])) and lasts[-1]


def test_phases_survive_a_stop(spark, tmp_path, monkeypatch):
    """Documents in five batches, with a failure between two, give the graph and the links of one batch."""
    rnd = random.Random(5)
    for i in range(15):
        doc = {"dataset_doc_uuid": f"d{i}", "key": f"TASK-{i % 11}", "project": f"P{i % 3}", "summary": f"s{i}", "description": f"b{i}", "reporter": rnd.choice(["Ann Lee", "Bo Ray"]), "labels": [f"TASK-{rnd.randrange(14)}" for _ in range(3)], "customer_company": "Acme"}
        (tmp_path / "raw/jira").mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw/jira" / f"{i:02d}.json").write_text(json.dumps(doc))
    raw, whole, parts = (str(tmp_path / x) for x in ("raw", "whole", "parts"))

    def rows(graph):
        return {(r.id, r.label, r.primary_text) for r in graph.nodes.collect()}, {(r.id, r.rel_type, r.src, r.dst) for r in graph.edges.collect()}

    want = rows(phases.ingest(spark, raw, whole, "all", files_per_batch=100))
    real, calls = adapters.graph_rows, []

    def failing(docs, *more):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("an executor was lost")
        return real(docs, *more)

    monkeypatch.setattr(adapters, "graph_rows", failing)
    with pytest.raises(Exception, match="lost"):
        phases.ingest(spark, raw, parts, "all", files_per_batch=3)
    assert phases.reached(spark, parts, "all") is None
    got = rows(phases.ingest(spark, raw, parts, "all", files_per_batch=3))
    assert len(calls) == 6 and phases.reached(spark, parts, "all") == "done"
    assert got == want and sum(e[1] == "REFERENCES" for e in got[1]) > 20
    assert rows(phases.ingest(spark, raw, parts, "all", files_per_batch=3)) == want and len(calls) == 6  # nothing is done again
