"""Operators whose work has to stay bounded on skewed or large input: results against brute force, and what they read or make."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.graph import EDGE, NODE, Graph
from quillgraph.operators import conflicts, evaluation, names, ranking, traversal
from quillgraph.sources import tables


def test_held_at_equals_brute_force(spark):
    rnd = random.Random(1)
    t = lambda: f"2026-{rnd.randrange(1, 13):02d}"
    intervals = [(rnd.choice([1, 1, 1, 2, 3, None]), i, rnd.choice([t(), t(), t(), t(), None, ""]), rnd.choice([t(), t(), "", None])) for i in range(300)]
    asked = [(rnd.choice([1, 1, 2, 9, None]), rnd.choice([t(), t(), t(), None])) for _ in range(120)]
    want = sorted((k, x, o) for k, x in asked for key, o, a, b in intervals if None not in (k, x, a) and key == k and a <= x and (not b or x <= b))
    i = spark.createDataFrame(intervals, "key long, owner long, valid_from string, valid_to string")
    q = spark.createDataFrame(asked, "key long, t string")
    for block in (1, 7, 64):
        assert sorted(tuple(r) for r in conflicts.held_at(i, q, block).collect()) == want
    assert conflicts.held_at(i.limit(0), q).count() == conflicts.held_at(i, q.limit(0)).count() == 0


def test_held_at_of_one_hot_key(spark):
    """100,000 short intervals and 100,000 questions of one key: no product, and few rows beyond those that are returned."""
    n = 100_000
    day = lambda c: F.lpad(c.cast("string"), 7, "0")
    i = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("owner"), day(F.col("id") * 3).alias("valid_from"), day(F.col("id") * 3 + 2).alias("valid_to"))
    q = spark.range(n).select(F.lit(1).alias("key"), day(F.col("id") * 3 + 1).alias("t"))
    near = conflicts._near(i, q, 16).cache()
    assert near.where("first <= n and n < last").count() == n and near.count() <= 17 * n


def random_graph(spark, rnd, nodes=14, edges=60):
    e = [(100 + i, rnd.choice(["A", "B"]), rnd.randrange(nodes), "N", rnd.randrange(nodes), "N", {}) for i in range(edges)]
    return e, Graph(spark.createDataFrame([(i, "N", f"n{i}", {}) for i in range(nodes)], NODE), spark.createDataFrame(e, EDGE))


def walks(edges, starts, target, most, direction):
    step = defaultdict(list)
    for i, _, s, _, d, _, _ in edges:
        if direction != "incoming":
            step[s].append((d, i))
        if direction != "outgoing":
            step[d].append((s, i))
    now, out = [((s,), ()) for s in starts], []
    for hops in range(1, most + 1):
        now = [((*p, d), (*e, i)) for p, e in now for d, i in step[p[-1]] if i not in e]
        out += [(hops, p, e) for p, e in now if p[-1] == target]
    return sorted(out)


@pytest.mark.parametrize("direction,count", [("outgoing", 40), ("both", 7), ("both", 300), ("incoming", 5)])
def test_shortest_paths_equal_brute_force(spark, direction, count):
    rnd = random.Random(count)
    edges, g = random_graph(spark, rnd)
    seeds = spark.createDataFrame([(0,), (1,), (1,)], "id bigint")
    got = traversal.shortest_paths(g, seeds, 5, ["A", "B"], direction, 4, count).collect()
    want = walks(edges, [0, 1], 5, 4, direction)
    assert want and [(r.hops, tuple(r.nodes), tuple(r.edges)) for r in got] == want[:count]
    assert traversal.shortest_paths(g, seeds, 999, ["A", "B"], direction).count() == 0


def test_shortest_paths_hold_no_more_than_the_nodes(spark, monkeypatch):
    """Ten layers of 20 nodes, all joined: 20^4 paths of five hops, of which the tables between hold nodes and a few paths."""
    ids = lambda layer: range(layer * 20, layer * 20 + (20 if layer else 1))
    pairs = [(a, b) for layer in range(4) for a in ids(layer) for b in ids(layer + 1)] + [(a, 1000) for a in ids(4)]
    e = [(i, "A", a, "N", b, "N", {}) for i, (a, b) in enumerate(pairs)]
    g = Graph(spark.createDataFrame([(i, "N", "", {}) for i in range(120)], NODE), spark.createDataFrame(e, EDGE))
    made, real = [], traversal.cut
    monkeypatch.setattr(traversal, "cut", lambda df: made.append(real(df)) or made[-1])
    got = traversal.shortest_paths(g, spark.createDataFrame([(0,)], "id bigint"), 1000, ["A"], most=5, count=5).collect()
    assert [r.nodes for r in got] == [[0, 20, 40, 60, 80 + i, 1000] for i in range(5)]
    assert max(df.count() for df in made) <= 6 * 20


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_layers_equal_brute_force(spark, rounds):
    """Cycles, equal edges, ends that are no nodes and roots that are there twice; an id that two nodes share has one row."""
    rnd = random.Random(rounds)
    edges, g = random_graph(spark, rnd, edges=16)
    edges += [(900, "A", 0, "N", 77, "N", {}), (901, "A", 77, "N", 13, "N", {}), (902, "A", None, "N", 1, "N", {}), (903, "A", 0, "N", None, "N", {}), edges[0]]
    nodes = g.nodes.unionByName(spark.createDataFrame([(3, "M", "", {}), (0, "M", "", {}), (None, "M", "", {})], NODE))
    want = {i: 0 for i in [*range(14), None]}
    for hops in range(1, rounds + 1):
        for target in range(14):
            if steps_to(edges, [0, 1], target, hops):
                want[target] = hops
    found = traversal.layers(nodes, spark.createDataFrame(edges, EDGE), spark.createDataFrame([(0,), (1,), (1,), (None,)], "id bigint"), rounds).collect()
    assert sorted(((r.id, r.layer) for r in found), key=str) == sorted(want.items(), key=str) and max(want.values()) >= min(rounds, 2)


def steps_to(edges, starts, target, hops):
    """Whether a walk of so many steps, edges repeated or not, leads from a start to the target."""
    now = set(starts)
    for _ in range(hops):
        now = {e[4] for e in edges if e[2] in now and e[2] is not None and e[4] is not None}
    return target in now


def test_names_equal_comparing_all(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abÄß#0") for _ in range(rnd.choice([1, 2, 3, 5, 7, 9, 11, 18, 40, 70])))
    words = [word() for _ in range(60)]
    words += [w[: rnd.randint(1, len(w))] for w in words for _ in range(2)]
    text = lambda: rnd.choice([None, "", " ", *[" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))] * 12])
    nodes = spark.createDataFrame([(i, "x", text(), {}) for i in range(200)], NODE)
    asked = spark.createDataFrame([(text(),) for _ in range(80)], "mention string").distinct()
    from quillgraph.functions.scalar import token_overlap

    every = nodes.select("id", "label", F.col("primary_text").alias("text")).crossJoin(asked).where(token_overlap("mention", "text"))
    want = {(r.mention, r.id) for r in every.collect()}
    for most in (1000, 3):
        found = names.lookup(names.index(nodes), asked, most)
        assert len(want) > 500 and {(r.mention, r.id) for r in found.collect()} == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_stored_names_are_pruned(spark):
    stored = tables.stored_names(spark, "/root/testdata/sf0.001")
    found = names.lookup(stored, spark.createDataFrame([("Customer#000000007 x",)], "mention string"))
    assert {r.text for r in found.collect()} == {"Customer#000000007"} and "PushedFilters: [In(key" in found._jdf.queryExecution().toString()


def test_search_many(spark):
    """Blocks of any size give what comparing all gives: ties by id, zero vectors and other dimensions score 0."""
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [0.0] * 8) for i in range(3)] + [(2000, [1.0] * 5)]
    rows += [(3000 + i, rows[7][1]) for i in range(9)]
    asked = [(f"q{i}", rnd.normal(size=8).tolist()) for i in range(20)] + [("zero", [0.0] * 8), ("other", [1.0] * 5), ("same", rows[7][1])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame(asked, "question_id string, embedding array<float>")

    def score(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        n = np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else 0
        return round(a @ b / n, 12) if n else 0.0

    want = {(name, r + 1, i) for name, x in asked for r, (s, i) in enumerate(sorted((-score(x, y), i) for i, y in rows)[:6])}
    for sizes in ((8192, 1024), (40, 7)):
        got = ranking.search_many(v, q, 6, rows=sizes[0], asked=sizes[1]).collect()
        assert {(r.question_id, r["rank"], r.id) for r in got} == want
    assert ranking.search_many(v.limit(0), q, 6).count() == ranking.search_many(v, q.limit(0), 6).count() == 0


def test_stored_vectors_are_pruned(spark):
    v = tables.stored_vectors(spark, "/root/testdata/sf0.001")
    plain = tables.table(spark, "/root/testdata/sf0.001", "embeddings")
    q = plain.where("vec_id = 3").first()["embedding"]
    found = ranking.search(v, q, 5, [1, 3])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [label" in plan and "norm" in plan and plan.count("sqrt") == 0
    assert [r.id for r in found.collect()] == [r.id for r in ranking.search(plain.withColumnRenamed("vec_id", "id"), q, 5, [1, 3]).collect()]
    few = ranking.among(v, q, spark.createDataFrame([(i,) for i in (3, 5, 5, 99999)], "id long"), 9)
    assert "PushedFilters: [In(id" in few._jdf.queryExecution().toString() and [r.id for r in few.collect()].count(5) == 2


def test_stored_tables_follow_their_files(spark, tmp_path):
    put = lambda n: spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), F.lit("01").alias("label")).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    put(5)
    assert tables.stored_vectors(spark, str(tmp_path)).where("label = '01'").count() == 5
    put(7)
    assert tables.stored_vectors(spark, str(tmp_path)).count() == 7


def test_completeness_by_counts(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None), (None, True)], "k string, fact boolean")
    found = evaluation.completeness_by(df, "k", "fact")
    assert {r.k: r.completeness for r in found.collect()} == {"a": 0.5, "b": 1.0, None: 1.0} and "collect_list" not in found._jdf.queryExecution().toString()
