"""The corpus pipeline, stage by stage."""

import random
import weakref

import corpus_pipeline
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from quillgraph.llm import minhash_dedup, packing


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "123 456", "en", "s", 7)], docs.schema)
    now = docs.unionByName(odd)
    counts = [now.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[1] == counts[0] - 2 and counts[2] < counts[1] and counts[3] == counts[2]
    assert now.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert packed.select("doc_id").distinct().count() == counts[3]


def test_stages_of_an_empty_table(spark):
    now = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


#: Names that steps of the stages use themselves.
INNER = ("row", "p", "did", "th", "spans", "h", "rid", "rep", "node", "root", "g", "bands", "key", "n_shingles", "fp1", "fp2", "u", "v", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_p", "_did", "_th", "_spans", "_deal", "score", "lang_pred", "count", "r", "a", "b", "s", "n", "w", "i")


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those inside the stages come back as they were."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs.unionByName(spark.createDataFrame([(None, "some words without an id", "en", None, None), (None, None, None, None, None)], docs.schema))
    now = now.withColumns({c: F.concat_ws("-", F.lit(c), "doc_id", F.xxhash64("lang", "source")) for c in INNER})
    before = {(r.doc_id, *[r[c] for c in INNER]) for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = stage(spark, now, "").cache()
        rows = now.collect()
        assert now.columns == columns and len(rows) > 100 and {(r.doc_id, *[r[c] for c in INNER]) for r in rows} <= before, name
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert packed.where("piece = 0").count() == now.count()


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _survivors(rows):
    """Brute force: the first of each group of texts that are linked at 0.8, of (key, text) in order of keys."""
    sets, root = [_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(k for i, (k, _) in enumerate(rows) if find(i) == i)


def test_near_dedup_takes_0_8(spark):
    """The stage links at 0.80: pairs between 0.80 and 0.85 go as well, those under 0.80 stay."""
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        tail = 14 + i % 16  # 200 shingles, of which `tail` differ: Jaccard 0.87 down to 0.75
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-tail] + [f"t{rnd.randrange(10**6)}" for _ in range(tail)]))]
    want = _survivors(rows)
    assert 40 < len(want) < 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want


def test_near_dedup_keeps_texts_apart(spark):
    """Texts under one id, null included, are told apart: each group of copies keeps one text, unrelated texts stay."""
    rnd = random.Random(9)
    text = lambda n=80: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    near = lambda w: w[:-1] + ["changed"]
    w = [text() for _ in range(8)]
    rows = [(None, w[0]), (None, w[1]), (None, w[2]), (None, w[2]), (1, near(w[1])), (2, w[3]), (2, w[4]), (3, near(w[4])), (4, w[5]), (4, near(w[5])), (5, w[6]), (6, near(w[3])), (None, near(w[6])), (7, w[7]), (7, w[7])]
    rows = [(i, " ".join(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = list(dict.fromkeys(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, minhash_key(spark, r[1])))))
    want = _survivors([(k, t) for k, (_, t) in enumerate(left)])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(repr(left[k]) for k in want)
    assert len(got) == 8
    op5 = minhash_dedup.near_duplicates(docs).collect()
    groups = sorted(((r.doc_id, r.component_id, r.kept) for r in op5), key=repr)
    assert groups == sorted([(None, None, True), (None, None, True), (None, None, False), (None, 1, False), (None, 5, False), (1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (5, 5, True), (6, 2, False), (7, 7, True), (7, 7, True)], key=repr)


def minhash_key(spark, text):
    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def test_open_buckets_are_compared(spark):
    """Of three texts only the last two are linked; every bucket they share holds the first, the pivot of both rounds."""
    rnd = random.Random(136)
    text = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    base = text(96)
    rows = [(i, " ".join(base + text(n))) for i, n in enumerate((9, 8, 8))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 85).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {0: (0, True), 1: (1, True), 2: (1, False)}


class _Steps:
    """Stands for a table and gives the function that is mapped over its batches."""

    def select(self, *_):
        return self

    def mapInPandas(self, step, _):
        return step


def test_stages_drop_what_others_kept_in_a_worker():
    """Words that packing keeps in a Python worker do not stay there beside the next stage."""
    words = weakref.ref(packing.tokens(public_tokenizers.path("word_bpe_49k.json")))
    assert packing.tokens(public_tokenizers.path("word_bpe_49k.json")) is words()  # kept between tasks of packing
    step = minhash_dedup.signatures(_Steps())
    got = list(step(iter([pd.DataFrame({"did": [1], "th": [2], "text": ["one two three"]})])))
    assert got[0].n_shingles.tolist() == [1] and words() is None
