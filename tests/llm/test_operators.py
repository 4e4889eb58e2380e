"""Each operator against brute force, round trips or held-out rows, and on null, empty, long, tied and repeated rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import bpe_codec, common, html_extract, interleave, langid, license_scan, media_chunks, minhash_dedup, packing, queries, suffix_dedup, topk_search

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
random.seed(7)
BASE = " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(900))
TEXTS = [
    None, "", " \n\t ", "x", "12 34", BASE, BASE, BASE[:1500], BASE[300:1800] + " end", "a" * 900, "ab" * 300, "é ß 中文 😀 " * 40, "word " * 40000,
    "Released under the MIT License. cc by Apache   License", "<|endoftext|> a  b\n c ", BASE.replace("a", "A"), "don't we'll <|startoftext|>x",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else "s", i, i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "null id", "en", "s", 1, 1), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, did long").withColumns({"shard": F.lit(1), "score": F.lit("x"), "length": F.lit(0)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_top_k(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    extra = spark.createDataFrame([(9001, None, 1), (9002, [float("nan")] * 64, 1), (9003, [None] * 64, 1), (9004, [], 1), (9050, [0.5] * 64, 1), (9051, [0.5] * 64, 1), (9051, [0.5] * 64, 1)], e.schema)
    v = topk_search.integer_vectors(e.unionByName(extra))
    x = [(r.vec_id, np.array(r.v)) for r in v.collect()]
    want = {(i, k + 1, j, s) for i, q in x if i % 50 == 0 for k, (s, j) in enumerate(sorted(((-int(q @ c), j) for j, c in x if j != i))[:5]) for s in [-s]}
    got = topk_search.top_k(v.where("vec_id % 50 = 0"), v, 5, block_rows=97, query_rows=3, first=60)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    assert topk_search.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_prunes():
    """Bounds leave out most of what cannot be among the best, and floors and blocks change no result."""
    rnd = np.random.default_rng(8)
    x = np.floor(256 * np.repeat(rnd.normal(size=(40, 64)), 50, 0) + 40 * rnd.normal(size=(2000, 64))).astype(np.int64)
    ids = np.arange(2000)
    want = {(i, j, int(x[i] @ x[j])) for i in range(20) for j in sorted((j for j in range(2000) if j != i), key=lambda j: (-(x[i] @ x[j]), j))[:5]}
    got, left = topk_search.score_block(ids[:20], x[:20], ids, x, 5)
    assert set(got) == want and left < 20 * 200
    floors = np.array([sorted(x[i] @ x[j] for j in range(0, 2000, 3) if j != i)[-5] for i in range(20)], float)
    assert set(topk_search.score_block(ids[:20], x[:20], ids, x, 5, floors)[0]) == want


def test_media(odd, docs):
    for df in (odd, docs):
        got = media_chunks.media_column(df).collect()
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        assert len(got) == sum(texts.values())
        by = {}
        for (i, t), _ in texts.items():
            raw = t.encode()
            whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            by.setdefault(i, set()).add((len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:])))
        assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in by[r.doc_id] for r in got)
        assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_media_shares_chunks(spark):
    text = random.Random(1).randbytes(40000).hex()
    media, lent = media_chunks.store(spark.createDataFrame([(1, text), (2, "head " + text), (3, text)], "doc_id long, text string"))
    assert lent.count() > 6 and media.where("borrows").count() == 2


@pytest.mark.parametrize("shards", [24, 3])
def test_interleave(odd, docs, shards):
    for df in (odd, docs):
        got = interleave.interleave(df, shards, rows_per_range=8).collect()
        n = Counter(r.shard for r in got)
        assert len(got) == df.count() and max(n.values()) - min([n.get(i, 0) for i in range(shards)]) <= 1
        for s in n:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    share = Counter(r.source for r in got)
    for s in n:
        own = Counter(r.source for r in got if r.shard == s)
        assert all(abs(own[k] - share[k] / shards) <= 3 for k in share)


def test_language(odd, docs, spark):
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(r.lang_pred in ("en", "und") for r in rows)
    assert {r.doc_id: r.lang_pred for r in rows}[4] == "und"
    assert langid.identify(odd.limit(0)).count() == 0


def test_language_tables_equal_convolution(docs):
    """The folded tables against sliding every filter over every window."""
    model = langid.fit(docs, ~langid.held_out(), rows_per_lang=30)
    rnd = np.random.default_rng(9)
    w = rnd.integers(0, 256, (20, langid.WINDOW)).astype(np.uint8)
    e, best = model.emb[w], []
    for width, conv, bias in zip(langid.WIDTHS, model.conv, model.bias):
        z = np.stack([sum(e[:, at + i] @ conv[i] for i in range(width)) for at in range(langid.WINDOW - width + 1)], 1)
        best.append(z.max(1) + bias)
    assert np.allclose(langid.Predictor(model)._pooled(w), np.maximum(np.hstack(best), 0), atol=1e-4)


def test_language_of_a_hot_label(spark):
    """The sample is the rows with the smallest hashes of each language, however many rows one has."""
    rows = [(i, f"text {i} of many", "en" if i % 50 else "fr") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    h = F.xxhash64(F.lit(5), "doc_id", F.xxhash64("text"))
    want = {}
    for r in df.select("doc_id", "text", "lang", h.alias("h")).collect():
        want.setdefault(r.lang, []).append((r.h, r.text))
    seen = {}
    real = langid.train
    try:
        langid.train = lambda data, labels, langs, seed: seen.update({x: {bytes(d).rstrip(b"\0").decode() for d, y in zip(data, labels) if langs[y] == x} for x in langs})
        langid.fit(df, F.lit(True), rows_per_lang=40)
    finally:
        langid.train = real
    assert seen == {x: {t for _, t in sorted(v)[:40]} for x, v in want.items()}


def test_language_sample_of_repeated_rows(spark):
    """A row that most of the table repeats counts once in the sample, and the other rows of its language stay in it."""
    rows = [(None, "the same again", "en")] * 3000 + [(i, f"text {i} of many", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, real = [], langid.train
    try:
        langid.train = lambda data, labels, langs, seed: seen.extend(bytes(d).rstrip(b"\0").decode() for d in data)
        langid.fit(df, F.lit(True), rows_per_lang=2000)
    finally:
        langid.train = real
    assert sorted(seen) == sorted({t for _, t, _ in rows})


def test_language_of_few_rows_repeated_often(spark):
    """A language of which few rows repeat very often is learned at the default sample size, as without the repetitions."""
    few = spark.createDataFrame([(i, f"zan zor {i} zuk zwe", "xx") for i in range(30)], "doc_id long, text string, lang string")
    many = few.crossJoin(spark.range(4000).select()).unionByName(spark.createDataFrame([(100 + i, f"the text {i} of all", "yy") for i in range(800)], few.schema))
    assert many.count() == 120_800
    model = langid.fit(many, F.lit(True))
    once = langid.fit(many.distinct(), F.lit(True))
    assert model.langs == once.langs == ["xx", "yy"] and np.array_equal(model.emb, once.emb)


def test_empty_tables(odd):
    """Every operator gives no rows for an empty table."""
    none = odd.limit(0)
    assert media_chunks.media_column(none).count() == 0
    assert interleave.interleave(none).count() == 0
    assert bpe_codec.encode_documents(none, BYTE).count() == 0
    assert license_scan.scan(none).count() == 0
    assert suffix_dedup.strip_repeats(none).count() == 0
    assert minhash_dedup.drop_near_duplicates(none).count() == 0


def test_large_ids_beside_null_ones(spark):
    """Ids that no double can hold stay exact in tables that have null ids as well."""
    ids = [2**60 + 1, 2**60 + 2, None]
    df = spark.createDataFrame([(i, "some text for all") for i in ids], "doc_id long, text string").coalesce(1)
    for got in (media_chunks.media_column(df), interleave.interleave(df.withColumn("source", F.lit("s"))), bpe_codec.encode_documents(df, BYTE), suffix_dedup.remove_repeats(df), packing.pack(df, WORD), license_scan.scan(df), minhash_dedup.near_duplicates(df), langid.identify(df.withColumn("lang", F.lit("en")))):
        assert {r.doc_id for r in got.collect()} == set(ids)
    pages = spark.createDataFrame([(i, "http://x.example/a", "<p>one") for i in ids], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in html_extract.extract(pages).collect()} == set(ids)


def test_interleave_of_tiny_sources(spark):
    """A source for each row, and one that holds a third of all rows."""
    rows = [(i, "x" * (i % 9), f"s{i}" if i % 3 else "hot") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = interleave.interleave(df, 24, rows_per_range=16).collect()
    n, hot = Counter(r.shard for r in got), Counter(r.shard for r in got if r.source == "hot")
    assert sorted((r.doc_id, r.size, r.text_crc32, r.source) for r in got) == sorted((i, len(t) + 8, zlib.crc32(t.encode()), x) for i, t, x in rows)
    assert set(n.values()) == {37, 38} and all(abs(hot[s] - 12.5) <= 6 for s in range(24))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in range(24))


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, odd, docs):
    rnd = random.Random(3)
    words = BASE.split()[:150]
    copies = []
    for i in range(60):
        w = list(words)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(len(w))] = f"q{rnd.randrange(999)}"
        copies.append((5000 + i, " ".join(w)))
    for df in (docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string")), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r.doc_id: _shingles(r.text) for r in df.collect()}
        root = {i: i for i in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(rows)
        for n, a in enumerate(ids):
            for b in ids[:n]:
                i = len(rows[a] & rows[b])
                if i and 100 * i >= 85 * (len(rows[a]) + len(rows[b]) - i):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = {r.doc_id: r for r in minhash_dedup.near_duplicates(df).collect()}
        assert {i: (len(rows[i]), find(i), find(i) == i) for i in ids} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    assert minhash_dedup.near_duplicates(odd).count() == odd.count()
    kept = minhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 6").count() == 0
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def _family(rnd, members, base=300, changes=(5, 60)):
    """Sets that share most of a base."""
    own = rnd.integers(0, 2**62, base, dtype=np.int64)
    return [np.unique(np.concatenate([own[: base - k], rnd.integers(0, 2**62, k, dtype=np.int64)])) for k in rnd.integers(*changes, members)]


def test_sketches_estimate():
    sets = [s.astype(np.uint64) for s in _family(np.random.default_rng(5), 120)]
    sketch = minhash_dedup.sketches(sets)
    gaps = [(sketch[a] == sketch[b]).mean() - len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a in range(0, 120, 3) for b in range(a)]
    assert abs(np.mean(gaps)) < 0.01 and np.max(np.abs(gaps)) < 0.25 and (sketch < np.uint64(2**63)).all()


def _groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[max(find(u), find(v))] = min(find(u), find(v))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [1024, 40])
def test_crowded_buckets(spark, block):
    """Blocks of crowded buckets connect what all pairs connect, with fewer links than members; groups there before count."""
    rnd = np.random.default_rng(5)
    sets = _family(rnd, 150) + _family(rnd, 60, changes=(1, 20)) + _family(rnd, 50, changes=(40, 45)) + [np.sort(rnd.integers(0, 2**62, 40, dtype=np.int64)) for _ in range(20)]
    n = len(sets)
    known = [(0, 7), (3, 160)]
    groups = _groups(range(n), known)
    members = [(1, i, groups[i]) for i in range(0, 240)] + [(2, i, groups[i]) for i in range(100, n)]
    pairs = [(i, j) for i in range(n) for j in range(i) if (i < 240 or j >= 100) and (c := len(np.intersect1d(sets[i], sets[j]))) * 100 >= (len(sets[i]) + len(sets[j]) - c) * 85]
    m, o = spark.createDataFrame(members, "key long, node long, g long"), spark.createDataFrame([(1,), (2,)], "key long")
    s = spark.createDataFrame([(i, len(x), x.tolist()) for i, x in enumerate(sets)], "node long, n long, s array<long>")
    found = [tuple(r) for r in minhash_dedup.across_groups(m, o, s, 85, block).collect()]
    assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, pairs)))
    assert _groups(range(n), known + found) == _groups(range(n), known + pairs)
    assert block == 40 or len(found) < 2 * n


def test_family_below_the_threshold():
    """1,500 sets at Jaccard 0.80 of each other: nothing is linked and nothing is emitted; a link in it is found."""
    rnd = np.random.default_rng(6)
    sets = _family(rnd, 1500, changes=(33, 34))
    sets[700] = np.unique(np.concatenate([sets[20][:-9], rnd.integers(0, 2**62, 9, dtype=np.int64)]))
    node, own = np.arange(1500), np.arange(1500) % 2
    links = [x for ci, cj in ((0, 0), (0, 1), (1, 1)) for x in minhash_dedup.cell_links(node, node, sets, own, ci, cj, 85)]
    assert [set(x) for x in links] == [{20, 700}]


def _repeated(texts):
    c = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if c[t[i : i + 200]] > 1:
                m[i : i + 200] = True
        out.append(m)
    return out


@pytest.mark.parametrize("peers", [512, 0, 1])
def test_repeats(spark, odd, monkeypatch, peers):
    whole = suffix_dedup.shared_spans
    monkeypatch.setattr(suffix_dedup, "shared_spans", lambda parts: whole(parts, 50, peers))
    rnd = random.Random(4)
    texts = [t for t in TEXTS if t is None or len(t) < 9000] + [BASE[i : i + rnd.randint(150, 600)] + "xyz" * rnd.randint(0, 30) + BASE[2 * i : 2 * i + 240] for i in range(0, 1000, 97)]
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, m in enumerate(_repeated(raw)):
        kept = np.frombuffer(raw[i], np.uint8)[~m].tobytes()
        runs = int((m[1:] & ~m[:-1]).sum() + m[:1].sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw[i]), m.sum(), runs, hashlib.sha256(kept).hexdigest())


def test_repeats_of_null_ids_and_repeated_rows(spark):
    """Values for null ids, shared ids and repeated rows: every copy loses what it shares, whoever has it."""
    rnd = random.Random(16)
    text = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    a, b, c = text(700), text(500), text(400)
    rows = [(None, a), (None, a[:300] + b), (7, b), (7, c), (7, c), (8, text(300)), (None, None), (9, "")]
    raw = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), r, m in zip(rows, raw, _repeated(raw)):
        kept = np.frombuffer(r, np.uint8)[~m].tobytes()
        want[i, len(r), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[:1].sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == want


def test_suffix_ranks():
    """Ranks by prefix doubling against sorting all suffixes."""
    rnd = random.Random(13)
    for _ in range(50):
        words = sorted({bytes(rnd.choices(b"ab\x00\xff", k=rnd.randint(1, 40))) for _ in range(rnd.randint(1, 12))})
        rank, begin = suffix_dedup.suffix_ranks(words)
        every = [w[i:] for w in words for i in range(len(w))]
        place = {x: i + 1 for i, x in enumerate(sorted(set(every)))}
        assert rank.tolist() == [place[x] for x in every] and begin.tolist() == [sum(map(len, words[:i])) for i in range(len(words))]


def test_least_between():
    x = np.array(random.Random(14).choices(range(50), k=40))
    a, b = np.array([(i, j) for i in range(40) for j in range(i + 1, 41)]).T
    assert suffix_dedup._least_between(x, a, b).tolist() == [x[i:j].min() for i, j in zip(a, b)]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "a"])
def test_phrases_and_buckets(letters):
    """Without Spark: texts of few letters that share passages, with and without triggers, against counting windows."""
    rnd = random.Random(15)
    base = "".join(rnd.choices(letters, k=3000))
    texts = [base[i : i + rnd.randint(100, 900)] + "".join(rnd.choices(letters, k=rnd.randint(0, 300))) + base[j : j + 350] for i, j in zip(rnd.sample(range(2500), 25), rnd.sample(range(2500), 25))]
    raw = [t.encode() for t in texts + texts[:2] + ["", "x" * 199]]
    p = suffix_dedup.phrases_of(raw)
    count = p.groupby(["trig", "fp1", "fp2"]).n.transform("sum")
    masks = [np.zeros(len(t), bool) for t in raw]
    for r in p[count > 1].itertuples():
        masks[r.row][r.s1 : r.s2 + 200] = True
    kinds = p.drop_duplicates(["trig", "fp1", "fp2"])
    mixed = kinds[kinds.groupby("trig").trig.transform("count") > 1].reset_index(drop=True)
    parts = [raw[r.row][r.s1 : r.e + 200] for r in mixed.itertuples()]
    if parts:
        for o, x in zip(*suffix_dedup.shared_windows(parts, mixed.off.tolist())):
            at = mixed.s1[o] + x
            masks[mixed.row[o]][at : at + 200] = True
    for i, m in enumerate(_repeated(raw)):
        assert (masks[i] == m).all(), i


def test_strip_repeats(odd):
    got = suffix_dedup.strip_repeats(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.where("doc_id = 0").first().text is None and got.where("doc_id = 5").first().text == ""
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_bpe(odd, docs):
    t = Tokenizer.from_file(BYTE)
    for df in (odd, docs):
        want = Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe_codec.encode_documents(df, BYTE, 500).collect()) == want


def test_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}", 2 + i // 3) for i in range(300)], "word string, n long")
    for most in (0, 2, 50, 299, 300, 5000):
        words = {int(r.word[1:]) for r in bpe_codec.frequent_words(counts, most).collect()}
        assert len(words) <= most and words == set(range(300 - len(words), 300)) and (most < 50 or len(words) > most * 0.8 or len(words) == 300)


def test_bpe_random_texts():
    t, v = Tokenizer.from_file(BYTE), bpe_codec.Vocabulary(BYTE)
    words = [b" the", b"the", b"s", b" thing", b"hing", b"ing", b"a", "é".encode()]
    lexicon = bpe_codec.compile_lexicon({w: np.array(v.merged(w), "<u4").tobytes() for w in words})
    look = bpe_codec.Lexicon(lexicon)
    assert all(look.get(w) == np.array(v.merged(w), "<u4").tobytes() for w in words) and look.get(b"th") is None and look.get(b"") is None
    codec, rnd = bpe_codec.Codec(v, lexicon), random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", " \n", "\t", "é", "ß", "😀", "'s", "'re", "1", "²", "Ⅷ", "###", "<|endoftext|>", "́", "\x1c", "\x85", " ", " ", "中", "_", "\r\n", "​", "x" * 60]
    for _ in range(2000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        assert t.encode(s, add_special_tokens=False).ids == np.frombuffer(codec.encode(s), "<u4").tolist(), repr(s)


def test_packing(odd, docs):
    t = Tokenizer.from_file(WORD)
    for df in (odd, docs):
        rows = packing.pack(df, WORD).collect()
        want = Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            for p, at in enumerate(range(0, len(ids), 2048)):
                want[r.doc_id, p, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        for group in by.values():
            at = 0
            for r in sorted(group, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
        assert len(by) <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    assert packing.pack(odd.limit(0), WORD).count() == 0


def test_packing_spreads_repeated_rows(spark):
    """Rows that are equal in all columns are dealt over all groups."""
    df = spark.createDataFrame([(None, "one text")] * 4000, "doc_id long, text string").repartition(4)
    groups = Counter(r.sequence_id >> 24 for r in packing.pack(df, WORD, group_rows=400).collect())
    assert len(groups) == 10 and max(groups.values()) < 600 and sum(groups.values()) == 4000


def test_passing_tables(spark, tmp_path, monkeypatch):
    """Tables written inside go at its end, also after an error, but for those that are kept; those go with the outer one."""
    monkeypatch.setattr(common, "scratch_root", lambda _: f"file://{tmp_path}")
    left = lambda: len(list(tmp_path.iterdir()))
    with common.passing() as outer:
        with common.passing() as keep:
            first = common.materialise(spark.range(9))
            keep.append(common.materialise(first.where("id > 3")))
            assert left() == 2
        assert left() == 1 and keep[0].count() == 5
        with pytest.raises(KeyError), common.passing():
            common.materialise(spark.range(2))
            raise KeyError
        assert left() == 1
        outer.append(common.materialise(keep[0]))
    assert left() == 1 and outer[0].count() == 5
    texts = [(i, BASE[:1500] + " x" * (i % 3)) for i in range(9)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert left() == 4 and {r.component_id for r in got.collect()} == {0}  # signatures, nodes and roots


def test_bounded_bins():
    """Against trying every open bin: the tightest that fits, else a new one, for which the fullest closes at the bound."""
    rnd = random.Random(11)
    for most in (1, 2, 5, 64):
        lengths = [rnd.choice([rnd.randint(1, 100), rnd.randint(60, 100)]) for _ in range(2000)]
        open_, want, used, shut = [], [], 0, 0  # free space, number, in order of last use
        for n in lengths:
            fits = [x for x in open_ if x[0] >= n]
            if fits:
                best = max((x for x in fits if x[0] == min(fits)[0]), key=open_.index)
            else:
                if len(open_) == most:
                    least = min(open_)[0]
                    open_.remove(max((x for x in open_ if x[0] == least), key=open_.index))
                    shut += 1
                best, used = (100, used), used + 1
            if best in open_:
                open_.remove(best)
            want.append((best[1], 100 - best[0]))
            if best[0] > n:
                open_.append((best[0] - n, best[1]))
        bins, places, forced = packing.best_fit(lengths, 100, most)
        assert list(zip(bins, places)) == want and forced == shut > 0


def test_packing_is_online_and_tight():
    """The bound acts on the lengths of sf0.1, and sequences stay within 2 % of what the tokens need."""
    import pyarrow.parquet as pq

    tokens = packing.tokens(WORD)
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    lengths = [min(2048, n - at) for i in range(0, len(texts), 64) for ids in tokens.encode(texts[i : i + 64]) for n in [len(ids) // 4 + 1] for at in range(0, n, 2048)]
    random.Random(1).shuffle(lengths)
    bins, _, forced = packing.best_fit(lengths, most_open=32)
    assert forced > 0 and max(bins) + 1 <= 1.02 * sum(lengths) / 2048
    again, _, _ = packing.best_fit(lengths[:5000], most_open=32)
    assert again == bins[:5000]  # what comes later moves nothing


PAGES = [
    (1, "http://a.example/x/1", "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><article><h1>Big &amp; <b>bold</b></h1><p>One\n two<br>three<p>Four<div class='ad'>Buy</div></article><footer>F</footer></body></html>"),
    (2, "http://a.example/x/2", "<body><div>Site name</div><div>Own text of two</div><div>All rights</div></body>"),
    (3, "http://a.example/x/3", "<body><div>Site name</div><div>Own text of three</div><p>More</p><div>All rights</div><section id='comments'><p>Nice!</p></section></body>"),
    (4, None, None),
    (5, "::bad[", "<p>plain"),
    (None, "http://a.example/x/9", ""),
]


def test_pages(spark):
    df = spark.createDataFrame(PAGES + PAGES[:1], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).collect()
    assert len(got) == 7
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Big & bold\nOne two three\nFour" and text[2] == "Own text of two" and text[3] == "Own text of three\nMore" and text[4] == "" and text[5] == "plain"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_common_lines():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        i, j = html_extract.common_lines(a, b)
        assert len(i) == d[-1][-1] and [a[x] for x in i] == [b[x] for x in j] and i == sorted(set(i)) and j == sorted(set(j))


def test_differencing_decides_inside_marked_articles(spark):
    """Template lines at the ends of article elements go by differencing; passages that articles share stay."""
    body = "<article><h1>Title %d</h1><p>By the staff<p>Own text of %d<p>%s<p>More of %d<p>Send this to a friend</article>"
    pages = [(i, f"http://m.example/{i}", body % (i, i, "A saying", i)) for i in range(1, 6)]
    pages += [(6, "http://n.example/6", "<article><p>Same<p>All</article>"), (7, "http://n.example/7", "<article><p>Same<p>one<p>two<p>All</article>"), (8, "http://n.example/8", "<article><p>Same<p>six<p>ten<p>All</article>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(1, 6):
        assert got[i] == f"Title {i}\nOwn text of {i}\nA saying\nMore of {i}"
    assert got[6] == "Same\nAll" and got[7] == "one\ntwo"
    assert html_extract.edge_lines([2, 3, 4], [(True, [2]), (False, [2])]) == [] and html_extract.edge_lines([2, 3], [(False, [2, 3]), (False, [2, 3])]) == []


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if inner:
            import html

            lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner[1])]
            assert got[r.page_id] == "\n".join(x for x in lines if x)


def test_licenses(odd, docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for df in (odd, docs):
        want = Counter()
        for r in df.collect():
            w = re.findall(license_scan.WORD + "+", (r.text or "").translate(lower))
            spots = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in license_scan.BASE}
            every = sum(spots.values(), [])
            want[r.doc_id, len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted({license_scan.BASE[p] for p, x in spots.items() if x}))] += 1
        got = license_scan.scan(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_license_templates(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (2, "licensed under the GNU Lesser General Public License, version 3"), (3, "a general public version of any license"), (4, "commit license")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == {1: "cc-by,cc-by-nc-4.0", 2: "lgpl-3.0", 3: "", 4: ""}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_every_template_is_tried(spark):
    """labels and score against laying every template over every place, on texts with several licences and stray words."""
    rnd = random.Random(12)
    whole = [t.split() for _, t, _ in license_scan.TEMPLATES]
    stray = license_scan.LISTED + ["filler", "2", "0", "and"]
    texts = [" ".join(t) for t in whole]
    texts += [" ".join(whole[14] + whole[5]), " ".join(whole[15] + ["or"] + whole[5]), " ".join(["person", "copy", "forms", "binary", "hereby", "x"] + whole[9])]
    for _ in range(150):
        w = []
        for t in rnd.sample(whole, rnd.randint(1, 5)):
            w += [x if rnd.random() < 0.95 else "other" for x in t] + rnd.choices(stray, k=rnd.randint(0, 6))
        texts.append(" ".join(w))
    want = {}
    for n, text in enumerate(texts):
        w, found = text.split(), [(b, 1.0) for p, b in license_scan.BASE.items() if f" {p} " in f" {text} "]
        sure = bool(found)
        for (label, t, keys), parts in zip(license_scan.TEMPLATES, whole):
            padded = np.array([""] * len(parts) + w + [""] * len(parts))
            laid = np.lib.stride_tricks.sliding_window_view(padded, len(parts))
            for at in np.flatnonzero((laid == np.array(parts)).mean(1) >= 0.8):
                here = laid[at].tolist()
                score = sum(a == b for a, b in zip(here, parts)) / len(parts)
                if score >= 0.8 and all(f" {x} " in f" {' '.join(here)} " for x in keys):
                    found.append((label, score))
        want[n] = (",".join(sorted({x for x, _ in found})), 1.0 if sure else max((s for _, s in found), default=0.0))
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: (r.labels, r.score) for r in got.collect()} == want


def test_license_words(spark):
    """Letters beyond A-Z never become listed words; every template can be told by a word."""
    df = spark.createDataFrame([(1, "Creative Commons Attribution-ShareAlike 4.0 International License")], "doc_id long, text string")
    wide = df.select("doc_id", F.replace("text", F.lit("k"), F.lit("\u212a")).alias("text"))
    least = lambda x: [tuple(r) for r in license_scan.scan(x, least=0.2).select("n_words", "labels").collect()]
    assert least(df) == [(8, "cc-by-sa-4.0")] and least(wide) == [(8, "")]
    for c in map(chr, range(128, 0x11000)):
        assert c == "\u212a" or not c.lower().isascii(), c
    for _, text, keys in license_scan.TEMPLATES:
        assert all(f" {text} ".count(f" {x} ") == 1 for x in keys) and set(" ".join(keys).split()) & set(license_scan.TELLING)


def test_long_license_texts(spark):
    """A text of 100,000 licence words takes seconds."""
    import time

    whole = license_scan.TEMPLATES[16][1]
    rows = [(1, "permission " * 100_000), (2, " ".join([whole] * 600)), (3, "the mit license " * 33_000)]
    start = time.time()
    got = {r.doc_id: (r.n_words, r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: (100_000, "", 0.0), 2: (600 * len(whole.split()), "mit", 1.0), 3: (99_000, "mit", 1.0)}
    assert time.time() - start < 60


def test_registered():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


def test_common_lines_of_many_equal_ones():
    """The alignment equals the dynamic programme, halved or not, and takes no longer where all lines are equal."""
    rnd = random.Random(12)
    for n in range(400):
        a, b = ([rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        for found in (html_extract._pairs(a, b), html_extract._pairs(a, b, most_bits=rnd.choice([1, 8, 40]))):
            assert all(a[i] == b[j] for i, j in found) and all(x < y and z < w for (x, z), (y, w) in zip(found, found[1:]))
            assert len(found) == _longest(a, b)
    began = time.process_time()
    i, j = html_extract.common_lines([1] + [7] * 20000 + [2], [3] + [7] * 20000 + [4])
    assert len(i) == len(j) == 20000 and time.process_time() - began < 3
    i, j = html_extract.common_lines([1, *range(5000, 25000), 2], [3, *range(15000, 35000), 4])
    assert len(i) == 10000
