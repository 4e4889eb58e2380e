"""Clustering, packing by slack and collocations against brute force, on odd rows as well."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import centroids, collocations, slack_packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


# clusters


def lloyd(rows, k, rounds, seed=2):
    """Every row against every centroid in whole numbers. rows: (vec_id, tuple)."""
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0))
    at = [list(v) for _, v in first[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        pick = [min(range(len(at)), key=lambda c: (dist(v, at[c]), c)) for _, v in rows]
        if n < rounds:
            for c in range(len(at)):
                own = [v for (_, v), p in zip(rows, pick) if p == c]
                at[c] = [sum(x) // len(own) for x in zip(*own)] if own else at[c]
    d = [dist(v, at[p]) for (_, v), p in zip(rows, pick)]
    per = Counter()
    for p, x in zip(pick, d):
        per[p] += x
    return sorted(((i, p, x, per[p], sum(d), hashlib.sha256(",".join(map(str, at[p])).encode()).hexdigest()) for (i, _), p, x in zip(rows, pick, d)), key=repr)


def vectors(rnd, scale):
    rows = [(i, [rnd.gauss(0, scale) for _ in range(4)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)] + [(7, rows[7][1])] * 3 + [(None, rows[9][1]), (None, [0.0] * 4), (2**60 + 1, rows[2][1])]
    return rows


@pytest.mark.parametrize("scale,k", [(0.2, 12), (3000.0, 9), (0.004, 40)])
def test_clusters(spark, scale, k):
    rows = vectors(random.Random(4), scale)
    bad = [(2000, None), (2001, [1.0] * 3), (2002, [float("nan")] * 4), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("inf")] * 4), (2005, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, key string").repartition(5)
    got = centroids.cluster(df, k, 3, 4)
    whole = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(whole, k, 3)


def test_clusters_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 4), (2, [0.5] * 4), (3, [9.0] * 4)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(df, 40, 5, 4).collect()}
    assert got[1] == got[2] and got[3][0] != got[1][0] and {d for _, d in got.values()} == {0}
    assert centroids.cluster(df.limit(0), dim=4).count() == 0 and centroids.cluster(df, dim=5).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 4)], df.schema), dim=4).collect()


# packing


def sums(lengths):
    return {sum(n * x for n, x in zip(pick, lengths)) for pick in product(*[range(c + 1) for c in lengths.values()])}


def test_fullest():
    rnd = random.Random(5)
    for _ in range(300):
        lengths = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))}
        cap = rnd.randint(1, 90)
        got = slack_packing.fullest(lengths, cap)
        assert all(n <= lengths[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums(lengths) if s <= cap)


@pytest.mark.parametrize("lengths", [[], [1], [2048], [700] * 50, [3000, 5, 5], [2047, 2], list(range(1, 600)), [4096 * 3 + 1] * 7])
def test_slack(lengths):
    seqs = list(slack_packing.slack(lengths))
    sizes = [sum(n for _, _, n in s) for s in seqs]
    assert sum(sizes) == sum(lengths) and all(x == 2048 or (x & (x - 1) == 0 and 0 < x < 2048) for x in sizes) and sum(x < 2048 for x in sizes) == (sum(lengths) % 2048).bit_count()
    at = defaultdict(list)
    for s in seqs:
        for doc, start, n in s:
            at[doc].append((start, n))
    for doc, n in enumerate(lengths):
        ends = [0]
        for start, x in sorted(at[doc]):
            assert start == ends[-1] and x > 0
            ends.append(start + x)
        assert ends[-1] == n


def test_slack_cuts_little():
    """Most documents stay whole, and as few sequences as can be hold them."""
    rnd = random.Random(6)
    lengths = [rnd.randint(1, 2040) for _ in range(3000)]
    seqs = list(slack_packing.slack(lengths))
    assert sum(map(len, seqs)) <= 3000 * 1.25
    assert sum(sum(n for _, _, n in s) == 2048 for s in seqs) == sum(lengths) // 2048


def test_pack_by_slack(spark):
    rnd = random.Random(7)
    mixed = ["".join(rnd.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "中", "1", "'s", ",", " ", "\x85", "\x1c", "<|endoftext|>", " x"]) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts = [None, "", " ", "   ", "a", "a   b", " a", "a\n b", "a \n b  ", "don't  we'll ", "word " * 30000, "x" * 5000, *mixed, *mixed[:20]]
    rows = [(None if i % 50 == 3 else 2**60 + i, t, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    tok = Tokenizer.from_file(BYTE)
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    got = slack_packing.pack(df, BYTE, block=20_000).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        n = sum(r.length for r in s)
        assert n == 2048 or n & (n - 1) == 0
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    per = defaultdict(list)
    for r in got:
        per[r.doc_id].append(r)
    assert set(per) == set(want)
    for i, x in want.items():
        if i is None:
            assert sum(r.length for r in per[i]) == sum(map(len, x))
            continue
        ids, at = x[0], 0
        for r in sorted(per[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert slack_packing.pack(df.limit(0), BYTE).count() == 0


def test_slack_words_are_numbered_once_for_a_batch():
    """Lists of words that Arrow numbers give the ids of the tokenizer: words that only begin texts, empty ones, none at all."""
    mine, rnd = slack_packing.ByteTokens(BYTE), random.Random(5)
    words = ["", "a", "the", "\nthe", "Straße", "été", "\n", "don't", "名前", "x" * 300, "  y", "1,000.5"]
    lists = [[], ["only"], [""], ["first", "a"]] + [[rnd.choice(["", "The", "été"]), *(rnd.choice(words) for _ in range(rnd.randrange(40)))] for _ in range(60)]
    texts = [" ".join(x).replace(" \n", "\n") for x in lists]
    for _ in range(2):  # the second time all words are known
        for some in (texts, [""], ["only"], ["one\t\ttwo   three "], []):
            want = [np.array(mine.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in some]
            assert mine.encode(some) == want
    plain = ["now then", "then now now", "now"]
    assert list(mine.joined(pa.array([t.split(" ") for t in plain], pa.list_(pa.large_string())))) == mine.encode(plain)


def test_merge_ranks_give_the_ids_of_the_tokenizer():
    """Every token is what the tokenizer merges its own bytes into, so merging by ranks cannot differ; and words of Latin letters agree."""
    spec = json.loads(Path(BYTE).read_text())
    tok, special = Tokenizer.from_file(BYTE), {t["content"] for t in spec["added_tokens"]}
    assert all([x.id for x in tok.model.tokenize(t)] == [i] for t, i in spec["model"]["vocab"].items() if t not in special)
    mine, rnd = slack_packing.ByteTokens(BYTE), random.Random(9)
    assert mine.ranks is not None
    chars = [chr(c) for c in range(33, 0x250) if slack_packing.SIMPLE.fullmatch(chr(c))]
    words = [" " + "".join(rnd.choice(rnd.choice([chars, chars[:94], "abcdeinrst"])) for _ in range(rnd.randint(1, 14))) for _ in range(20000)]
    assert mine.learn(words, True) == mine.encoded(words)


# phrases


def mined(rows, least, top):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        raw = (text or "").encode().translate(table)
        for c in b".,;:!?\x0b\x0c\x0d":
            raw = raw.replace(bytes((c,)), b"\n")
        for piece in raw.split(b"\n"):
            w = piece.replace(b"\t", b" ").split(b" ")
            w = [x.decode() for x in w if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in cand.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block,bits,least", [(2**20, 25, 3), (40, 20, 3), (7, 15, 4)])
def test_collocations(spark, block, bits, least):
    """Blocks smaller than texts, and bitmaps with collisions, change nothing."""
    rnd = random.Random(8)
    words = ["a", "B", "cé", "ÀB", " ", "x\x00", "d'e"] + [f"w{i}" for i in range(30)]
    rows = [(None, "en"), ("", None), (" \t", "en"), ("Z", "fr"), ("a a a a a a a", "en"), (". ! a", "en")]
    for i in range(160):
        text = "".join(rnd.choice(words[: 4 + i % 33]) + rnd.choice([" "] * 8 + ["  ", "\t", ".", ", ", "\n", "\x0b", "?"]) for _ in range(rnd.randint(1, 60)))
        rows.append((text, rnd.choice(["en", "en", "fr", None, "de"])))
    rows += rows[-12:]
    df = spark.createDataFrame([(t, x, 1, "y") for t, x in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = collocations.collocations(df, least, 50, block, bits, salts=3)
    want = mined(rows, least, 50)
    assert len(want) > 60 and sorted(tuple(r) for r in got.collect()) == want


def test_no_collocations(spark):
    df = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(df).count() == 0 and collocations.collocations(df.limit(0)).count() == 0
