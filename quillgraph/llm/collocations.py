"""Phrase collocations from word-id suffix arrays.

Texts become blocks: one sequence of word ids for about a million words, with the block's own vocabulary. In each block
numpy sorts the suffixes by prefix doubling, and the intervals of the longest common prefixes give the count of every
phrase. Counts of all blocks are merged by key. A phrase can only be frequent if all that it contains is, so words are
counted first by a hash, then pairs of frequent words, then triples of frequent pairs, and bitmaps of fixed size tell
which may be frequent. A bit that is set for another phrase costs time and changes nothing, since in the end the phrases
that are left are merged by their words.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, passing

LEAST = 30
LONGEST = 4
TOP = 2000
#: Words of a block, bits of a bitmap, hashes that a task merges before it passes them on, and words of the corpus for each part
#: that hashes are merged in.
BLOCK = 2**19
BITS = 26
MERGED = 2**21
PART = 2**20
UNKNOWN = "und"
#: Characters that end a piece (a fixed value); they become a byte that UTF-8 does not have. A to Z become lower case, tabs spaces.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(0xFF if i in ENDS else 0x20 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Block:
    """Ids of words as they come; 0 stands between pieces. Each language has words of its own."""

    def __init__(self):
        self.words: list[bytes] = []
        self.langs: dict[str, _Vocabulary] = {}
        self.lang_of = array("I")  # of each word
        self.ids = array("i")

    def of(self, lang: str) -> _Vocabulary:
        if lang not in self.langs:
            self.langs[lang] = _Vocabulary(len(self.langs), self.words, self.lang_of)
        return self.langs[lang]

    def row(self, own: int) -> pd.DataFrame:
        """The block's first `own` words and separators, and what follows as context."""
        return pd.DataFrame([{"own": own, "ids": self.ids.tobytes(), "words": b" ".join(self.words), "lang_of": self.lang_of.tobytes(), "langs": list(self.langs)}])


class _Vocabulary(dict):
    def __init__(self, lang: int, words: list[bytes], lang_of: array):
        self.lang, self.words, self.lang_of = lang, words, lang_of
        self[b"\xff"] = 0

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.lang_of.append(self.lang)
        got = self[word] = len(self.words)
        return got


class _Words:
    """The words of a stored block by id; id 0 is none."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int32)
        self.own = row.own
        self.words = [b"", *row.words.split(b" ")] if row.words else [b""]
        self.langs, self.lang_of = list(row.langs), np.frombuffer(row.lang_of, np.uint32)

    def lang(self, i: int) -> str:
        return self.langs[self.lang_of[i - 1]]

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids[: self.own], minlength=len(self.words))

    def keys(self) -> np.ndarray:
        """A hash of each word and its language."""
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs], object)
        return np.array([0, *map(xxhash.xxh64_intdigest, self.words[1:], seeds[self.lang_of])], np.uint64)


def blocks(docs: DataFrame, words: int = BLOCK) -> DataFrame:
    """own, ids (32-bit integers, packed), words by id from 1 (joined by spaces), their languages, of blocks of whole texts.

    A text longer than a block goes into several; they overlap by the words that a phrase may have beyond its first, and
    only phrases that start in the first `own` places are counted.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block()
        for b in batches:
            for text, lang in zip(b.text, b.lang):
                raw = text.encode("utf-8", "replace").translate(_TABLE).replace(b"\xff", b" \xff ").split()
                at = 0
                while len(block.ids) + len(raw) - at > words:
                    end = at + words - len(block.ids)
                    block.ids.extend(map(block.of(lang).__getitem__, raw[at : end + LONGEST - 1]))
                    yield block.row(words)
                    block, at = _Block(), end
                block.ids.extend(map(block.of(lang).__getitem__, raw[at:]))
                block.ids.append(0)
                if len(block.ids) >= words:
                    yield block.row(len(block.ids))
                    block = _Block()
        if block.ids:
            yield block.row(len(block.ids))

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    return rows.mapInPandas(cut, "own int, ids binary, words binary, lang_of binary, langs array<string>")


def bitmap(keys: Column, rows: DataFrame, bits: int) -> bytes:
    """A bit for each of 2^bits remainders of the keys; 2^bits / 8 bytes reach the driver, however many rows there are."""
    at = rows.select(F.pmod(keys, F.lit(2**bits)).alias("at")).select(F.expr("at div 32768").alias("part"), (F.col("at") % 32768).alias("bit"))
    parts = at.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("m")).collect()
    out = bytearray(max(1, 2**bits // 8))
    for r in parts:
        out[4096 * r["part"] : 4096 * r["part"] + len(r["m"])] = r["m"][: len(out)]
    return bytes(out)


def has_bit(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = keys & np.uint64(2**bits - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def suffix_array(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the next LONGEST (four) ids, and how many of these each shares with the one before.

    Prefix doubling: ranks by one id give ranks by two, these by four. ids ends with LONGEST zeros.
    """

    key = ids[:-1] * np.int64(int(ids.max(initial=0)) + 1) + ids[1:]
    two = np.unique(key, return_inverse=True)[1]
    four = two[:-2] * np.int64(len(key)) + two[2:]
    order = starts[np.argsort(four[starts], kind="stable")]
    shared = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for i in range(LONGEST):
        same &= ids[order[1:] + i] == ids[order[:-1] + i]
        shared[1:] += same
    return order, shared


def intervals(order: np.ndarray, shared: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A start of each distinct phrase of so many words, and its count: the runs that share as many."""
    first = np.flatnonzero(shared < words)
    return order[first], np.diff(np.append(first, len(order)))


class _Counter:
    """The phrases of a block of which all that the bitmaps (of words, pairs, triples) tell may be frequent."""

    def __init__(self, row, maps: list[np.ndarray], bits: int, mask: np.uint64):
        self.words, self.own, self.mask = _Words(row), row.own, mask
        self.h = self.words.keys()
        self.fine = has_bit(self.h & mask, maps[0], bits) if maps else np.ones(len(self.h), bool)
        self.fine[0] = False
        self.ids = np.concatenate([np.where(self.fine[self.words.ids], self.words.ids, 0), np.zeros(LONGEST, np.int32)])
        self.may = [self.ids > 0]  # where phrases of one word, two and three start that may be frequent
        for words, known in enumerate(maps[1:], 2):
            at = self.starts(words)
            self.may.append(np.zeros(len(self.ids), bool))
            self.may[-1][at] = has_bit(self.key(at, words), known, bits)

    def starts(self, words: int) -> np.ndarray:
        """Where phrases start whose first and last words - 1 words may be frequent."""
        part = self.may[words - 2]
        return np.flatnonzero(part[:-LONGEST] & part[1 : 1 - LONGEST])

    def key(self, at: np.ndarray, words: int) -> np.ndarray:
        k = self.h[self.ids[at]]
        for i in range(1, words):
            k = mix64(k * _FACTOR + self.h[self.ids[at + i]])
        return k & self.mask

    def counted(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and count of each distinct phrase of so many words that starts in the block's own part."""
        if words == 1:
            n = self.words.counts()
            n[0] = 0
            return (self.h & self.mask)[n > 0], n[n > 0]
        at = self.starts(words)
        at, n = intervals(*suffix_array(self.ids, at[at < self.own]), words)
        return self.key(at, words), n

    def phrases(self) -> Iterator[tuple[bytes, int]]:
        """Phrase, a tab and language, and count, of all phrases that may be frequent; the empty phrase counts all words."""
        vocab, count = self.words.words, self.words.counts()
        tails = [b"\t" + lang.encode("utf-8", "replace") for lang in self.words.langs]
        tail_of = [b"", *map(tails.__getitem__, self.words.lang_of.tolist())]
        yield from zip(tails, np.bincount(self.words.lang_of, count[1:], len(tails)).astype(np.int64).tolist())
        own = np.flatnonzero(self.fine & (count > 0))
        yield from ((vocab[i] + tail_of[i], n) for i, n in zip(own.tolist(), count[own].tolist()))
        at = np.flatnonzero(self.may[1][: self.own])
        order, shared = suffix_array(self.ids, at)
        for words in range(2, LONGEST + 1):
            first, n = intervals(order, shared, words)
            ok = self.may[words - 1][first] if words < LONGEST else self.may[-1][first] & self.may[-1][first + 1]
            ids = self.ids[first[ok][:, None] + np.arange(words)].tolist()
            yield from ((b" ".join([vocab[i] for i in p]) + tail_of[p[0]], c) for p, c in zip(ids, n[ok].tolist()))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _parts(keys: list[np.ndarray], counts: list[np.ndarray]) -> pd.DataFrame:
    """part (the upper bits of a key), keys (the lower 32 bits, packed) and n (64-bit counts, packed) of merged keys."""
    key, n = _merged(keys, counts)
    part, first = np.unique(key >> np.uint64(32), return_index=True)
    ends = [*first[1:].tolist(), len(key)]
    low = key.astype(np.uint32)
    return pd.DataFrame({"part": part.astype(np.int64), "keys": [low[a:b].tobytes() for a, b in zip(first.tolist(), ends)], "n": [n[a:b].tobytes() for a, b in zip(first.tolist(), ends)]})


def often(counted: DataFrame, least: int) -> DataFrame:
    """The keys whose counts add up to `least` and more, of the rows of _parts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        key, n = _merged([np.frombuffer(k, np.uint32) for k in pdf["keys"]], [np.frombuffer(x, np.int64) for x in pdf.n])
        return pd.DataFrame({"key": (int(pdf.part.iloc[0]) << 32) | key[n >= least].astype(np.int64)})

    return counted.groupBy("part").applyInPandas(lambda pdf: add(pdf), "key long")


def _told(counts: dict[bytes, int], parts: int) -> pd.DataFrame:
    """part, told (phrases in order, parted by a byte that UTF-8 does not have, compressed) and n (64-bit counts, packed)."""
    by: dict[int, list[bytes]] = {}
    for t in counts:
        by.setdefault(xxhash.xxh3_64_intdigest(t) % parts, []).append(t)
    pack, rows = zstandard.ZstdCompressor(level=1).compress, []
    for part, told in by.items():
        told.sort()
        rows.append((part, pack(b"\xff".join(told)), np.fromiter(map(counts.__getitem__, told), np.int64, len(told)).tobytes()))
    return pd.DataFrame(rows, columns=["part", "told", "n"])


def summed(counted: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words, f of phrases whose counts add up to `least` and more, and of the empty ones, of the rows of _told."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        for told, n in zip(pdf.told, pdf.n):
            for t, c in zip(zstandard.decompress(told).split(b"\xff"), np.frombuffer(n, np.int64).tolist()):
                total[t] = total.get(t, 0) + c
        rows = []
        for t, f in total.items():
            phrase, _, lang = t.decode("utf-8", "replace").partition("\t")
            if f >= least or not phrase:
                rows.append((lang, phrase, phrase.count(" ") + 1 if phrase else 0, f))
        return pd.DataFrame(rows, columns=["lang", "phrase", "words", "f"])

    return counted.groupBy("part").applyInPandas(lambda pdf: add(pdf), "lang string, phrase string, words int, f long")


def frequent(docs: DataFrame, least: int = LEAST, block: int = BLOCK, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n of all words), and (lang, phrase, words, f) of the phrases of 1 to LONGEST words with f >= least.

    Hashes have 32 bits and as many more as there are parts, one for about a million words of the corpus; a task passes
    on its merged hashes as one row for each part, and each part is merged by itself.
    """
    sc = docs.sparkSession.sparkContext
    with passing() as keep:
        cut, maps = materialise(blocks(docs, block)), []
        total = cut.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
        parts = 1 << (total // PART).bit_length()
        mask = np.uint64((parts << 32) - 1)

        def known() -> list[np.ndarray]:
            return [np.frombuffer(m.value, np.uint8) for m in maps]

        for words in range(1, LONGEST):

            def level(batches: Iterator[pd.DataFrame], words: int = words) -> Iterator[pd.DataFrame]:
                have, keys, counts = known(), [], []
                for b in batches:
                    for row in b.itertuples():
                        key, n = _Counter(row, have, bits, mask).counted(words)
                        keys.append(key)
                        counts.append(n)
                        if sum(map(len, keys)) > MERGED:
                            yield _parts(keys, counts)
                            keys, counts = [], []
                if keys:
                    yield _parts(keys, counts)

            found = often(cut.mapInPandas(level, "part long, keys binary, n binary"), least)
            maps.append(sc.broadcast(bitmap(F.col("key"), found, bits)))

        def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            have, counts = known(), {}
            for b in batches:
                for row in b.itertuples():
                    for told, n in _Counter(row, have, bits, mask).phrases():
                        counts[told] = counts.get(told, 0) + n
                    if len(counts) > MERGED // 4:
                        yield _told(counts, parts)
                        counts = {}
            if counts:
                yield _told(counts, parts)

        found = materialise(summed(cut.mapInPandas(phrases, "part long, told binary, n binary"), least))
        keep.append(found)
    return found.where("words = 0 and f > 0").select("lang", F.col("f").alias("n")), found.where("words > 0")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, bits: int = BITS, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to LONGEST words.

    Null texts are empty, a null lang is `und`. Repeated rows all count. Ties go by count, then by the phrase's bytes.
    Other columns than text and lang are not read; an empty table gives no rows.
    """
    totals, f = frequent(docs, least, block, bits)
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)") if isinstance(c, str) else c.cast(f"decimal({digits},0)")
    wanted = f.where("words > 1").withColumnRenamed("f", "a")
    split = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(split, start, n), " ")

    longer = f.where("words > 2").select("lang", "f", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda s: part(s, n)))))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wanted = wanted.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * whole("longer", 20) < 80 * whole("a", 20)))

    cuts = wanted.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), split.alias("w"))
    cuts = cuts.withColumns({"head": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice("w", F.col("k") + 1, F.lit(LONGEST)), " ")}).drop("w")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * whole("a", 20), whole("l", 20) + whole("r", 20))
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    near = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= top)
    first = near.withColumn("rank", rank("lang").cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
