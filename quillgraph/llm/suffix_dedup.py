"""Removal of repeated passages by prefix-free parsing, on a table of texts of any size.

Strings of K bytes whose rolling hash is 0 modulo EVERY are triggers. They cut each text into phrases that run from one
trigger to the end of the next; the distinct phrases are the dictionary, the sequence of phrase numbers is the parse. A
window of LENGTH bytes belongs to the first trigger in it, so it is a suffix of a dictionary phrase, up to that trigger,
followed by a prefix of a parse suffix, from it on. No such phrase suffix is a prefix of another, so the order of all
windows in the corpus is that of their phrase suffixes, then of their parse suffixes; and repeated windows are neighbours
with a common prefix of LENGTH bytes. In stretches without a trigger the least hash of a window stands for one.

The work is dealt by triggers, since equal phrase suffixes end with the same one:

* the same phrases, as far as the windows at a trigger reach, occur twice: all these windows are repeated;
* a trigger that occurs once has no equal window anywhere;
* triggers whose phrases differ are put in buckets. In each, the suffix array of the bucket's dictionary (by prefix
  doubling) and that of its parse are combined, and neighbours are compared by their longest common prefix.

Only trigger hashes of all phrases are dealt; phrases with repeated triggers follow, bytes only of those that differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hot_join, keyed, lean, materialise, mix64, odd_constants, with_null_ids

LENGTH = 200
#: Bytes of a trigger, and the share of strings that are triggers: one in EVERY.
K = 32
EVERY = 100
BASE = 0x9E3779B97F4A7C15
TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Bases of the two hashes of a sequence of phrases, and their inverses.
BASES = [int(x) for x in odd_constants(2, 78)]
INVERSES = [pow(b, -1, 2**64) for b in BASES]
#: Windows in a range of a phrase whose trigger is very common.
STEP = 16
#: Bytes of text handled at once; positions must fit the low bits of a sort key.
BLOCK = 2_000_000
LOW = np.uint64(0xFFFFFF)
#: The base of a window's second hash.
SECOND = int(odd_constants(1, 77)[0])


def rolling(buf: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """The polynomial hash of every substring of this length, from hashes of its powers of two."""
    h, size, out, done = TABLE[buf], 1, None, 0
    power = base
    while True:
        if length & size:  # append a piece of this size to what is there
            out = h if out is None else _append(out, h, done, np.uint64(power))
            done += size
        size *= 2
        if size > length:
            break
        h = h[: -(size // 2)] * np.uint64(power) + h[size // 2 :]
        power = power * power % 2**64
    return mix64(out[: len(buf) - length + 1])


def _append(out: np.ndarray, h: np.ndarray, done: int, power: np.uint64) -> np.ndarray:
    n = min(len(out), len(h) - done)
    return out[:n] * power + h[done : done + n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of many texts, or of a part of a long one: bytes, and per part its row, offset in the text, and length."""
    held: list[bytes] = []
    rows: list[tuple[int, int, int]] = []
    size = 0

    def full() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r, o, n = (np.array(c, np.int64) for c in zip(*rows))
        return np.frombuffer(b"".join(held), np.uint8), r, o, n

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, len(t) - LENGTH + 1, BLOCK):
            part = t[at : at + BLOCK + LENGTH - 1]
            held.append(part)
            rows.append((i, at, len(part)))
            size += len(part)
            if size >= BLOCK:
                yield full()
                held, rows, size = [], [], 0
    if held:
        yield full()


def triggers(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of triggers among the hashes h of a buffer whose parts end at `ends`, and the parts they are in."""
    t = np.flatnonzero(h % np.uint64(EVERY) == 0)
    part = np.searchsorted(ends, t, "right")
    inside = t + K <= ends[part]
    return t[inside], part[inside]


def _digests(view: memoryview, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist())]), ">u8").reshape(-1, 2).astype(np.uint64)


def _sequences(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Two hashes of each sequence of ids from first to last: polynomials, from their sums over all ids before."""
    out = []
    for c, (base, inverse) in enumerate(zip(BASES, INVERSES)):
        power = np.cumprod(np.full(len(ids), base, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids[:, c] * power)])
        back = np.cumprod(np.full(len(ids), inverse, np.uint64))
        out.append(mix64((sums[last + 1] - sums[first]) * back[first]))
    return np.stack(out, 1).view(np.int64)


def phrases_of(texts: list[bytes]) -> pd.DataFrame:
    """row, s1, s2 (first and last window start), trig, fp1, fp2, n, e, off of the windows at every trigger.

    fp1 and fp2 stand for the phrase that ends with the trigger and those after it that its windows reach. A run of n
    equal ones is one row; e is the last window start of the first of them, off where the trigger is in it.
    """
    parts = []
    for buf, row, offset, size in _blocks(texts):
        h = rolling(buf, K)
        view = memoryview(buf)
        ends = np.cumsum(size)
        starts = ends - size
        t, of = triggers(h, ends)
        # the parse of each part: a phrase for each trigger, and the rest
        at = np.concatenate([t + K, ends])
        part = np.concatenate([of, np.arange(len(size))])
        order = np.lexsort((np.arange(len(at)), part))  # the rest comes last in its part
        ending, part, rest = at[order], part[order], order >= len(t)
        begin = np.concatenate([[0], ending[:-1] - K])
        opens = np.concatenate([[True], part[1:] != part[:-1]])
        begin[opens] = starts[part[opens]]
        ids = _digests(view, begin, ending)
        ids[rest] ^= np.uint64(BASES[0])  # the end of a part is no trigger
        # windows by their first trigger, or by their least hash
        live = size - LENGTH + 1
        w = np.arange(live.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(live)[:-1]]), live)
        own = np.repeat(np.arange(len(size)), live)
        k = np.searchsorted(t, w)
        anchor = np.concatenate([t, [len(buf) + LENGTH]])[k]
        cut = anchor - w <= LENGTH - K
        if not cut.all():
            pos = np.arange(len(h), dtype=np.uint64)
            low = sliding_min((h & ~LOW) | (LOW - pos), LENGTH - K + 1)
            anchor = np.where(cut, anchor, (LOW - (low[w] & LOW)).astype(np.int64))
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]))
        last = np.concatenate([new[1:], [len(w)]]) - 1
        a, b, p, cut = w[new], w[last], own[new], cut[new]
        fp = np.zeros((len(new), 2), np.int64)
        place = np.flatnonzero(~rest)[k[new][cut]]  # of the phrase that ends with the trigger
        reach = np.searchsorted(ending, b[cut] + LENGTH)
        fp[cut] = _sequences(ids, place, reach)
        fp[~cut] = _digests(view, a[~cut], b[~cut] + LENGTH).view(np.int64)
        again = np.concatenate([[False], (fp[1:] == fp[:-1]).all(1) & (p[1:] == p[:-1])])
        first = np.flatnonzero(~again)
        end = np.concatenate([first[1:], [len(again)]]) - 1
        shift = offset[p] - starts[p]
        parts.append(pd.DataFrame({
            "row": row[p[first]], "s1": a[first] + shift[first], "s2": b[end] + shift[end], "trig": h[anchor[new[first]]].view(np.int64),
            "fp1": fp[first, 0], "fp2": fp[first, 1], "n": end - first + 1, "e": b[first] + shift[first], "off": (anchor[new] - a)[first],
        }))
    return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "s1", "s2", "trig", "fp1", "fp2", "n", "e", "off")})


def _bytes(texts: pd.Series) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in texts]


def parse(docs: DataFrame) -> DataFrame:
    """did, th and the columns of phrases_of: the phrases of every text in keyed form."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                p = phrases_of(_bytes(part.text))
                p.insert(0, "did", part.did.to_numpy()[p.row])
                p.insert(1, "th", part.th.to_numpy()[p.row])
                yield p.drop(columns="row")

    return docs.select("did", "th", "text").mapInPandas(lean(parsed), "did long, th long, s1 long, s2 long, trig long, fp1 long, fp2 long, n long, e long, off long")


def contents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """mixed with the bytes of each phrase: did, th, s1, off, trig, peers, part."""
    lists = mixed.groupBy("did", "th").agg(F.collect_list(F.struct("s1", "e", "off", "trig", "peers")).alias("p"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for did, th, text, p in zip(b.did, b.th, b.text, b.p):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(did, th, x["s1"], x["off"], x["trig"], x["peers"], raw[x["s1"] : x["e"] + LENGTH]) for x in p]
            yield pd.DataFrame(rows, columns=["did", "th", "s1", "off", "trig", "peers", "part"])

    return docs.select("did", "th", "text").join(lists, ["did", "th"]).mapInPandas(lean(cut), "did long, th long, s1 long, off long, trig long, peers long, part binary")


def _windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the parts: its part, its start there, and two hashes."""
    size = np.array([len(x) for x in parts])
    ends = np.cumsum(size)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    live = size - LENGTH + 1
    own = np.repeat(np.arange(len(parts)), live)
    at = np.arange(live.sum()) - np.repeat(np.cumsum(live) - live, live)
    w = at + np.repeat(ends - size, live)
    return own, at, rolling(buf, LENGTH)[w].view(np.int64), rolling(buf, LENGTH, SECOND)[w].view(np.int64)


def suffix_ranks(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every suffix of every word, one after the other, its place in their order (equal ones have the same); and
    where each word begins. By prefix doubling, from ranks of seven bytes on; a word's end comes before all bytes.
    """
    size = np.array([len(x) for x in words], np.int64)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(size.sum())
    byte = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) + 1
    rank = np.zeros(len(byte), np.int64)
    for i in range(7):
        rank = rank << 9
        more = np.flatnonzero(left > i)
        rank[more] |= byte[more + i]
    rank = np.unique(rank, return_inverse=True)[1] + 1
    step = 7
    while step < size.max(initial=0):
        after = np.zeros(len(rank), np.int64)
        more = np.flatnonzero(left > step)
        after[more] = rank[more + step]
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1] + 1
        step *= 2
    return rank, ends - size


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def parse_ranks(parts: list[bytes], off: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the bucket's parse: the rank of what follows each part's trigger, as a sequence of phrases,
    and of every two neighbours in that order how many bytes after the trigger they share.
    """
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    t, of = triggers(rolling(buf, K), ends)
    at = t - (ends - [len(x) for x in parts])[of]
    cuts: list[list[int]] = [[o] for o in off]
    for p, x in zip(of.tolist(), at.tolist()):
        if x > off[p]:
            cuts[p].append(x)
    phrases = [[part[a : b + K] for a, b in zip(c, c[1:])] + [part[c[-1] :]] for part, c in zip(parts, cuts)]
    words = sorted({x for seq in phrases for x in seq})
    number = {x: i for i, x in enumerate(words)}
    seqs = [tuple([number[x] for x in seq]) for seq in phrases]
    order = sorted(set(seqs))
    shared = []
    for x, y in zip(order, order[1:]):
        n = i = 0
        while i < min(len(x), len(y)) and x[i] == y[i]:
            n += len(words[x[i]]) - K
            i += 1
        shared.append(n + (_common(words[x[i]], words[y[i]]) - K if i < min(len(x), len(y)) else 0))
    place = {x: i for i, x in enumerate(order)}
    return np.array([place[x] for x in seqs]), np.array(shared, np.int64)


def _least_between(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of x[a:b] for arrays a < b, from minima of runs of powers of two."""
    level = np.frexp((b - a).astype(float))[1] - 1
    runs, out = x, np.zeros(len(a), x.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        here = level == k
        out[here] = np.minimum(runs[a[here]], runs[b[here] - 2**k])
        runs = np.minimum(runs[: -(2**k)], runs[2**k :])
    return out


def shared_windows(parts: list[bytes], off: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(part, start) of every window that another part has as well, if its trigger (at off in its part) is the same.

    A window is the suffix of a dictionary phrase up to the trigger and a prefix of the parse suffix from there on; in
    the order of the two, a window with an equal one has it beside itself.
    """
    heads = [x[: o + K] for x, o in zip(parts, off)]
    words = sorted(set(heads))
    number = {x: i for i, x in enumerate(words)}
    rank, begin = suffix_ranks(words)
    head = begin[[number[x] for x in heads]]
    after, shared = parse_ranks(parts, off)
    live = np.array([len(x) for x in parts]) - LENGTH + 1
    own = np.repeat(np.arange(len(parts)), live)
    at = np.arange(live.sum()) - np.repeat(np.cumsum(live) - live, live)
    suffix, follows = rank[head[own] + at], after[own]
    order = np.lexsort((follows, suffix))
    x, y = order[:-1], order[1:]
    beside = suffix[x] == suffix[y]
    x, y = x[beside], y[beside]
    common = np.full(len(x), LENGTH)
    differ = follows[x] < follows[y]
    common[differ] = _least_between(shared, follows[x][differ], follows[y][differ])
    common += np.array(off)[own[x]] + K - at[x]
    twice = np.zeros(len(own), bool)
    twice[x[common >= LENGTH]] = True
    twice[y[common >= LENGTH]] = True
    return own[twice], at[twice]


def shared_in_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of windows that two rows of one bucket share; all phrases of a trigger are in the same bucket."""
    own, at = shared_windows(pdf.part.tolist(), pdf.off.tolist())
    if not len(own):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("did", "th", "a", "b")})
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(own)]]) - 1
    p = own[first]
    s1 = pdf.s1.to_numpy()[p]
    return pd.DataFrame({"did": pdf.did.to_numpy()[p], "th": pdf.th.to_numpy()[p], "a": s1 + at[first], "b": s1 + at[last] + LENGTH})


def split_phrase(part: bytes, off: int) -> list[tuple[int, int, int, int, int, bytes]]:
    """Ranges of up to STEP windows by their distance from the trigger: start, last start, core, hashes, bytes.

    The core is what all windows at these distances have in common, whatever of them the phrase holds.
    """
    out = []
    last = len(part) - LENGTH
    for j in range(max(0, off - last) // STEP, off // STEP + 1):
        a, b = max(0, off - STEP * j - STEP + 1), min(last, off - STEP * j)
        if a <= b:
            at = off - STEP * j
            own = part[a : b + LENGTH]
            h = int.from_bytes(xxhash.xxh3_128_digest(own), "big")
            core = xxhash.xxh3_64_intdigest(part[at : at + LENGTH - STEP + 1], seed=j)
            out.append((a, b, core - 2**63, (h >> 64) - 2**63, h % 2**64 - 2**63, own))
    return out


def shared_spans(parts: DataFrame, bucket_rows: int = 4000, most_peers: int = 512) -> DataFrame:
    """did, th, a, b: what distinct phrases of one trigger share.

    Triggers with up to `most_peers` distinct phrases are dealt into even buckets and compared inside these. Phrases of
    more common triggers are split into ranges of STEP windows, which are phrases of their own with the core as trigger:
    equal ranges are repeated whole, a core that occurs once is unique, and only the windows of the ranges in between
    are counted one by one over the whole table. So no task holds such a group.
    """
    n = max(1, -(-parts.count() // bucket_rows))
    few = parts.where(F.col("peers") <= most_peers).groupBy(F.pmod(F.xxhash64("trig"), F.lit(n)).alias("bucket"))
    near = few.applyInPandas(lambda pdf: shared_in_bucket(pdf), "did long, th long, a long, b long")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(did, th, s1 + x[0], s1 + x[1], *x[2:]) for did, th, s1, off, part in zip(b.did, b.th, b.s1, b.off, b.part) for x in split_phrase(part, off)]
            yield pd.DataFrame(rows, columns=["did", "th", "s1", "s2", "core", "fp1", "fp2", "part"])

    ranges = materialise(parts.where(F.col("peers") > most_peers).mapInPandas(lean(split), "did long, th long, s1 long, s2 long, core long, fp1 long, fp2 long, part binary"))
    words = ranges.groupBy("core", "fp1", "fp2").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "s1")).alias("rep"))
    equal = hot_join(ranges.select("did", "th", "s1", "s2", "core", "fp1", "fp2"), words.where("n > 1").select("core", "fp1", "fp2"), ["core", "fp1", "fp2"])
    both = words.groupBy("core").count().where("count > 1").select("core")
    open_ = hot_join(words.select("core", "rep.*"), both, ["core"])
    open_ = ranges.select("did", "th", "s1", "part").join(open_.select("did", "th", "s1"), ["did", "th", "s1"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, at, h1, h2 = _windows(b.part.tolist())
            yield pd.DataFrame({"did": b.did.to_numpy()[own], "th": b.th.to_numpy()[own], "a": b.s1.to_numpy()[own] + at, "h1": h1, "h2": h2})

    w = open_.mapInPandas(lean(hashed), "did long, th long, a long, h1 long, h2 long")
    twice = w.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    far = hot_join(w, twice, ["h1", "h2"]).select("did", "th", "a", (F.col("a") + LENGTH).alias("b"))
    return near.unionByName(equal.select("did", "th", F.col("s1").alias("a"), (F.col("s2") + LENGTH).alias("b"))).unionByName(far)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """did, th, a, b: byte ranges of keyed docs that are covered by repeated windows; they may overlap."""
    p = parse(docs)
    again = p.groupBy("trig").agg(F.sum("n").alias("n")).where("n > 1").select("trig")
    known = materialise(hot_join(p, again, ["trig"]))
    words = known.groupBy("fp1", "fp2").agg(F.sum("n").alias("n"), F.min(F.struct("did", "th", "s1", "e", "off", "trig")).alias("rep"))
    words = materialise(words.select("fp1", "fp2", "n", "rep.*"))
    whole = hot_join(known.select("did", "th", "s1", "s2", "fp1", "fp2"), words.where("n > 1").select("fp1", "fp2"), ["fp1", "fp2"])
    peers = words.groupBy("trig").agg(F.count("*").alias("peers")).where("peers > 1")
    mixed = hot_join(words, peers, ["trig"])
    edge = shared_spans(materialise(contents(docs, mixed)))
    return whole.select("did", "th", F.col("s1").alias("a"), (F.col("s2") + LENGTH).alias("b")).unionByName(edge)


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and the number of maximal runs of those."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            if end > 0:
                removed += end - start
            kept.append(raw[at if end < 0 else end : a])
            start, runs = a, runs + 1
            end = b
        else:
            end = max(end, b)
    if end > 0:
        removed += end - start
        kept.append(raw[end:])
        return b"".join(kept), removed, runs
    return raw, 0, 0


def _with_spans(docs: DataFrame) -> DataFrame:
    spans = repeated_spans(docs).groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(spans, ["did", "th"], "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Every byte covered by a LENGTH-byte string that also starts elsewhere in the corpus goes, all copies alike; matches
    stay within a text. Null and short texts lose nothing; repeated rows are copies of each other, and so are equal texts
    under one id or under null ids. Only doc_id and text are read; an empty table gives no rows.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, spans in zip(b.did, b.text, b.spans):
                raw = text.encode("utf-8", "surrogatepass")
                kept, gone, runs = cut_out(raw, [(s["a"], s["b"]) for s in spans] if spans is not None else [])
                rows.append((i, len(raw), gone, runs, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(keyed(docs)).select("did", "text", "spans")
    return with_null_ids(rows.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated byte cut out of the texts; n_chars follows where there is one, all other columns stay as
    they are, whatever their names.

    A character of which only a part is repeated is cut as well. Null texts stay null; repeated rows are copies of each
    other; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if s is None or not len(s):
                out.append(t)
            else:
                out.append(cut_out(t.encode("utf-8", "surrogatepass"), [(x["a"], x["b"]) for x in s])[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    spans = repeated_spans(keyed(docs)).groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.join(spans, ["did", "th"], "left")
    rows = rows.select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut("row.text", "spans")).alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length("text"), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")
