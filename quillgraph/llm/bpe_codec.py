"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are compiled, with their ids as outputs, into an automaton that shares suffixes: every arc
carries a number, the sum along a word's path is the word's place in a table of ids. The automaton is one flat block of
bytes that workers map into memory. Words that are not in it are merged exactly, pair by pair in rank order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, materialise, with_null_ids

#: The published pattern that cuts text into words before merging (a fixed value).
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
#: A space before other white space: such texts are cut by WORDS as a whole, all others at their single spaces first.
RUN = re.compile(r" [\s\x85]|\A | \Z")
MOST_CACHED = 1_000_000
_BYTE = [bytes((i,)) for i in range(256)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in self.specials.values()} | {i: t.encode() for t, i in self.specials.items()}
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.into = [vocab[a + b] for a, b in pairs]
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word, by exact merging."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._merged_long(ids)
        get, none = self.rank.get, len(self.into)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:  # only the two pairs beside a merge change
            i = ranks.index(r)
            ids[i : i + 2] = (self.into[r],)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of adjacent pairs, in n log n steps."""
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.into[r]
            gone[j] = True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return [x for x, g in zip(ids, gone) if not g]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def compile_lexicon(words: dict[bytes, bytes]) -> bytes:
    """A minimal acyclic transducer from words to outputs, as one block of bytes.

    Words are added in order; a finished state is replaced by an equal one made before. State 0 is the last one laid
    out, the root. Block: sizes, then per state its first arc and whether a word ends there, per arc label, target and
    number, then where each word's output starts, and the outputs.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    ordered = sorted(words)
    path: list[list] = [[False, [], None]]  # ends here, settled arcs, label of the open arc
    last = b""
    for w in ordered:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            done = settle(path.pop())
            path[-1][1].append((path[-1][2], done))
        for c in w[same:]:
            path[-1][2] = c
            path.append([False, [], None])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        done = settle(path.pop())
        path[-1][1].append((path[-1][2], done))
    root = settle(path[0])
    below = [0] * len(states)
    first, ends, labels, targets, numbers = [], bytearray(), bytearray(), [], []
    for s, (end, arcs) in enumerate(states):  # targets come before their sources
        first.append(len(labels))
        ends.append(end)
        total = int(end)
        for c, t in arcs:
            labels.append(c)
            targets.append(t)
            numbers.append(total)
            total += below[t]
        below[s] = total
    first.append(len(labels))
    outs = [words[w] for w in ordered]
    starts = np.concatenate([[0], np.cumsum([len(o) for o in outs])]) if outs else np.zeros(1)
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
    ints = lambda x: np.asarray(x, np.int32).tobytes()
    return struct.pack("<4i", len(states), len(labels), len(outs), root) + ints(first) + ints(targets) + ints(numbers) + ints(starts) + pad(ends) + pad(labels) + b"".join(outs)


class Lexicon:
    """Look-up in a compiled block that is mapped into memory."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing is left behind
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, arcs, words, self.root = struct.unpack_from("<4i", self.map)
        view = memoryview(self.map)
        at = 16
        self.parts = []
        for count in (n + 1, arcs, arcs, words + 1):
            self.parts.append(view[at : at + 4 * count].cast("i"))
            at += 4 * count
        self.ends = at
        self.labels = at + n + (-n % 4)
        self.outs = self.labels + arcs + (-arcs % 4)

    def get(self, word: bytes) -> bytes | None:
        first, target, number, start = self.parts
        find, labels, s, place = self.map.find, self.labels, self.root, 0
        for c in word:
            a = find(_BYTE[c], labels + first[s], labels + first[s + 1]) - labels
            if a < 0:
                return None
            place += number[a]
            s = target[a]
        return self.map[self.outs + start[place] : self.outs + start[place + 1]] if self.map[self.ends + s] else None


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MOST_CACHED:
            self.clear()
        x = self[key] = self.make(key)
        return x


class Codec:
    """Encode and decode whole texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocab: Vocabulary, block: bytes = b""):
        self.vocab, self.lexicon = vocab, Lexicon(block) if block else None
        self.word = _Memo(self._word)
        self.first = _Memo(self._cut)
        self.spaced = _Memo(lambda s: self._word(" " + s) if s.isascii() and s.isalpha() else self._cut(" " + s))
        self.table = vocab.token

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        got = self.lexicon.get(raw) if self.lexicon else None
        return got if got is not None else packed(self.vocab.merged(raw))

    def _cut(self, text: str) -> bytes:
        return b"".join([self.word[w] for w in WORDS.findall(text)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if RUN.search(text):
            return b"".join(map(self.word.__getitem__, WORDS.findall(text)))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        v = self.vocab
        if any(s in text for s in v.specials):
            return b"".join(struct.pack("<I", v.specials[p]) if p in v.specials else self._plain(p) for p in v.special_split.split(text))
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts. Each input partition counts by itself and leaves out what it saw only once, so a
    count may be short by one for each partition; only the choice of words for the lexicon depends on it.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> pd.DataFrame:
            words: Counter = Counter()
            for s, n in seen.items():
                if n > 1:
                    for w in WORDS.findall(" " + s):
                        words[w] += n
            seen.clear()
            return pd.DataFrame({"word": list(words), "n": list(words.values())}).astype({"n": "int64"})

        for b in batches:
            for t in b.text:
                seen.update(t.split(" "))
            if len(seen) > 1_000_000:
                yield out()
        yield out()

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most_words: int) -> DataFrame:
    """Words from the lowest count on at which no more than `most_words` are left, by sixteenths of powers of two.

    Only the histogram, a row for each of these steps, reaches the driver to find that count.
    """
    step = F.floor(F.log2("n") * 16)
    held, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        held += r["words"]
        if held > most_words:
            break
        least = r["step"]
    return counts.where(step >= least if least is not None else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, vocab: Vocabulary, most_words: int = 50_000) -> bytes:
    """The compiled lexicon of the corpus' most frequent words, at most `most_words`."""
    top = frequent_words(materialise(word_counts(docs)), most_words).collect()  # most_words rows at most
    words = (r.word.encode("utf-8", "surrogatepass") for r in top if r.word)
    return compile_lexicon({w: packed(vocab.merged(w)) for w in words})


#: One codec for each vocabulary and lexicon in a worker, so that what it has cached serves its later tasks too.
_codecs: dict[tuple[str, str], Codec] = {}


def worker_codec(path: str, block: bytes) -> Codec:
    key = (path, hashlib.sha256(block).hexdigest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary(path), block)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, most_words: int = 50_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null text is the empty text, which has no tokens. Special tokens' strings in a text become their ids, and ids of
    special tokens are decoded to these strings. Repeated rows each give a row; only doc_id and text are read; an empty
    table gives no rows, and with no frequent word the lexicon is empty and every word is merged.
    """
    block = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, Vocabulary(path), most_words))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(path, block.value)
        for b in batches:
            ids = [codec.encode(t) for t in b.text]
            yield pd.DataFrame({
                "doc_id": b.doc_id, "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(codec.decode(i).encode("utf-8")).hexdigest() for i in ids],
            })

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_null_ids(rows.mapInPandas(coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
