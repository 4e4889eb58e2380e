"""Packing by minimum bin slack: every sequence is filled by the set of pieces whose lengths come closest to its size.

The lengths that are left form a multiset. For each sequence the longest piece is taken, and a subset-sum over the rest,
one bitset of reachable sums for each length and power of two of its count, finds the fullest filling; walking the
bitsets back gives how many of each length it takes. What then is open is filled by cutting one more piece. What is left
at the end of a block is less than a sequence and goes into sequences of powers of two, which need no padding either.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import Vocabulary
from .common import NO_ID, batches_of, with_null_ids

CAPACITY = 2048
END = 1
#: Characters of texts that are encoded together, tokens that are packed together, and bytes of words that are kept.
BATCH = 1_000_000
BLOCK = 2**21
MOST_KEPT = 360_000_000
#: A longer word is not kept.
LONGEST = 200
#: In white space of three and more, or of two at the end, tokens do not end before each single space and line end. Such
#: texts are cut only before spaces that follow no white space, where a token always ends.
#: Texts without any of these have no such white space; one look for each is faster than a pattern.
BLANKS = ("  ", " \n", "\n ", "\n\n", *(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"))
RUNS = re.compile(r"[\s\x85]{3}|[\s\x85]{2}\Z")
CUT = re.compile(r"(?<=[^\s\x85])(?= )")
#: Words of these characters are encoded by ranks: their classes are the same in every version of Unicode.
SIMPLE = re.compile(r"[!-~\xa1-\u024f]+")
#: The published pattern that cuts text into words before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, by words that are encoded once and kept.

    `kept` has words by their text: one that starts with a line end or a space as it is, all others with a space before
    them. New words are joined by line ends, which are tokens of their own there, and encoded together: simple ones by
    the merge ranks alone, where the vocabulary's ids follow them, and the rest by the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        v = Vocabulary(path)
        self.specials = list(v.specials)
        self.line_end = np.frombuffer(self.encoded(["\n"])[0], np.uint32)[0]
        ordered = all(a < b for a, b in zip(v.into, v.into[1:]))
        self.ranks = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={t: i for i, t in v.token.items() if i not in v.specials.values()}, special_tokens={}) if ordered else None
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str], simple: bool) -> list[bytes]:
        """The ids of words without line ends and with no white space but a space in front."""
        out: list[bytes] = []
        for a in range(0, len(words), 1000):
            text = "\n".join(words[a : a + 1000])
            ids = np.array(self.ranks.encode_ordinary(text), np.uint32) if simple and self.ranks else np.frombuffer(self.encoded([text])[0], np.uint32)
            raw, at = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == self.line_end) * 4).tolist():
                out.append(raw[at:end])
                at = end + 4
            out.append(raw[at:])
        return out

    def learned(self, new: list[str]) -> dict[str, bytes]:
        """The ids of new words, as they stand in `kept`."""
        got: dict[str, bytes] = {}
        words: tuple[list[str], list[str]] = [], []
        lines: tuple[list[str], list[str]] = [], []
        rest = []
        for w in new:
            if SIMPLE.fullmatch(w):
                words[1].append(w)
            elif w[:1] == "\n" and SIMPLE.fullmatch(w, 1):
                lines[1].append(w[1:])
            elif not w.strip() or any(map(str.isspace, w[1:])) or w[0] != "\n" and w[0].isspace():
                rest.append(w)
            elif w[0] == "\n":
                lines[0].append(w[1:])
            else:
                words[0].append(w)
        end = self.line_end.tobytes()
        for simple in (True, False):
            got.update(zip(words[simple], self.learn([" " + w for w in words[simple]], simple)))
            got.update(("\n" + w, end + x) for w, x in zip(lines[simple], self.learn(lines[simple], simple)))
        got.update(zip(rest, self.encoded([w if w[:1] in ("\n", " ") else " " + w for w in rest])))
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size > MOST_KEPT:
            self.kept.clear()
            self.size = 0
        plain, odd = [], []
        for i, t in enumerate(texts):
            (odd if any(x in t for x in self.specials) or any(x in t for x in BLANKS) and RUNS.search(t) else plain).append(i)
        out = [b""] * len(texts)
        rows = [[t] if any(x in t for x in self.specials) else self.cut(t) for t in map(texts.__getitem__, odd)]
        both = [(plain, pc.split_pattern(pa.array([texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")), (odd, pa.array(rows, pa.list_(pa.large_string())))]
        for which, lists in both:
            if which:
                for i, x in zip(which, self.joined(lists)):
                    out[i] = x
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """The words of a text with longer white space, cut only where a token always ends."""
        first, *words = CUT.split(text)
        return [first, *(w if any(map(str.isspace, w[1:])) else w[1:] for w in words)]

    def joined(self, lists: pa.ListArray) -> Iterator[bytes]:
        """The ids of each list of words; the first word of a list stands at the start of its text.

        Arrow numbers the distinct words, each is looked up once, and the ids are gathered by number.
        """
        ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = self.encoded([distinct[c] for c in codes[ends[:-1]].tolist()])
        inner = np.ones(len(codes), bool)
        inner[ends[:-1]] = False
        codes = codes[inner]
        used = np.flatnonzero(np.bincount(codes, minlength=len(distinct)))  # not those that only begin texts
        words = [distinct[c] for c in used.tolist()]
        ids = list(map(self.kept.get, words))
        fresh = self.learned([w for w, x in zip(words, ids) if x is None])
        for w, x in fresh.items():
            if len(w) <= LONGEST:
                self.kept[w] = x
                self.size += 2 * len(w) + 200
        if fresh:
            ids = [fresh[w] if x is None else x for w, x in zip(words, ids)]
        size, start = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[used] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start[used] = np.cumsum(size[used]) - size[used]
        n = size[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        raw = np.frombuffer(b"".join(ids), np.uint32)[np.repeat(start[codes] - before[:-1], n) + np.arange(before[-1])].tobytes()
        bounds = (4 * before[ends - np.arange(len(ends))]).tolist()  # each text before has one first word
        for first, a, b in zip(firsts, bounds, bounds[1:]):
            yield first + raw[a:b]


def fullest(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take, so that their sum is as near to capacity as it can be. lengths: counts of lengths.

    Longer ones are tried first; the search ends when the capacity itself is reached.
    """
    full, reach, steps = 1 << capacity, 1, []
    for n in sorted((x for x in lengths if x <= capacity), reverse=True):
        left, many = min(lengths[n], capacity // n), 1
        while left:
            many = min(many, left)
            steps.append((n, many, reach))
            reach |= (reach << n * many) & (2 * full - 1)
            left -= many
            many *= 2
        if reach & full:
            break
    taken: dict[int, int] = {}
    at = reach.bit_length() - 1
    for n, many, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + many
            at -= n * many
    return taken


class _Left:
    """Pieces (document, start) that are left, by length."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.counts: dict[int, int] = {}
        self.total = 0

    def put(self, n: int, doc: int, start: int) -> None:
        self.by.setdefault(n, []).append((doc, start))
        self.counts[n] = self.counts.get(n, 0) + 1
        self.total += n

    def take(self, n: int) -> tuple[int, int, int]:
        got = self.by[n].pop()
        self.total -= n
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.by[n], self.counts[n]
        return *got, n

    def cut(self, n: int) -> tuple[int, int, int]:
        """The first n of the longest piece; its rest stays."""
        doc, start, had = self.take(max(self.counts))
        if had > n:
            self.put(had - n, doc, start + n)
        return doc, start, n

    def filled(self, capacity: int) -> list[tuple[int, int, int]]:
        """Pieces that fill a sequence to the last place; at least as many tokens have to be left."""
        longest = max(self.counts)
        if longest >= capacity:
            return [self.cut(capacity)]
        got = [self.take(longest)]
        for n, many in fullest(self.counts, capacity - longest).items():
            got += [self.take(n) for _ in range(many)]
        open_ = capacity - sum(n for _, _, n in got)
        return [*got, self.cut(open_)] if open_ else got


def slack(lengths: list[int], capacity: int = CAPACITY) -> Iterator[list[tuple[int, int, int]]]:
    """The sequences, as lists of (document, start, length), of documents with these lengths.

    Documents over capacity fill sequences by themselves first. All sequences have the capacity, but for less than a
    sequence at the end, which goes into powers of two (of capacity over two and less).
    """
    left = _Left()
    for doc, n in enumerate(lengths):
        whole = n - n % capacity
        yield from ([(doc, at, capacity)] for at in range(0, whole, capacity))
        if n > whole:
            left.put(n - whole, doc, whole)
    while left.total >= capacity:
        yield left.filled(capacity)
    while left.total:
        yield left.filled(1 << left.total.bit_length() - 1)


#: One for each vocabulary in a worker.
_tokens: dict[str, ByteTokens] = {}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row.

    Rows are packed where they are read, in blocks of about `block` tokens, so nothing is shuffled or written; a block
    ends with at most log2(capacity) short sequences, each a power of two. Null and empty texts are one token, END.
    Repeated rows are packed each by itself; a null doc_id stays null. Only doc_id and text are read. An empty table
    gives no rows.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _tokens:
            _tokens[path] = ByteTokens(path)
        base = TaskContext.get().partitionId() << 34
        names: list[int] = []
        ids: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal base, names, ids, size
            rows = []
            for seq in slack([len(x) // 4 for x in ids], capacity):
                at = 0
                for doc, start, n in seq:
                    x = ids[doc]
                    rows.append((names[doc], start, n, zlib.crc32(x[4 * start : 4 * (start + n)]), len(x) // 4, base, at))
                    at += n
                base += 1
            names, ids, size = [], [], 0
            return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = END.to_bytes(4, "little")
        for b in batches:
            texts, docs_ = b.text.tolist(), b.doc_id.tolist()
            for i, j in batches_of(texts, BATCH):
                for doc, x in zip(docs_[i:j], _tokens[path].encode(texts[i:j])):
                    names.append(doc)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= block:
                        yield flush()
        if names:
            yield flush()

    text = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return with_null_ids(text.mapInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
