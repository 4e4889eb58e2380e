"""Bounded-space online best-fit packing of token sequences.

Pieces arrive one by one and are placed at once. Open bins are kept by free space, and a bitset says which free spaces
exist: the lowest set bit from a piece's length on is its best fit. At most a fixed number of bins is open; when a piece
would open one more, the fullest closes. Pieces are dealt into groups of some ten thousand, which arrive in the order
of a hash.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, batches_of, kept, materialise, with_null_ids

CAPACITY = 2048
END = 0
MOST_CACHED = 1_000_000
#: Characters of texts that are encoded together.
BATCH = 1_000_000
#: The vocabulary's pattern for lower-case ASCII (a fixed value), and the line ends that part words.
ASCII_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class _Pieces(dict):
    """Ids of single pieces, merged once each."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()
        return got


class WordTokens(dict):
    """Ids, as little-endian unsigned 32-bit integers, of the words between spaces and line ends, which no token and no
    normalisation crosses.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self.tokenizer.model)

    def learn(self, words: set[str]) -> None:
        """Add words that are not there. Printable ASCII needs no normalisation but lower case and goes to the merges by piece; the rest goes whole."""
        plain = [w for w in words if w.isascii() and w.isprintable()]
        lines = "\n".join(plain)
        if any(s in lines for s in self.specials):
            plain = [w for w in plain if not any(s in w for s in self.specials)]
            lines = "\n".join(plain)
        rest = list(words.difference(plain)) if len(plain) < len(words) else []
        pieces, own, i = self.pieces, [], 0
        for piece in ASCII_PIECES.findall(lines.lower()):
            if piece == "\n":
                self[plain[i]] = b"".join(own)
                own, i = [], i + 1
            else:
                own.append(pieces[piece])
        if plain:
            self[plain[i]] = b"".join(own)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words are looked up once; those that are new are learned together and then filled in."""
        if len(self) > MOST_CACHED:
            self.clear()
            self.pieces.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        out: list[bytes] = []
        open_: list[tuple[int, list[bytes | None]]] = []
        new: set[str] = set()
        for words in cut:
            ids = list(map(self.get, words))
            try:
                out.append(b"".join(ids))
            except TypeError:  # a word is new
                new.update([w for w, x in zip(words, ids) if x is None])
                open_.append((len(out), ids))
                out.append(b"")
        if new:
            self.learn(new)
        for at, ids in open_:
            out[at] = b"".join([self[w] if x is None else x for w, x in zip(cut[at], ids)])
        return out


def tokens(path: str) -> WordTokens:
    """One for each vocabulary in a worker, until another stage begins there."""
    return kept(f"packing {path}", lambda: WordTokens(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id (NO_ID for null), piece, start, length, ids_crc32: each text's ids and END, cut only where they are more than
    capacity.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokens(path)
        for b in batches:
            rows = []
            texts, docs_ = b.text.tolist(), b.doc_id.tolist()
            for i, j in batches_of(texts, BATCH):
                for doc, ids in zip(docs_[i:j], words.encode(texts[i:j])):
                    ids += END.to_bytes(4, "little")
                    rows += [(doc, p, at // 4, len(x) // 4, zlib.crc32(x)) for p, at in enumerate(range(0, len(ids), 4 * capacity)) for x in [ids[at : at + 4 * capacity]]]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    text = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY, most_open: int = 64) -> tuple[list[int], list[int], int]:
    """For each piece in turn, its bin and its place there; and how many bins were closed because too many were open."""
    free: dict[int, list[int]] = {}
    mask = used = opened = forced = 0
    bins, places = [], []

    def take(room: int) -> int:
        nonlocal mask
        b = free[room].pop()
        if not free[room]:
            mask ^= 1 << room
        return b

    for n in lengths:
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = take(room)
            opened -= 1
        else:
            if opened == most_open:
                take((mask & -mask).bit_length() - 1)  # the fullest
                opened -= 1
                forced += 1
            room, b, used = capacity, used, used + 1
        bins.append(b)
        places.append(capacity - room)
        room -= n
        if room:
            free.setdefault(room, []).append(b)
            mask |= 1 << room
            opened += 1
    return bins, places, forced


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, most_open: int = 64, group_rows: int = 32768) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Null and empty texts are one piece that only has END. Repeated rows are packed each by itself. Groups are dealt by a
    hash of the row and its number, so that repeated rows spread as well, and packed independently, so at most
    `most_open` poorly filled sequences are left in each. Only the columns doc_id and text are read. An empty table gives
    no rows.
    """
    cut = materialise(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group_rows))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "row"])
        bins, places, _ = best_fit(pdf.length.tolist(), capacity, most_open)
        pdf["sequence_id"] = np.array(bins, np.int64) + pdf.pop("g").astype("int64") * 2**24
        return pdf.drop(columns=["h", "row"]).assign(offset=np.array(places, np.int64))

    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.withColumns({"h": h, "g": F.pmod(F.xxhash64(h, "row"), F.lit(groups))})
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return with_null_ids(dealt.groupBy("g").applyInPandas(lambda pdf: packed(pdf), out))
