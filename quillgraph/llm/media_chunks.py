"""Content-defined chunking of media payloads, deduplicated by digest joins and rebuilt from ordered chunk lists.

Cuts fall where a rolling gear hash of the last 32 bytes has its low bits zero, so equal content gets equal chunks
wherever it stands. A chunk that occurs more than once belongs to the first document that holds it; all others only
list its digest. The store has one row per document: its own chunks as compressed frames, and the ordered list.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, keyed, materialise, with_null_ids

#: Samples of 8 bits; a frame of 24 x 24 of them is the least unit of a payload.
FRAME = 576
FILLER = 255
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: str) -> tuple[bytes, int]:
    """The UTF-8 bytes with bytes 255 appended up to a positive multiple of FRAME, and their length before that."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes([FILLER]) * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def cuts(data: bytes, bits: int = 13, least: int = 2048, most: int = 65536) -> list[int]:
    """Ends of the chunks: gear-hash cuts, at least `least` and at most `most` bytes apart."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # the hash of 32 bytes from two halves
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, at = [], 0
    for m in [*marks.tolist(), len(data)]:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least or m == len(data) > at:
            at = m
            out.append(at)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(c: bytes) -> bytes:
    return hashlib.sha256(c).digest()[:16]


def manifest(docs: DataFrame) -> DataFrame:
    """did, th, seq, digest: the ordered chunk list of each text."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, t, i, _digest(c)) for d, t, x in zip(b.did, b.th, b.text) for i, c in enumerate(chunks(payload(x)[0]))]
            yield pd.DataFrame(rows, columns=["did", "th", "seq", "digest"])

    return keyed(docs).select("did", "th", "text").mapInPandas(listed, "did long, th long, seq int, digest binary")


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, lent): media has a row per document with its own frames; lent has the chunks that other rows refer to.

    media: did (NO_ID for null), th, n_bytes, frames array<struct<seq, digest, z>> (z null where another document owns the chunk).
    lent: did, th, seq, digest, z of chunks that are fetched from their owner. Only rows that share chunks take part
    in joins on digests; the bytes of a document move once, to meet its list.
    """
    parts = manifest(docs)
    shared = parts.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "seq")).alias("own")).where("n > 1").select("digest", "own")
    refs = materialise(hot_join(parts, shared, ["digest"]).select("did", "th", "seq", "digest", F.col("own.did").alias("odid"), F.col("own.th").alias("oth"), F.col("own.seq").alias("oseq")))
    away = F.expr("not (did = odid and th = oth and seq = oseq)")
    orders = refs.where(away).groupBy("did", "th").agg(F.collect_set("seq").alias("away"))
    owned = refs.where("did = odid and th = oth and seq = oseq").groupBy("did", "th").agg(F.collect_set("seq").alias("lend"))

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                data, n = payload(r.text)
                rows.append((r.did, r.th, n, [{"seq": i, "digest": _digest(c), "z": pack(c)} for i, c in enumerate(chunks(data))]))
            yield pd.DataFrame(rows, columns=["did", "th", "n_bytes", "frames"])

    frames = keyed(docs).mapInPandas(framed, "did long, th long, n_bytes long, frames array<struct<seq int, digest binary, z binary>>")
    known = frames.join(orders, ["did", "th"], "left").join(owned, ["did", "th"], "left")
    own = F.expr("transform(frames, f -> named_struct('seq', f.seq, 'digest', f.digest, 'z', if(away is not null and array_contains(away, f.seq), null, f.z)))")
    media = materialise(known.select("did", "th", "n_bytes", own.alias("frames"), F.col("away").isNotNull().alias("borrows"), "lend"), "none")
    give = media.where("lend is not null").select(F.col("did").alias("odid"), F.col("th").alias("oth"), F.explode(F.expr("filter(frames, f -> array_contains(lend, f.seq))")).alias("f"))
    give = give.select("odid", "oth", F.col("f.seq").alias("oseq"), F.col("f.z").alias("z")).dropDuplicates(["odid", "oth", "oseq"])
    lent = hot_join(refs.where(away).dropDuplicates(["did", "th", "seq"]), give, ["odid", "oth", "oseq"]).select("did", "th", "seq", "digest", "z")
    return media.drop("lend"), lent


def _features(data: bytes) -> str:
    """Mean, deviation, and share of each sixteenth of the value range, of all samples, the filler included."""
    s = np.frombuffer(data, np.uint8)
    share = np.bincount(s >> 4, minlength=16) * 1000 // len(s)
    return f"mean={s.mean():.4f};dev={s.std():.4f};hist=" + ",".join(map(str, share))


def rebuild(media: DataFrame, lent: DataFrame) -> DataFrame:
    """Read stored frames back in order, verify each chunk by its digest, and compute what the media say.

    Output: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. The stored
    form of a text is its frames in order, so equal texts have equal values. A chunk that does not match its digest
    raises an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                got = {f["seq"]: f["z"] for f in r.got} if r.got is not None else {}
                data, form = [], []
                for f in sorted(r.frames, key=lambda f: f["seq"]):
                    z = f["z"] if f["z"] is not None else got[f["seq"]]
                    c = unpack(z)
                    if _digest(c) != f["digest"]:
                        raise ValueError(f"chunk {f['seq']} of document {r.did} is damaged")
                    data.append(c)
                    form.append(z)
                whole, kept = b"".join(data), b"".join(form)
                rows.append((r.did, r.n_bytes, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(kept), hashlib.sha256(kept).hexdigest(), _features(whole)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pd.DataFrame(rows, columns=names)

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    got = lent.groupBy("did", "th").agg(F.collect_list(F.struct("seq", "z")).alias("got"))
    whole = media.where("not borrows").select("did", "n_bytes", "frames", F.expr("cast(null as array<struct<seq int, z binary>>)").alias("got"))
    mended = media.where("borrows").join(got, ["did", "th"]).select("did", "n_bytes", "frames", "got")
    return with_null_ids(whole.mapInPandas(read, out).unionByName(mended.mapInPandas(read, out)))


def media_column(docs: DataFrame) -> DataFrame:
    """Store every text as media and read it back.

    Null text is the empty text, one frame of filler. Rows that repeat, and texts that share an id or a null id, each give
    a row of their own. Only doc_id and text are read. An empty table gives no rows.
    """
    return rebuild(*store(docs))
