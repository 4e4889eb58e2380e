"""MinHash near-duplicate groups with fast similarity sketching.

A document's set is its distinct shingles of five words, as 64-bit hashes. Its sketch has T coordinates that are filled
in rounds: in round i < T every shingle falls into a hashed bin with the value (i, hash), in round T + i all shingles
fall into bin i; a bin keeps its least value. So after 2T rounds every bin is filled, nearly always after one or two,
and equal bins estimate the Jaccard similarity with the concentration of T independent samples. Bands of ROWS bins are
hashed to bucket keys. Documents that share a bucket are candidates; links are confirmed on the full sets.

Only connectivity is asked for, so a bucket is never expanded into its pairs: each round links its members to one pivot,
members that are connected by then are done, and what is left of a bucket in different groups after these rounds is
compared block by block on the full sets. A pair of blocks gives no more links than it has groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, batches_of, hot_join, keyed, lean, materialise, mix64, odd_constants, passing
from .components import stars

SHINGLE = 5
BANDS, ROWS = 24, 5
T = BANDS * ROWS
#: Characters of texts that are handled together, and words whose hashes a task keeps.
BATCH, MOST_CACHED = 400_000, 250_000
_WORD = odd_constants(SHINGLE, 11)
_ROUND = odd_constants(2 * T, 12)
_BAND = odd_constants(ROWS, 13)


class _Words(dict):
    """Hashes of words, computed once each; emptied when too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str], words: _Words | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are split at ASCII white space, A-Z are lower-cased."""
    words = _Words() if words is None else words
    out = []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
        n = len(h) - SHINGLE + 1
        if not len(h):
            out.append(h)
        elif n < 1:
            out.append(mix64(np.array([(h * _WORD[: len(h)]).sum() + np.uint64(len(h))], np.uint64)))
        else:
            s = h[:n] * _WORD[0]
            for i in range(1, SHINGLE):
                s += h[i : i + n] * _WORD[i]
            out.append(np.unique(mix64(s + np.uint64(SHINGLE))))
    return out


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """t coordinates for each non-empty set."""
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return np.zeros((len(sets), t), np.uint64)
    flat = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), size)
    out = np.full(len(sets) * t, np.uint64(2**64 - 1))
    for i in range(2 * t):
        h = mix64(flat * _ROUND[i] + np.uint64(i))
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, own * t + bins, (np.uint64(i) << np.uint64(52)) | (h >> np.uint64(12)))
        open_ = (out.reshape(-1, t) == np.uint64(2**64 - 1)).any(1)
        if not open_[size > 0].any():
            break
        go = open_[own]
        flat, own = flat[go], own[go]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each sketch."""
    k = (sketch.reshape(len(sketch), BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64)
    return mix64(k * np.uint64(2 * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """did, th, n_shingles, fp1, fp2 (hash of the set), bands of each keyed document."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for b in batches:
            for i, j in batches_of(b.text.tolist(), BATCH):
                part = b.iloc[i:j]
                sets = shingles(part.text.tolist(), words)
                fp = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({"did": part.did.to_numpy(), "th": part.th.to_numpy(), "n_shingles": [len(s) for s in sets], "fp1": fp[:, 0], "fp2": fp[:, 1], "bands": list(band_keys(sketches(sets)))})

    return docs.select("did", "th", "text").mapInPandas(lean(signed), "did long, th long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, s: number and hashes of the shingles of the wanted (node, did, th)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for b in batches:
            for i, j in batches_of(b.text.tolist(), BATCH):
                part = b.iloc[i:j]
                sets = shingles(part.text.tolist(), words)
                yield pd.DataFrame({"node": part.node.to_numpy(), "n": [len(s) for s in sets], "s": [s.view(np.int64) for s in sets]})

    return docs.select("did", "th", "text").join(wanted, ["did", "th"]).mapInPandas(lean(made), "node long, n long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets overlap enough: 100 * intersection >= percent * union."""
    left = hot_join(pairs, sets.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("s").alias("us")), ["u"])
    both = hot_join(left, sets.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("s").alias("vs")), ["v"])
    common = F.size(F.array_intersect("us", "vs"))
    return both.where(common * 100 >= (F.col("un") + F.col("vn") - common) * percent).select("u", "v")


def cell_links(node: np.ndarray, group: np.ndarray, sets: list[np.ndarray], own: np.ndarray, ci: int, cj: int, percent: int, strip: int = 32) -> list[tuple[int, int]]:
    """(u, v): links between members of blocks ci and cj (column own) that join different groups; each joins two anew.

    The full sets are compared: of a strip of members the shingles are looked up for all others at once, so a strip
    takes as many steps as the others have shingles in common with it, times its width.
    """
    size = np.array([len(s) for s in sets])
    root = np.unique(group, return_inverse=True)[1]
    left, right = np.flatnonzero(own == ci), np.flatnonzero(own == cj)
    flat, holder = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), size[right])
    out = []
    for i in range(0, len(left), strip):
        a = left[i : i + strip]
        if (root[right] == root[a[0]]).all() and (root[a] == root[a[0]]).all():
            continue
        words = np.unique(np.concatenate([sets[x] for x in a]))
        has = np.zeros((len(words), len(a)), np.uint8)
        for j, x in enumerate(a):
            has[np.searchsorted(words, sets[x]), j] = 1
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = np.flatnonzero(words[at] == flat)
        common = np.zeros((len(right), len(a)), np.int64)
        if len(hit):
            first = np.flatnonzero(np.concatenate([[True], np.diff(holder[hit]) > 0]))
            common[holder[hit][first]] = np.add.reduceat(has[at[hit]], first, axis=0, dtype=np.int32)
        near = common * 100 >= (size[right][:, None] + size[a][None, :] - common) * percent
        near &= root[right][:, None] != root[a][None, :]
        for y, x in zip(*np.nonzero(near)):
            p, q = right[y], a[x]
            if root[p] != root[q]:
                out.append((int(node[p]), int(node[q])))
                root[root == root[p]] = root[q]
    return out


def across_groups(members: DataFrame, open_: DataFrame, sets: DataFrame, percent: int, block: int = 1024, weight: int = 1_000_000, rows_per_task: int = 4096) -> DataFrame:
    """u, v: links between different groups in open buckets. members: key, node, g; open_: key.

    A bucket is cut into blocks of about `block` members and `weight` shingles, and every two blocks meet in a cell of
    their own, so a crowded bucket is spread over tasks; many small buckets share one. Cells compare full sets and give
    links that join groups, never pairs.
    """
    rows = hot_join(hot_join(members, open_.select("key"), ["key"]), sets, ["node"])
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / weight)).cast("int")
    rows = hot_join(rows, rows.groupBy("key").agg(blocks.alias("nb")), ["key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("key", "node", "g", "n", "s", "own", F.least("own", "j").alias("ci"), F.greatest("own", "j").alias("cj"))
    rows = materialise(rows)
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-count // rows_per_task), -(-total // (4 * weight)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, ci, cj), cell in pdf.groupby(["key", "ci", "cj"]):
            if ((cell.own == ci).any()) and ((cell.own == cj).any()):
                found += cell_links(cell.node.to_numpy(), cell.g.to_numpy(), [np.asarray(x) for x in cell.s], cell.own.to_numpy(), ci, cj, percent)
        u, v = zip(*found) if found else ((), ())
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return rows.groupBy(F.pmod(F.xxhash64("key", "ci", "cj"), F.lit(tasks)).alias("t")).applyInPandas(lambda pdf: compare(pdf), "u long, v long")


def grouped(docs: DataFrame, percent: int, pivot_rounds: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Written tables: signatures of the rows, numbered by rid; a node for each distinct set; node, root of linked nodes."""
    sig = materialise(signatures(docs).withColumn("rid", F.monotonically_increasing_id()))
    first = F.min(F.struct((F.col("did") == NO_ID).alias("no_id"), "did", "th", "rid"))
    nodes = sig.where("n_shingles > 0").groupBy("fp1", "fp2").agg(first.alias("rep")).select("fp1", "fp2", "rep.*")
    order = ["no_id", "did", "th"]
    nodes = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes.drop("no_id"))
    reps = sig.select("rid", "bands").join(nodes.select("rid", "node"), "rid")
    buckets = reps.select(F.explode("bands").alias("key"), "node")
    several = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    buckets = materialise(hot_join(buckets, several, ["key"]).distinct())
    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", "did", "th")
    sets = materialise(_sets(docs, wanted).dropDuplicates(["node"]))

    tested = links = roots = None
    for r in range(pivot_rounds + 1):
        group = F.col("node") if roots is None else F.coalesce("root", "node")
        members = (buckets if roots is None else hot_join(buckets, roots, ["node"], "left")).select("key", "node", group.alias("g"))
        order = F.struct((F.col("node") if r == 0 else F.xxhash64(F.lit(r), "node")).alias("h"), F.col("node").alias("node"), F.col("g").alias("g"))
        open_ = members.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min(order).alias("p")).where("g0 < g1")
        open_ = open_.select("key", F.col("p.node").alias("pivot"), F.col("p.g").alias("pg"))
        if r == pivot_rounds:
            found = materialise(across_groups(members, open_, sets, percent).distinct())
        else:
            pairs = hot_join(members, open_, ["key"]).where("g != pg").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["u", "v"], "left_anti")
            pairs = materialise(pairs)
            if pairs.isEmpty():
                if open_.isEmpty():
                    break
                continue  # what is left of open buckets is compared across groups in the last round
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = materialise(confirmed(pairs, sets, percent))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = stars(links)
    return sig, nodes, roots


def components(docs: DataFrame, percent: int = 85, pivot_rounds: int = 2) -> DataFrame:
    """did, th, n_shingles, rid, rep of each keyed document; rep is the first row (rid, did, th) of its component.

    rid numbers the rows; rep is null for documents without words. Equal sets are one node, whoever has them: texts that
    share an id stay apart. Nodes are numbered in the order of their first rows, by id with null ids last. Buckets, sets
    and pairs are deleted on return.
    """
    with passing() as keep:
        sig, nodes, roots = grouped(docs, percent, pivot_rounds)
        keep += [t for t in (sig, nodes, roots) if t is not None]
    named = nodes.select("fp1", "fp2", "node", F.struct("rid", "did", "th").alias("rep"))
    if roots is not None:
        far = hot_join(roots, named.select(F.col("node").alias("root"), F.col("rep").alias("far")), ["root"]).select("node", "far")
        named = named.join(far, "node", "left").withColumn("rep", F.coalesce("far", "rep"))
    return hot_join(sig.select("did", "th", "n_shingles", "rid", "fp1", "fp2"), named.select("fp1", "fp2", "rep"), ["fp1", "fp2"], "left").drop("fp1", "fp2")


def _kept() -> Column:
    """Whether a row of components() stays: the first of its component, with its repetitions under the same id."""
    same = (F.col("did") != NO_ID) & (F.col("did") == F.col("rep.did")) & (F.col("th") == F.col("rep.th"))
    return F.col("rep").isNull() | (F.col("rid") == F.col("rep.rid")) | same


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. Null, empty and blank texts
    have no shingles and stand alone; equal sets are linked; of documents whose ids repeat each row is returned, and
    their texts are linked by what they hold alone. component_id is the smallest doc_id of the group, null only where
    all its ids are null; kept says that it is the row's own id, and where all ids are null, that the row is the group's
    first. Only doc_id and text are read. Empty tables give no rows.
    """
    out = components(keyed(docs), percent)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = out.select(real("did").alias("doc_id"), "n_shingles", F.when(F.col("rep").isNotNull(), real("rep.did")).otherwise(real("did")).alias("component_id"), _kept().alias("first"))
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("first"))
    return out.select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that with the smallest id, null ids last; of repeated rows one stays.

    Null, empty and blank texts are linked with nothing, but equal ones under one id are repeated rows. All columns stay
    as they are, whatever their names; an empty table stays empty.
    """
    kept = components(keyed(docs), percent).where(_kept()).select("did", "th").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.join(kept, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]).select("row.*")
