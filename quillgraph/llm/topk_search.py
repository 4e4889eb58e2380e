"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into 1, 4, 16, then 32 segments; of each the mean and the standard deviation are kept. For segments of
length l the squared distance of q and x is at least the sum of l * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), and the
inner product is (|q|^2 + |x|^2 - distance^2) / 2. So each resolution bounds every score from above; a candidate whose
bound is below the query's k-th exact score so far is out, and only survivors of the finest resolution are computed.
A first pass over a few thousand vectors gives every query a score to start from, which all tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESOLUTIONS = (1, 4, 16, 32)


def integer_vectors(df: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; vectors null, empty or with null or non-finite parts are left out."""
    x = F.col(vec)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v")
    )


def _segments(m: np.ndarray, parts: int) -> np.ndarray:
    """Segment means and deviations of each row, times the root of the segment's length.

    With these the bound is an inner product: the squares of a row's entries add up to its norm, whatever the resolution.
    """
    cuts = np.linspace(0, m.shape[1], min(parts, m.shape[1]) + 1).astype(int)
    root = np.sqrt(np.diff(cuts))
    return np.hstack([np.stack([m[:, a:b].mean(1) for a, b in zip(cuts, cuts[1:])], 1) * root, np.stack([m[:, a:b].std(1) for a, b in zip(cuts, cuts[1:])], 1) * root])


def score_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """The k best (query, candidate, score) of a block of queries against a block of candidates, ties to smaller ids, and
    how many candidates were left to compute. Scores under a query's floor are not wanted.
    """
    wide = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, x))
    order = np.argsort(xid, kind="stable")
    xid, x = xid[order], x[order]
    qf, xf = q.astype(float), x.astype(float)
    qn, xn = (qf**2).sum(1), (xf**2).sum(1)
    if max(qn.max(initial=0), xn.max(initial=0)) < 2**52:
        q, x = qf, xf  # every partial sum is a whole number that a double holds
    floor = np.full(len(qid), -np.inf) if floors is None else floors.copy()
    alive = xid[None, :] != qid[:, None]
    cols = np.arange(len(xid))
    for parts in RESOLUTIONS:
        cols = cols[alive[:, cols].any(0)]
        if not len(cols):
            break
        bound = _segments(qf, parts) @ _segments(xf[cols], parts).T + 1e-9 * (1 + qn[:, None] + xn[None, cols])
        bound[~alive[:, cols]] = -np.inf
        # the most promising at this resolution are computed, which raises the floors
        n = min(2 * k, len(cols))
        first = np.argpartition(-bound, n - 1, axis=1)[:, :n]
        exact = np.einsum("qnd,qd->qn", x[cols[first]], q).astype(float)
        exact[np.take_along_axis(bound, first, 1) == -np.inf] = -np.inf
        if n >= k:
            floor = np.maximum(floor, np.sort(exact, 1)[:, -k])
        alive[:, cols] &= bound >= floor[:, None]
    out, left = [], 0
    for i in range(len(qid)):
        keep = np.flatnonzero(alive[i])
        left += len(keep)
        score = x[keep] @ q[i]
        if len(keep) > 4 * k:  # ties of the k-th stay
            kth = np.partition(score, -k)[-k]
            keep, score = keep[score >= kth], score[score >= kth]
        out += [(int(qid[i]), int(xid[j]), int(s)) for j, s in ((keep[t], score[t]) for t in np.lexsort((xid[keep], -score))[:k])]
    return out, left


def _pack(batches: Iterator[pd.DataFrame], rows: int, groups: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), rows):
            part = b.iloc[i : i + rows]
            wide = max(map(len, part.v))
            m = np.zeros((len(part), wide), np.int64)
            for r, v in enumerate(part.v):
                m[r, : len(v)] = v
            ids = part.vec_id.to_numpy(np.int64)
            floors = part.floor.fillna(-np.inf).to_numpy(float) if "floor" in part else np.zeros(0)
            yield pd.DataFrame({"g": [int(np.bitwise_xor.reduce(ids) * 2654435761 % 2**31 % groups)], "ids": [ids.tobytes()], "m": [m.tobytes()], "floors": [floors.tobytes()]})


def _hits(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int, query_rows: int, groups: tuple[int, int]) -> DataFrame:
    """query_id, vec_id, score: of each query the k best of every block, if they reach its floor (column of queries)."""
    layout = "g int, ids binary, m binary, floors binary"
    gx, gq = groups
    x = vectors.select("vec_id", "v").mapInPandas(lambda it: _pack(it, block_rows, gx), layout)
    q = queries.select("vec_id", "v", "floor").mapInPandas(lambda it: _pack(it, query_rows, gq), layout)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select(F.col("g").alias("gx"), every(gq).alias("gq"), F.col("ids").alias("xids"), F.col("m").alias("xm"))
    q = q.select(every(gx).alias("gx"), F.col("g").alias("gq"), F.col("ids").alias("qids"), F.col("m").alias("qm"), "floors")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple[int, int, int]] = []
            for r in b.itertuples():
                qid, xid = np.frombuffer(r.qids, np.int64), np.frombuffer(r.xids, np.int64)
                rows += score_block(qid, np.frombuffer(r.qm, np.int64).reshape(len(qid), -1), xid, np.frombuffer(r.xm, np.int64).reshape(len(xid), -1), k, np.frombuffer(r.floors))[0]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return x.join(q, ["gx", "gq"]).mapInPandas(scored, "query_id long, vec_id long, score long")


def _grid(vectors: int, queries: int, side: int = 65536, least: int = 64) -> tuple[int, int]:
    """Groups of candidates and of queries: about `side` of each meet in a task; on small tables up to `least` tasks."""
    return max(-(-vectors // side), min(least, -(-vectors // 512))), max(1, -(-queries // side))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = 4096, query_rows: int = 256, first: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query among all vectors but its own.

    Both inputs are (vec_id long, v array<long>) as integer_vectors makes them. Candidates and queries are packed into
    blocks and dealt over a grid of groups, whose size follows both counts; neither side is broadcast or crossed row by
    row. About `first` vectors by hash are searched before, and the k-th score there is the query's floor everywhere.
    Rows that share the query's vec_id count as its own. Vectors of other lengths are padded with zeros. Repeated
    candidates each keep their row; repeated queries count once. Empty inputs give no rows.
    """
    n, m = vectors.count(), queries.count()
    queries = queries.dropDuplicates(["vec_id", "v"]).withColumn("floor", F.lit(None).cast("double"))
    share = n // max(1, first)
    if share > 1:
        few = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)
        found = _hits(queries, few, k, block_rows, query_rows, _grid(first, m)).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        floors = found.select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).cast("double").alias("floor"))
        queries = queries.drop("floor").join(floors, "vec_id", "left")
    hits = _hits(queries, vectors, k, block_rows, query_rows, _grid(n, m))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
