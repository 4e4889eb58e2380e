"""Lloyd's clustering of quantised vectors by weighted distinct vectors.

Equal quantised vectors are grouped and carry how many they are. Every round assigns the distinct vectors to the nearest
centroid and sums them, times their multiplicity, as whole numbers: a task gives one row of sums for each cluster, so a
round shuffles clusters * tasks rows and the driver holds only the centroids. At the end the clusters of the distinct
vectors are joined back to all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hot_join, materialise, passing, with_null_ids

SCALE = 256
#: Components that are larger after scaling would make squared distances pass 64 bits.
MOST = 2**27
#: Distances of components under this go exactly through double precision.
IN_DOUBLES = 2**22
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(df: DataFrame, dim: int = 64, vec: str = "embedding") -> DataFrame:
    """vec_id (NO_ID for null), key: floor(SCALE * x) of each component of vectors with `dim` finite ones, as packed
    integers of 16 bits where these hold all of a vector, else of 32.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.floor(SCALE * np.stack(b.v.to_numpy()).astype(np.float64)) if len(b) else np.zeros((0, dim))
            if (np.abs(x) > MOST).any():
                raise ValueError(f"components over {MOST // SCALE} would give distances that pass 64 bits")
            x = x.astype(np.int32)
            small = (np.abs(x) < 2**15).all(1)
            yield pd.DataFrame({"vec_id": b.vec_id, "key": [r.astype(np.int16).tobytes() if s else r.tobytes() for r, s in zip(x, small)]})

    x = F.col(vec)
    fine = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.coalesce(fine, F.lit(False))).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), x.cast("array<double>").alias("v"))
    return rows.mapInPandas(pack, "vec_id long, key binary")


def unpacked(keys: list[bytes], dim: int) -> np.ndarray:
    """The vectors of packed keys, one in a row."""
    out = np.empty((len(keys), dim), np.int64)
    for width, kind in ((2, np.int16), (4, np.int32)):
        at = [i for i, k in enumerate(keys) if len(k) == width * dim]
        if at:
            out[at] = np.frombuffer(b"".join(keys[i] for i in at), kind).reshape(len(at), dim)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of several, and the squared distance, in whole numbers."""
    a, c = x, centroids
    if max(np.abs(a).max(initial=0), np.abs(c).max(initial=0)) < IN_DOUBLES:
        a, c = a.astype(np.float64), c.astype(np.float64)  # every partial sum is a whole number that a double holds
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at].astype(np.int64)


def _starts(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k rows with the smallest hash of seed and id, in this order; equal ids go by vector, null ids come last."""
    h = F.when(F.col("vec_id") != NO_ID, F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")).cast("binary"), 256))
    first = rows.select(h.alias("h"), "key").orderBy(F.asc_nulls_last("h"), "key").limit(k).collect()
    return unpacked([bytes(r["key"]) for r in first], dim)


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the exact means, or as they were where no vector is nearest."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, n = unpacked(b.key.tolist(), dim), b.n.to_numpy(np.int64)
            at, _ = nearest(x, centroids)
            np.add.at(total, at, x * n[:, None])
            np.add.at(count, at, n)
        mine = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": mine.astype(np.int32), "n": count[mine], "s": list(total[mine])})

    parts = distinct.select("key", "n").mapInPandas(sums, "cluster int, n long, s array<long>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("s")[i]) for i in range(dim)]).alias("s")).collect()
    now = centroids.copy()
    for r in found:
        now[r["cluster"]] = [int(s) // int(r["n"]) for s in r["s"]]
    return now


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, vec: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector with `dim` finite components.

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`; fewer vectors give fewer centroids. Ties
    in distance go to the smaller number. Vectors that are null, of another length or with null or non-finite components
    take no part. Repeated rows each count and each give a row; rows with a null vec_id take part, keep the null, and
    come last among the starts. A component over 2^19 raises an error. Other columns are not read; an empty table gives
    no rows.
    """
    spark = df.sparkSession
    with passing() as keep:
        rows = materialise(quantised(df, dim, vec))
        distinct = materialise(rows.groupBy("key").agg(F.count("*").alias("n")))
        at = _starts(rows, k, seed, dim)
        if not len(at):
            return spark.createDataFrame([], _OUT)
        for _ in range(rounds):
            at = _moved(distinct, at)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                c, d = nearest(unpacked(b.key.tolist(), dim), at)
                yield pd.DataFrame({"key": b.key, "n": b.n, "cluster": c.astype(np.int32), "distance": d})

        assigned = materialise(distinct.mapInPandas(assign, "key binary, n long, cluster int, distance long"))
        spread = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
        total = sum(spread.values())
        hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
        told = spark.createDataFrame([(i, s, total, hashes[i]) for i, s in spread.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        keep += [rows, assigned]
    out = hot_join(rows, assigned.select("key", "cluster", "distance"), ["key"]).drop("key").join(F.broadcast(told), "cluster")  # k rows
    return with_null_ids(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "vec_id")
