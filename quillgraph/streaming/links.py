"""Links between documents by shared keys, kept up to date as documents arrive.

A stream of tokens (token, role, doc, pos) goes through a keyed state: what documents declare a token and which cite it.
A new document adds references; the declarer that is one too many takes back all references of its token, for good. The
stream writes these changes, and `current` folds them into the links that resolving everything at once would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalar import distinctive_key
from ..graph import first_per

TOKEN = "token string, role string, doc bigint, pos bigint"
CHANGE = "token string, src bigint, dst bigint, pos bigint, added boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class References(StatefulProcessor):
    """The references of one token and one part of its citing documents: at most `most` declarers, and each citing
    document with its first position. A token with more declarers is dead and keeps nothing.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.declared = handle.getMapState("declared", "doc bigint", "one int")
        self.cited = handle.getMapState("cited", "doc bigint", "pos bigint")
        self.dead = handle.getValueState("dead", "dead boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.dead.exists():
            return
        new, declarers = {}, set()
        for b in rows:
            for role, doc, pos in zip(b.role, b.doc, b.pos):
                if role == "declares":
                    declarers.add(int(doc))
                else:
                    new[int(doc)] = min(new.get(int(doc), int(pos)), int(pos))
        old = {int(k[0]) for k in self.declared.keys()}
        fresh, out = declarers - old, []
        if len(old | fresh) > self.most:
            out = [(s, d, p, False) for s, p in self._cited() for d in old if s != d] if old else []
            self.dead.update((True,))
            self.declared.clear()
            self.cited.clear()
        else:
            if fresh:
                out += [(s, d, p, True) for s, p in self._cited() for d in fresh if s != d]
            for s, p in new.items():
                had = int(self.cited.getValue((s,))[0]) if self.cited.containsKey((s,)) else None
                if had is None or p < had:
                    self.cited.updateValue((s,), (p,))
                    out += [(s, d, p, True) for d in old | fresh if s != d]
            for d in fresh:
                self.declared.updateValue((d,), (1,))
        if out:
            src, dst, pos, added = zip(*out)
            yield pd.DataFrame({"token": key[0], "src": src, "dst": dst, "pos": pos, "added": added})

    def _cited(self) -> Iterator[tuple[int, int]]:
        return ((int(k[0]), int(v[0])) for k, v in self.cited.iterator())

    def close(self) -> None:
        pass


def tokens(cited: DataFrame, declared: DataFrame, digits: bool = True) -> DataFrame:
    """token, role, doc, pos of cited (src, pos, token) and declared (token, dst); digits: only keys with a digit."""
    fine = declared.where(distinctive_key("token")) if digits else declared
    one = cited.select("token", F.lit("cites").alias("role"), F.col("src").alias("doc"), F.col("pos").cast("bigint").alias("pos"))
    return one.unionByName(fine.select("token", F.lit("declares").alias("role"), F.col("dst").alias("doc"), F.lit(0).cast("bigint").alias("pos")))


def maintain(stream: DataFrame, changes: str, checkpoint: str, most_declarers: int = 3, parts: int = 16) -> StreamingQuery:
    """Follow a stream of tokens and write the changes of each batch as a folder of its own under `changes`.

    A token that all documents cite is no hot key: its citing documents are dealt to `parts` states, and its declarers,
    of which a few are enough to end it, are told to all of them. A batch that is repeated after a failure replaces its folder.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    part = F.when(F.col("role") == "declares", every).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")))
    dealt = stream.where("token is not null and doc is not null").withColumn("part", F.explode(part)).groupBy("token", "part")
    changed = dealt.transformWithStateInPandas(References(most_declarers), CHANGE, "Update", "None")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{changes}/batch={n}")
    return changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, changes: str, most_citations: int = 200) -> DataFrame:
    """src, dst, token: the links after all changes, as references.resolve_links gives them for all documents at once."""
    rows = spark.read.schema(f"{CHANGE}, batch bigint").parquet(changes)
    last = rows.groupBy("token", "src", "dst").agg(F.max(F.struct("batch", F.struct(~F.col("added"), -F.col("pos")).alias("how"))).alias("last"))
    hits = last.where("not last.how.col1").select("token", "src", "dst", (-F.col("last.how.col2")).alias("pos"))
    first = hits.groupBy("src", "dst").agg(F.min(F.struct("pos", "token")).alias("at")).select("src", "dst", "at.token")
    few = first_per(first, ["token"], "src", "dst", most=most_citations + 1)
    many = few.groupBy("token").count().where(F.col("count") > most_citations).select("token")
    return few.join(many, "token", "left_anti").select("src", "dst", "token")
