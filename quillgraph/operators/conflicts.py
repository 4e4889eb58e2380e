"""Conflicting documents, and who held what when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import non_empty
from ..graph import cut, first_per, running

#: Properties that date a node, the first that is not empty counts.
TIMES = ("decided_at", "sent_at", "created_at", "updated_at")


def node_time(properties: str = "properties") -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(F.col(properties), F.lit(t)), F.lit("")) for t in TIMES])


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, rel_type, winner, reason for each pair of nodes that contradict or supersede each other.

    nodes: id, at (ISO string or null). edges: id, rel_type, src, dst. One row for each unordered pair: SUPERSEDES counts
    before CONTRADICTS, then the smaller edge id. A superseding node wins; of contradicting ones the later, by string
    order of the times, wins, the source on ties or where a time is missing. A pair with an end outside nodes is used up
    and gives no row.
    """
    two = edges.where(F.col("rel_type").isin("SUPERSEDES", "CONTRADICTS")).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    one = first_per(two, ["a", "b"], (F.col("rel_type") != "SUPERSEDES"), "id")
    s = nodes.select(F.col("id").alias("src"), F.nullif("at", F.lit("")).alias("src_at"))
    d = nodes.select(F.col("id").alias("dst"), F.nullif("at", F.lit("")).alias("dst_at"))
    both = one.join(s, "src").join(d, "dst")
    sup, timed = F.col("rel_type") == "SUPERSEDES", F.col("src_at").isNotNull() & F.col("dst_at").isNotNull()
    winner = F.when(sup | ~timed | (F.col("src_at") >= F.col("dst_at")), F.col("src")).otherwise(F.col("dst"))
    reason = F.when(sup, "supersedes").when(timed, "later").otherwise("defaulted")
    return both.select("a", "b", "rel_type", winner.alias("winner"), reason.alias("reason"))


def presented(conflicts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Conflicts with a subject, source and time for display: `<label> conflict`, `graph` and '' where there is none."""
    n = nodes.select(F.col("id").alias("winner"), "label", non_empty("source").alias("source"), "at")
    out = conflicts.join(n, "winner")
    return out.withColumns({"subject": F.concat("label", F.lit(" conflict")), "source": F.coalesce("source", F.lit("graph")), "at": F.coalesce("at", F.lit(""))}).drop("label")


def held_at(intervals: DataFrame, asked: DataFrame, block: int = 16) -> DataFrame:
    """Owners of each asked (key, t): intervals (key, owner, valid_from, valid_to) that hold t, both ends included.

    An empty or null valid_to is open; an interval without key or start, or that ends before it starts, holds nothing; a
    question without key or time has no owner; repeated rows count each.

    Questions and ends of intervals are laid in one order of key and time and the questions numbered in it, so an
    interval becomes the range of numbers that it holds. Numbers are cut into blocks: an interval joins each block that
    it covers, a question its own. The join makes no more than `block` rows for each end of an interval beyond those
    that are returned, whatever a key has of both; a block is all that one key of the join has, so no key is hot.
    """
    return _near(intervals, asked, block).where("first <= n and n < last").select("key", "t", "owner")


def _near(intervals: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """key, t, owner, and n, the question's number, first and last, those that the interval holds, in blocks that they share."""
    i = cut(intervals.where("key is not null and valid_from is not null").select("key", "owner", "valid_from", F.nullif("valid_to", F.lit("")).alias("valid_to"), F.monotonically_increasing_id().alias("i")))
    event = lambda df, t, kind, i: df.select("key", F.col(t).isNull().alias("open"), F.col(t).alias("t"), F.lit(kind).alias("kind"), i.alias("i"))
    q = asked.where("key is not null and t is not null")
    events = event(i, "valid_from", 0, F.col("i")).unionByName(event(q, "t", 1, F.monotonically_increasing_id())).unionByName(event(i, "valid_to", 2, F.col("i")))
    placed = running(events, ["key", "open", "t", "kind", "i"], before=(F.col("kind") == 1).cast("int"))
    end = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("before")))
    spans = placed.where("kind <> 1").groupBy("i").agg(end(0).alias("first"), end(2).alias("last")).where("first < last").join(i.select("i", "owner"), "i")
    spans = spans.withColumn("b", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(last - 1) div {block}"))))
    numbers = placed.where("kind = 1").select("key", "t", F.col("before").alias("n"), F.expr(f"before div {block}").alias("b"))
    return numbers.join(spans, "b")


def latest_before(intervals: DataFrame, asked: DataFrame) -> DataFrame:
    """As-of: of each asked (key, t) the owner with the latest valid_from up to t, the larger owner on ties; null if none.

    Intervals and questions of a key are laid in one order of time, and each question takes the last owner before it, so
    the work is linear in both, whatever a key has of each.
    """
    starts = intervals.where("valid_from is not null").select("key", F.col("valid_from").alias("t"), F.lit(0).alias("asks"), "owner")
    rows = starts.unionByName(asked.select("key", "t").distinct().withColumns({"asks": F.lit(1), "owner": F.lit(None).cast(intervals.schema["owner"].dataType)}))
    last = F.last("owner", ignorenulls=True).over(Window.partitionBy("key").orderBy("t", "asks", "owner").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("owner", last).where("asks = 1").select("key", "t", "owner")
