"""Neighbourhoods and paths: unrolled joins on the adjacency, with stated orders in place of unordered limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, at_ids, cut, few_ids, first_per
from ..schema import GraphSchema


#: Types that are walked whatever a question asks for.
CONFLICT_TYPES = ("CONTRADICTS", "SUPERSEDES")


def focus_types(focus: Sequence[str], schema: GraphSchema) -> list[str]:
    """The types to walk: the asked ones and the schema's conflict types, each once; all of the schema's if none is asked."""
    known = [t.name for t in schema.rel_types]
    return list(dict.fromkeys([*focus, *(t for t in known if t in CONFLICT_TYPES)])) if focus else known


def one_hop(graph: Graph, seeds: DataFrame, rel_type: str, direction: str = "outgoing") -> DataFrame:
    """seed, rel_type and the neighbour's columns for each edge of a type at a seed (column id).

    Nodes are merged, never sent to all tasks: the size of the files they are derived from tells little of theirs.
    """
    hop = at_ids(graph.adjacency([rel_type], direction), seeds)
    hop = seeds.select(F.col("id").alias("seed")).join(hop, F.col("seed") == F.col("at"))
    return hop.select("seed", "rel_type", F.col("id").alias("edge"), F.col("to").alias("id")).join(graph.nodes.hint("merge"), "id")


def expand(graph: Graph, seeds: DataFrame, rel_types: Sequence[str] | None = None, most: int = 200) -> DataFrame:
    """Edges at the seeds in either direction, at most `most` for each label of seeds, by edge id and seed."""
    hop = seeds.select(F.col("id").alias("at")).join(at_ids(graph.adjacency(rel_types), seeds), "at")
    return first_per(hop, ["at_label"], "id", "at", "to", most=most)


def path_steps(graph: Graph, seeds: DataFrame, rel_types: Sequence[str], direction: str = "outgoing", most: int = 3) -> Iterator[DataFrame]:
    """start, end, hops, nodes, edges of the paths of one hop, then of two, and so on; their edges are distinct.

    Each hop is written before it is given, so the next one reads the edges at its ends only.
    """
    adj = graph.adjacency(rel_types, direction)
    now = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
    for hops in range(1, most + 1):
        step = at_ids(adj, now.select(F.col("end").alias("id"))).select("at", "to", F.col("id").alias("edge"))
        now = now.join(step, F.col("end") == F.col("at")).where(~F.array_contains("edges", F.col("edge")))
        now = cut(now.select("start", F.col("to").alias("end"), F.lit(hops).alias("hops"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges")))
        yield now


def paths(graph: Graph, seeds: DataFrame, rel_types: Sequence[str], direction: str = "outgoing", least: int = 1, most: int = 3, target: int | None = None, limit: int | None = None) -> DataFrame:
    """All paths of `least` to `most` hops, to a target if one is named; or the first `limit` by hops, nodes and edges.

    Since fewer hops come first, no hop is made once shorter paths fill the limit.
    """
    found, n = None, 0
    for hops, step in enumerate(path_steps(graph, seeds, rel_types, direction, most), 1):
        if hops < least:
            continue
        step = step if target is None else step.where(F.col("end") == target)
        found = step if found is None else found.unionByName(step)
        if limit is not None:
            n += step.limit(limit - n).count()
            if n >= limit:
                break
    return found if limit is None else found.orderBy("hops", "nodes", "edges").limit(limit)


def bounded(graph: Graph, seeds: DataFrame, rel_types: Sequence[str], direction: str, least: int, most: int, limit: int = 200) -> DataFrame:
    """Ends of variable-length paths, the first `limit` by hops and path."""
    return paths(graph, seeds, rel_types, direction, least, most, limit=limit)


def _between(graph: Graph, seeds: DataFrame, target: int, rel_types: Sequence[str], direction: str, most: int) -> Iterator[list[DataFrame]]:
    """For one hop, two and so on up to `most`: the nodes that walks of so many hops from a seed to the target have at each place.

    Frontiers grow from both ends and meet in the middle; from there each side is walked back through its own. A table
    holds each node once, so no more is written than a node for each side and hop, however many walks there are. Numbers
    of hops that reach nothing give nothing.
    """
    there = graph.adjacency(rel_types, direction)
    back = graph.adjacency(rel_types, {"outgoing": "incoming", "incoming": "outgoing"}.get(direction, direction))
    near = lambda adj, ids: at_ids(adj, ids).select(F.col("to").alias("id")).distinct()
    ahead, behind = [cut(seeds.select("id").distinct())], [seeds.sparkSession.createDataFrame([(target,)], "id bigint")]
    for hops in range(1, most + 1):
        half = (hops + 1) // 2
        if len(ahead) <= half:
            ahead.append(cut(near(there, ahead[-1])))
        if len(behind) <= hops - half:
            behind.append(cut(near(back, behind[-1])))
        at = {half: cut(ahead[half].join(behind[hops - half], "id", "left_semi"))}
        if at[half].isEmpty():
            continue
        for i in range(half - 1, -1, -1):
            at[i] = cut(near(back, at[i + 1]).join(ahead[i], "id", "left_semi"))
        for i in range(half + 1, hops + 1):
            at[i] = cut(near(there, at[i - 1]).join(behind[hops - i], "id", "left_semi"))
        yield [at[i] for i in range(hops + 1)]


def _first_through(adj: DataFrame, places: list[DataFrame], keep: int) -> tuple[DataFrame, bool]:
    """The paths through the given nodes whose nodes come first: of every length, the first `keep` lists of nodes go on.

    Every list can reach the end, and what goes on comes before what does not, so what is found are the first paths; but
    paths that would repeat an edge are none, so it may be fewer than `keep`. The flag says that some did not go on.
    """
    now, left = places[0].select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("edges")), False
    for place in places[1:]:
        step = at_ids(adj, now.select(F.col("end").alias("id"))).join(place.withColumnRenamed("id", "to"), "to", "left_semi").select("at", "to", F.col("id").alias("edge"))
        now = now.join(step, F.col("end") == F.col("at")).where(~F.array_contains("edges", F.col("edge")))
        now = cut(now.select("start", F.col("to").alias("end"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges")))
        first = cut(now.select("nodes").distinct().orderBy("nodes").limit(keep + 1))
        if first.count() > keep:
            now, left = now.join(first.orderBy("nodes").limit(keep), "nodes", "left_semi"), True
    return now.select("start", "end", F.lit(len(places) - 1).alias("hops"), "nodes", "edges"), left


def shortest_paths(graph: Graph, seeds: DataFrame, target: int, rel_types: Sequence[str], direction: str = "outgoing", most: int = 3, count: int = 5) -> DataFrame:
    """start, end, hops, nodes, edges, weight, cost: the first `count` paths to the target by hops, nodes and edges, of at
    most `most` hops and with distinct edges; weight and cost are the number of hops.

    Only nodes between both ends are read, and of the paths among them only the first are made; parallel edges between
    two nodes each make a path.
    """
    found, n, adj = None, 0, graph.adjacency(rel_types, direction)
    for places in _between(graph, seeds, target, rel_types, direction, most):
        keep = count - n
        step, left = _first_through(adj, places, keep)
        while left and step.limit(count - n).count() < count - n:
            keep *= 8
            step, left = _first_through(adj, places, keep)
        found = step if found is None else found.unionByName(step)
        n += step.limit(count - n).count()
        if n >= count:
            break
    if found is None:
        found = seeds.sparkSession.createDataFrame([], "start bigint, end bigint, hops int, nodes array<bigint>, edges array<bigint>")
    found = found.orderBy("hops", "nodes", "edges").limit(count)
    return found.withColumns({"weight": F.col("hops").cast("double"), "cost": F.col("hops").cast("double")})


def single_source_paths(graph: Graph, seeds: DataFrame, rel_types: Sequence[str], direction: str = "outgoing", most: int = 3, count: int = 20) -> DataFrame:
    return paths(graph, seeds, rel_types, direction, 1, most, limit=count)


def budgeted(graph: Graph, seeds: DataFrame, rel_types: Sequence[str] | None = None, hops: int = 3, most_nodes: int = 40, most_rows: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, hop, label), (edges: src, rel_type, dst): breadth-first expansion with a budget that includes the seeds.

    In each hop a label's frontier brings at most `most_rows` edges, by edge id; new nodes are taken by edge id and id
    until the budget is full. Parallel edges of one type collapse; edges to nodes that did not fit go. The budgets are
    the feature: a frontier is `most_nodes` ids at most and goes into the scan as a filter, and a hop brings no more
    than `most_rows` edges for each of its labels, so what is kept between hops is small whatever the graph is.
    """
    spark = graph.nodes.sparkSession
    adj = graph.adjacency(rel_types)
    few = few_ids(seeds)
    start = graph.nodes.where(F.col("id").isin(few) if few else F.lit(False)) if few is not None else graph.nodes.join(seeds.select("id").distinct(), "id", "left_semi")
    seen = {r["id"]: (0, r["label"]) for r in start.select("id", "label").orderBy("id").limit(most_nodes).collect()}
    frontier = list(seen)
    trace: set[tuple[int, str, int]] = set()
    for hop in range(1, hops + 1):
        frontier = [i for i in frontier if seen[i][1]]
        if not frontier:
            break
        rows = first_per(adj.where(F.col("at").isin(frontier)), ["at_label"], "id", "at", "to", most=most_rows).select("src", "rel_type", "dst", "id", "to", "to_label").collect()
        trace |= {(r["src"], r["rel_type"], r["dst"]) for r in rows}
        fresh: dict[int, tuple[int, str]] = {}
        for r in rows:
            if r["to"] not in seen:
                fresh[r["to"]] = min(fresh.get(r["to"], (r["id"], r["to_label"])), (r["id"], r["to_label"]))
        taken = sorted(fresh, key=lambda i: (fresh[i][0], i))[: most_nodes - len(seen)]
        seen |= {i: (hop, fresh[i][1]) for i in taken}
        frontier = taken
    nodes = spark.createDataFrame([(i, h, label) for i, (h, label) in seen.items()], "id bigint, hop int, label string")
    return nodes, spark.createDataFrame(sorted(x for x in trace if x[0] in seen and x[2] in seen), "src bigint, rel_type string, dst bigint")


def layers(nodes: DataFrame, edges: DataFrame, roots: DataFrame, rounds: int) -> DataFrame:
    """id, layer of each id of the nodes: the longest walk from a root in at most `rounds` steps, which bounds walks on cycles.

    A round goes on from the ends of the one before, each once, which are looked up by hash; so edges are dealt by their
    source once for all rounds and never sorted, and the nodes are dealt once.
    """
    at = roots.select("id").where("id is not null").distinct()
    steps = edges.select("src", "dst").where("src is not null and dst is not null")
    found = nodes.select("id")
    for n in range(1, rounds + 1):
        at = at.hint("shuffle_hash").join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        found = found.join(at.select("id", F.lit(n).alias(f"_{n}")).hint("shuffle_hash"), "id", "left")
    layer = F.coalesce(*[F.col(f"_{n}") for n in range(rounds, 0, -1)], F.lit(0))
    return found.groupBy("id").agg(F.max(layer).alias("layer"))
