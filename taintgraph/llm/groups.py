"""Consolidating pairwise matches into groups.

The component of the highest-degree vertex is peeled first: a breadth-first search by frontier joins collects it, and
an anti join takes it off the edge list. A search that stops growing (a long chain hanging on the giant) is left off
with its frontier open; what it reached is contracted into one vertex. Everything that remains is labelled by
propagating minima: each round links every larger neighbour to the smallest one (large star) and then every smaller
neighbour (small star), which ends in a star per component after a logarithmic number of rounds also on long chains.

Joins carry a hot vertex on the edge side only, against one aggregated row, so AQE can split it. Nothing but counts
and the hub's id comes to the driver.

Defined cases: pairs with a null or blank end are dropped; self pairs make a group of one; repeated pairs and both
directions count once; ties for the highest degree go to the smallest id; empty input gives no groups; extra columns
are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgraph.session import cut, discard


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _print(e: DataFrame) -> tuple:
    """Fingerprint of an edge set: one row."""
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def peel_giant(edges: DataFrame, max_hops: int = 18, min_growth: float = 0.05) -> tuple[DataFrame, DataFrame, str | None]:
    """(edges without the giant, giant's vertices (v), its smallest id).

    ``edges``: distinct a < b. A hop joins the frontier with the edges and takes off the last two frontiers: neighbours of
    a level lie in it, in the one before or in the next, so nothing else can have been reached already. Hops end when the frontier is empty,
    when three of them added less than ``min_growth`` of what was reached, or after ``max_hops``; then
    the reached vertices become one vertex under their smallest id, and their open edges stay in the list."""
    spark = edges.sparkSession
    both = _both_ways(edges)
    hub = both.groupBy("a").agg(F.count(F.lit(1)).alias("deg")).agg(F.max_by("a", F.struct("deg", F.col("a"))).alias("v"), F.max("deg").alias("deg")).first()
    if hub["v"] is None:
        return edges, spark.createDataFrame([], "v string"), None
    front = spark.createDataFrame([(hub["v"],)], "v string")
    parts, last, added, done = [front], front, [1], False
    for _ in range(max_hops):
        step = both.join(front.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).distinct()
        new = cut(step.join(last, "v", "left_anti"), "frontier")
        added.append(new.count())
        parts.append(new)
        if not added[-1]:
            done = True
            break
        last, front = front.union(new), new
        if len(added) > 3 and sum(added[-3:]) < min_growth * sum(added):
            break
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.union(p)
    low = seen.agg(F.min("v")).first()[0]
    if done:
        return edges.join(seen.withColumnRenamed("v", "a"), "a", "left_anti"), seen, low
    return contract(edges, seen.select("v", F.lit(low).alias("to"))), seen, low


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``mapping`` (v, to); self edges and repetitions go."""
    m = mapping.select(F.col("v").alias("a"), F.col("to").alias("ta"))
    n = mapping.select(F.col("v").alias("b"), F.col("to").alias("tb"))
    x = edges.join(m, "a", "left").join(n, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
    return x.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def min_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a < b): root is the smallest id of its component."""
    cur = cut(edges.select("a", "b"), "edges")
    mark = _print(cur)
    for _ in range(max_rounds):
        both = _both_ways(cur)
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("low").alias("a"), F.col("b").alias("b")).distinct()
        # small star: every vertex hands its smaller neighbours, and itself, to the smallest of them
        small_low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(small_low.hint("merge"), "b").select("low", F.explode(F.array("a", "b")).alias("v")).where("v <> low")
        nxt = cut(small.select(F.col("low").alias("a"), F.col("v").alias("b")).distinct(), "edges")
        seen, mark = mark, _print(nxt)
        discard(cur)
        cur = nxt
        if mark == seen:
            break
    else:
        raise RuntimeError("minimum propagation did not end")
    return cur.select(F.col("b").alias("v"), F.col("a").alias("root")).union(cur.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())


def group_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node_id, group_id) for every id in a pair whose two ends are ids; group_id is the group's smallest id."""
    p = pairs.select(pairs[a].alias("a"), pairs[b].alias("b")).where("a is not null and b is not null and a <> '' and b <> ''")
    norm = cut(p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    edges = norm.where("a < b")
    rest, giant, low = peel_giant(edges)
    labels = min_labels(rest)
    # the giant's contracted vertex may have been given a smaller root in what remained
    out = labels
    if low is not None:
        root = labels.where(F.col("v") == low).agg(F.min("root")).first()[0]
        out = labels.join(giant, "v", "left_anti").union(giant.select("v", F.lit(root or low).alias("root")))
    own = norm.where("a = b").select(F.col("a").alias("v"), F.lit(None).cast("string").alias("root"))
    return out.union(own).groupBy("v").agg(F.min("root").alias("root")).select(F.col("v").alias("node_id"), F.coalesce("root", "v").alias("group_id"))
