"""Splits that keep related records together.

Records sharing an entity, directly or over others, form components of the entity graph. Components are found by
random-mate contraction: in each round every vertex draws a coin, each tail collapses into its smallest heads
neighbour, and the edges are relabelled, until no edge is left. The collapses form a forest whose labels are unwound
by pointer doubling. Components then go to folds by cumulative weight.

A record joins its entities as a star around the smallest one, so records never become vertices and a hot entity is
one vertex; relabelling joins carry it on the edge side only, where AQE may split it.

Defined cases: rows with a null record or entity are dropped; repeated memberships count once; a record without any
entity is a component of its own; ties in weight go by hash order; empty input gives an empty result; extra columns
are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgraph.session import cut, discard


def _heads(v: Column, round_no: int) -> Column:
    return F.xxhash64(v, F.lit(round_no)).bitwiseAND(F.lit(1)) == 1


def memberships(members: DataFrame) -> DataFrame:
    """(record, entity) without nulls and repetitions, and without any other column."""
    return members.select("record", "entity").where("record is not null and entity is not null").distinct()


def entity_edges(members: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, linking each record's smallest entity to its others. ``members``: record, entity."""
    anchor = members.groupBy("record").agg(F.min("entity").alias("a"), F.max("entity").alias("top"))
    linked = anchor.where("a < top").select("record", "a")  # records of one entity link nothing
    return members.join(linked, "record").where("entity <> a").select("a", F.col("entity").alias("b")).distinct()


def _round(edges: DataFrame, round_no: int) -> tuple[DataFrame, DataFrame]:
    """(edges after one round, its collapses (v, to)): every tail goes into its smallest heads neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tails = both.where(~_heads(F.col("a"), round_no) & _heads(F.col("b"), round_no))
    moved = tails.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "v")
    ma = moved.select(F.col("v").alias("a"), F.col("to").alias("ta"))
    mb = moved.select(F.col("v").alias("b"), F.col("to").alias("tb"))
    x = edges.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
    return x.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), moved


def random_mate(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(v, root) for every vertex that collapsed into another; vertices that are roots are not listed.

    A job runs a round and writes the edges that are left together with the collapses."""
    spark = edges.sparkSession
    cur, written, forest, rounds = cut(edges.select("a", "b"), "edges"), [], [], 0
    written.append(cur)
    while cur.limit(1).count():
        if rounds >= max_rounds:
            raise RuntimeError("contraction did not end")
        rounds += 1
        left, moved = _round(cur, rounds)
        t = cut(left.select(F.lit(True).alias("open"), "a", "b").union(moved.select(F.lit(False).alias("open"), F.col("v").alias("a"), F.col("to").alias("b"))), "round")
        written.append(t)
        cur = t.where("open").select("a", "b")
        forest.append(t.where("not open").select(F.col("a").alias("v"), F.col("b").alias("root")))
    if not forest:
        return spark.createDataFrame([], "v string, root string")
    f = forest[0]
    for m in forest[1:]:
        f = f.union(m)
    for _ in range(math.ceil(math.log2(rounds + 1))):
        up = f.select(F.col("v").alias("root"), F.col("root").alias("above"))
        f = f.join(up, "root", "left").select("v", F.coalesce("above", "root").alias("root"))
        f = cut(f, "forest")
        written.append(f)
    for t in written[:-1]:
        discard(t)
    return f


def components(members: DataFrame) -> DataFrame:
    """(entity, root) for every entity of ``members`` (record, entity)."""
    members = memberships(members)
    roots = random_mate(entity_edges(members))
    every = members.select("entity").distinct()
    return every.join(roots.withColumnRenamed("v", "entity"), "entity", "left").select("entity", F.coalesce("root", "entity").alias("root"))


def record_roots(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(record, root): all entities of a record lie in one component, so one of them tells it."""
    return members.groupBy("record").agg(F.min("entity").alias("entity")).join(comps, "entity").select("record", "root")


def torn_entities(members: DataFrame, folds: DataFrame) -> DataFrame:
    """Entities whose records lie in more than one fold. ``folds``: record, fold.

    The folds of a component are gathered over its records first. A component within one fold is whole, and so are its
    entities; only the memberships of the others are read again, entity by entity."""
    members = cut(memberships(members), "members")
    folds = folds.select("record", "fold").where("record is not null and fold is not null").distinct()
    comps = cut(components(members), "components")
    spans = record_roots(members, comps).join(folds, "record").groupBy("root").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    torn = comps.join(spans.where("lo < hi").select("root"), "root", "left_semi").select("entity")
    inside = members.join(torn, "entity", "left_semi").join(folds, "record").groupBy("entity").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    return inside.where("lo < hi").select("entity")


def assign_folds(weights: DataFrame, shares: dict[str, float], big: float = 0.001) -> DataFrame:
    """(root, fold) from component weights (root, weight), near the given shares.

    Components holding at least ``big`` of all weight are at most ``1 / big``, so they are placed one by one, the
    largest first, into the fold that lacks most. The others follow in hash order by cumulative weight: bucket sums
    first (4,096 rows), then positions within each bucket, so that no window spans the whole table."""
    spark = weights.sparkSession
    total = weights.agg(F.sum("weight")).first()[0] or 0
    names = list(shares)
    if not total:
        return spark.createDataFrame([], "root string, fold string")
    heavy = weights.where(F.col("weight") >= big * total).collect()
    need = {f: s * total for f, s in shares.items()}
    placed = []
    for r in sorted(heavy, key=lambda r: (-r["weight"], r["root"])):
        f = max(names, key=lambda f: (need[f], -names.index(f)))
        need[f] -= r["weight"]
        placed.append((r["root"], f))
    small = weights.where(F.col("weight") < big * total).select("root", "weight", F.md5("root").alias("h"))
    small = small.withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sums = small.groupBy("bucket").agg(F.sum("weight").alias("w")).withColumn("before", F.coalesce(F.sum("w").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0)
    x = small.join(F.broadcast(sums.select("bucket", "before")), "bucket").withColumn("upto", F.col("before") + F.sum("weight").over(within))
    room = sum(max(n, 0.0) for n in need.values()) or 1.0
    rest = total - sum(r["weight"] for r in heavy)
    fold, edge = F.lit(names[0]), 0.0
    bounds = []
    for f in names:
        edge += max(need[f], 0.0) / room * rest
        bounds.append((f, edge))
    fold = F.lit(bounds[-1][0])
    for f, e in reversed(bounds[:-1]):
        fold = F.when(F.col("upto") <= e + 0.5, f).otherwise(fold)
    return x.select("root", fold.alias("fold")).union(spark.createDataFrame(placed, "root string, fold string"))


def grouped_split(members: DataFrame, records: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(record, root, fold) for every record; all records of a component get one fold. root: its smallest entity, or
    ``record:`` and the record's id where it has none."""
    members = cut(memberships(members), "members")
    comps = cut(components(members), "components")
    least = comps.groupBy("root").agg(F.min("entity").alias("low"))
    named = comps.join(least, "root").select("entity", F.col("low").alias("root"))
    placed = cut(
        records.select("record").where("record is not null").distinct().join(record_roots(members, named), "record", "left").select("record", F.coalesce("root", F.concat(F.lit("record:"), "record")).alias("root")),
        "placed",
    )
    weights = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("weight")), "weights")
    return placed.join(assign_folds(weights, shares), "root").select("record", "root", "fold")
