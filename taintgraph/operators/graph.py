"""Graph operators over a flat edge table (src, dst, edge_type) and node table (node_id, node_type, label, props).

Edges are undirected for traversal. A breadth-first search joins the distinct frontier with the edges, never the
visited set, and cuts lineage once a hop, so a plan is as long as one hop whatever the depth. Every arbitrary choice is
a minimum, so results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgraph.session import cut
from taintgraph.vocab import HUB_DEGREE


def axis_edges(edges: DataFrame, axis: str, axes: dict[str, list[str]]) -> DataFrame:
    """Edges of one axis; an unknown axis is a KeyError."""
    return edges.where(F.col("edge_type").isin(axes[axis]))


def edges_of_types(edges: DataFrame, types: Iterable[str]) -> DataFrame:
    return edges.where(F.col("edge_type").isin(list(types)))


def symmetrise(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, distinct."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_hop: int, symmetric: bool = False) -> DataFrame:
    """(node_id, hop) of everything within ``max_hop`` of the seeds, which are at hop 0. No seeds give no rows.

    ``symmetric`` edges are stored in both directions already, for callers that search them more than once."""
    both = edges if symmetric else cut(symmetrise(edges), "both")
    reached = cut(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)), "reach")
    front = reached
    for hop in range(1, max_hop + 1):
        step = both.join(front.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct()
        front = cut(step.join(reached.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        reached = reached.union(front)
        if hop < max_hop and not front.limit(1).count():
            break
    return reached


def khop_neighbours(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    return bfs(edges, seeds, k).where("hop > 0")


def distance_to(edges: DataFrame, anchors: DataFrame, queries: DataFrame, max_hop: int) -> DataFrame:
    """(node_id, hop) of every query; hop is null where no anchor is within reach."""
    return queries.select("node_id").distinct().join(bfs(edges, anchors, max_hop), "node_id", "left")


def labelled_bfs(edges: DataFrame, seeds: DataFrame, max_hop: int) -> DataFrame:
    """(node_id, tag, hop): a search from all seeds (node_id, tag) at once, one wave per tag."""
    both = cut(symmetrise(edges), "both")
    reached = cut(seeds.select("node_id", "tag").distinct().withColumn("hop", F.lit(0)), "reach")
    front = reached
    for hop in range(1, max_hop + 1):
        step = front.select(F.col("node_id").alias("src"), "tag").join(both, "src").select(F.col("dst").alias("node_id"), "tag").distinct()
        front = cut(step.join(reached.select("node_id", "tag"), ["node_id", "tag"], "left_anti").withColumn("hop", F.lit(hop)), "reach")
        reached = reached.union(front)
    return reached


def typed_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, max_hop: int) -> DataFrame:
    """(node_id, hop, path) of the targets reached: path lists the edge types from the seed, joined by ``|``; of several
    shortest paths the smallest text is kept."""
    e = edges.select("src", "dst", "edge_type")
    both = cut(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")).distinct(), "both")
    reached = cut(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)).withColumn("path", F.lit("")), "reach")
    front = reached
    for hop in range(1, max_hop + 1):
        step = (
            front.select(F.col("node_id").alias("src"), "path")
            .join(both, "src")
            .groupBy(F.col("dst").alias("node_id"))
            .agg(F.min(F.when(F.col("path") == "", F.col("edge_type")).otherwise(F.concat_ws("|", "path", "edge_type"))).alias("path"))
        )
        front = cut(step.join(reached.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(hop).alias("hop"), "path"), "reach")
        reached = reached.union(front)
    return reached.join(targets.select("node_id").distinct(), "node_id", "left_semi")


def path_category(path: Column) -> Column:
    """The strongest relation on a path, in fixed order; a path of none of them goes by its first edge."""
    has = lambda *types: F.arrays_overlap(F.split(path, r"\|"), F.array(*[F.lit(t) for t in types]))
    return (
        F.when(path == "", "(seed)")
        .when(has("ligand_exact", "ligand_parent_exact", "ligand_fingerprint_exact"), "exact_ligand")
        .when(has("ligand_similar"), "similar_ligand")
        .when(has("ligand_scaffold"), "scaffold")
        .when(has("example_from_publication"), "publication")
        .when(has("example_from_assay"), "assay")
        .when(has("protein_in_cluster"), "protein_cluster")
        .otherwise(F.element_at(F.split(path, r"\|"), 1))
    )


def shared_neighbour_count(edges: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(node_id, n_shared): for each test example, the train examples on its reference nodes, counted per node.

    Train examples are counted per reference node before the join, so a hub node is one row."""
    e = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("ref")).distinct()
    per_ref = e.join(train.select("node_id").distinct(), "node_id", "left_semi").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    got = e.join(test.select("node_id").distinct(), "node_id", "left_semi").join(per_ref, "ref").groupBy("node_id").agg(F.sum("n").alias("n_shared"))
    return test.select("node_id").distinct().join(got, "node_id", "left").select("node_id", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): both ends of every edge count; ends are counted apart before they meet."""
    ends = [edges.groupBy(F.col(c).alias("node_id")).agg(F.count(F.lit(1)).alias("n")) for c in ("src", "dst")]
    return ends[0].union(ends[1]).groupBy("node_id").agg(F.sum("n").alias("degree"))


def flag_hubs(nodes: DataFrame, edges: DataFrame, cap: int = HUB_DEGREE) -> DataFrame:
    d = nodes.join(degrees(edges), "node_id", "left")
    return d.select(*[nodes[c] for c in nodes.columns if c != "is_hub"], F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) > cap).alias("is_hub"))


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("node_id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return edges


def drop_orphans(nodes: DataFrame, edges: DataFrame, pinned: Iterable[str] = ("DatasetSource", "DecoyProtocol")) -> DataFrame:
    """Nodes that an edge touches, and all nodes of the pinned types."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct()
    keep = F.col("node_type").isin(list(pinned))
    return nodes.where(keep).union(nodes.where(~keep).join(ends, "node_id", "left_semi").select(nodes.columns))


def rewrite_ids(nodes: DataFrame, edges: DataFrame, new_id) -> tuple[DataFrame, DataFrame]:
    """Entity resolution by a rule on ids: nodes keep one row per new id (column minima), edges are only rewritten."""
    others = [c for c in nodes.columns if c != "node_id"]
    n = nodes.withColumn("node_id", new_id(F.col("node_id"))).groupBy("node_id").agg(*[F.min(c).alias(c) for c in others])
    return n, edges.withColumns({"src": new_id(F.col("src")), "dst": new_id(F.col("dst"))})


def star_bridges(members: DataFrame, key: str, member: str) -> DataFrame:
    """(src, dst): within each key the smallest member is linked to every other; lone members get none."""
    m = members.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member).distinct()
    first = m.groupBy(key).agg(F.min(member).alias("src"))
    return m.join(first, key).where(F.col(member) != F.col("src")).select("src", F.col(member).alias("dst")).distinct()


def canonical_pairs(edges: DataFrame, types: Iterable[str]) -> DataFrame:
    """Undirected edges of the given types once, the smaller end first; the others as they are."""
    hit = F.col("edge_type").isin(list(types))
    pairs = edges.where(hit).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "edge_type").distinct()
    return pairs.union(edges.where(~hit).select("src", "dst", "edge_type"))


def contract_paths(left: DataFrame, right: DataFrame, cap: int | None = None) -> DataFrame:
    """(src, dst) of two-edge paths left.src - mid - right.dst, distinct before and after the join.

    ``left``: src, mid; ``right``: mid, dst. With ``cap`` only the first so many dst of each mid are kept."""
    from pyspark.sql import Window

    r = right.select("mid", "dst").distinct()
    if cap is not None:
        r = r.withColumn("rn", F.row_number().over(Window.partitionBy("mid").orderBy("dst"))).where(F.col("rn") <= cap).drop("rn")
    return left.select("src", "mid").distinct().join(r, "mid").select("src", "dst").distinct()


def residual_leak(edges: DataFrame, train: DataFrame, test: DataFrame, axes: dict[str, list[str]], hops: int) -> DataFrame:
    """(axis, k, n_test, n_leak, pct_leak) for k = 1..hops. An axis without edges leaks nothing; no test gives NaN.

    All axes run in one search: an axis is the tag of its wave."""
    rows = [(a, t) for a, ts in axes.items() for t in ts]
    spark = edges.sparkSession
    m = spark.createDataFrame(rows, "axis string, edge_type string")
    tagged = edges.join(F.broadcast(m), "edge_type").select("axis", "src", "dst")
    both = cut(tagged.union(tagged.select("axis", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    names = spark.createDataFrame([(a,) for a in axes], "axis string")
    seeds = cut(train.select("node_id").distinct(), "seeds")  # every wave leaves them out
    # every axis starts from the same seeds; its first wave is a semi join with them
    seen = [cut(both.join(seeds.withColumnRenamed("node_id", "src"), "src", "left_semi").select("axis", F.col("dst").alias("node_id")).distinct().join(seeds, "node_id", "left_anti").select("axis", "node_id", F.lit(1).alias("hop")), "wave")]
    for hop in range(2, hops + 1):
        step = both.join(seen[-1].select("axis", F.col("node_id").alias("src")), ["axis", "src"], "left_semi").select("axis", F.col("dst").alias("node_id")).distinct()
        known = seen[0]
        for w in seen[1:]:
            known = known.union(w)
        fresh = step.join(known.select("axis", "node_id"), ["axis", "node_id"], "left_anti").join(seeds, "node_id", "left_anti")
        seen.append(cut(fresh.select("axis", "node_id", F.lit(hop).alias("hop")), "wave"))
    known = seen[0]
    for w in seen[1:]:
        known = known.union(w)
    t = test.select("node_id").distinct()
    hit = known.join(t, "node_id", "left_semi").groupBy("axis").agg(*[F.sum((F.col("hop") <= k).cast("long")).alias(f"k{k}") for k in range(1, hops + 1)])
    total = t.agg(F.count(F.lit(1)).alias("n_test"))
    ks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"k{k}", F.lit(0)).alias("n")) for k in range(1, hops + 1)]))
    out = names.join(hit, "axis", "left").select("axis", ks.alias("x")).select("axis", "x.*").withColumn("n_test", total.scalar())
    return out.select("axis", "k", "n_test", F.col("n").alias("n_leak"), F.when(F.col("n_test") == 0, F.lit(float("nan"))).otherwise(F.col("n") * 100 / F.col("n_test")).alias("pct_leak"))
