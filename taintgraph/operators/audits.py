"""Audits of predictions against the graph. ``pred``: example_id, source, score, label, fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taintgraph.functions.stats import DELTA_REPS, INTERVAL_REPS, auroc, bootstrap_interval, delta_test
from taintgraph.operators.graph import bfs, labelled_bfs, path_category, shared_neighbour_count, typed_paths
from taintgraph.session import cut


def check_predictions(pred: DataFrame) -> DataFrame:
    """The predictions contract: needed columns present; rows without id, score or label are dropped, null folds stay."""
    need = ["example_id", "score", "label", "fold"]
    missing = [c for c in need if c not in pred.columns]
    if missing:
        raise ValueError(f"predictions lack {missing}")
    return pred.where("example_id is not null and score is not null and label is not null")


def _nodes(pred: DataFrame, fold: str) -> DataFrame:
    return pred.where(F.col("fold") == fold).select(F.col("example_id").alias("node_id"))


def shared_provenance_tags(pred: DataFrame, edges: DataFrame) -> DataFrame:
    """Test predictions with the number of train examples on their publications and assays, and the flags."""
    out = pred.where("fold = 'test'")
    for name, kind in (("pub", "example_from_publication"), ("assay", "example_from_assay")):
        n = shared_neighbour_count(edges.where(F.col("edge_type") == kind), _nodes(pred, "train"), _nodes(pred, "test"))
        out = out.join(n.select(F.col("node_id").alias("example_id"), F.col("n_shared").alias(f"n_{name}")), "example_id")
    return out.withColumns({"share_pub": F.col("n_pub") > 0, "share_assay": F.col("n_assay") > 0})


def provenance_delta(tags: DataFrame, reps: int = DELTA_REPS) -> DataFrame:
    """Per source: AUROC of predictions sharing a publication with train less that of the others, with interval and p."""
    return delta_test(tags, ["source"], "share_pub", "example_id", reps)


def path_atlas(pred: DataFrame, edges: DataFrame, threshold: float = 0.5, max_hop: int = 4) -> DataFrame:
    """(example_id, source, hop, category) of mispredicted test examples: the kind of path that leads to train."""
    wrong = pred.where("fold = 'test'").where(
        ((F.col("label") == 1) & (F.col("score") < threshold)) | ((F.col("label") == 0) & (F.col("score") >= threshold))
    )
    p = typed_paths(edges, _nodes(pred, "train"), wrong.select(F.col("example_id").alias("node_id")), max_hop)
    p = p.select(F.col("node_id").alias("example_id"), "hop", path_category(F.col("path")).alias("category"))
    x = wrong.select("example_id", "source").join(p, "example_id", "left")
    return x.select("example_id", "source", F.coalesce("hop", F.lit(-1)).alias("hop"), F.coalesce("category", F.lit("unreachable")).alias("category"))


def path_atlas_counts(atlas: DataFrame, top: int = 3) -> DataFrame:
    """Per source and category the mispredictions, and which categories are among its ``top``."""
    n = atlas.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "category"))
    return n.withColumn("place", rank).withColumn("is_top", F.col("place") <= top)


def cross_corpus_matrix(examples: DataFrame, edges: DataFrame, max_hop: int = 2) -> DataFrame:
    """(train_source, test_source, k, n_test, n_reached): all corpora spread at once, each under its own tag."""
    e = examples.where("source is not null").select("node_id", "source")
    reach = labelled_bfs(edges, e.select("node_id", F.col("source").alias("tag")), max_hop)
    hit = reach.join(e, "node_id").where("source <> tag").groupBy(F.col("tag").alias("train_source"), F.col("source").alias("test_source"), "hop").agg(F.count(F.lit(1)).alias("n"))
    sizes = e.groupBy("source").agg(F.count(F.lit(1)).alias("n_test"))
    names = sizes.select(F.col("source").alias("train_source"))
    grid = sizes.withColumnRenamed("source", "test_source").join(names, F.col("train_source") != F.col("test_source"))
    ks = grid.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_hop))))
    x = ks.join(hit.alias("h"), (ks["train_source"] == F.col("h.train_source")) & (ks["test_source"] == F.col("h.test_source")) & (F.col("h.hop") <= ks["k"]), "left")
    return x.groupBy(ks["train_source"], ks["test_source"], "k", "n_test").agg(F.coalesce(F.sum("h.n"), F.lit(0)).alias("n_reached"))


def cross_corpus_pivot(matrix: DataFrame, k: int, sources: list[str]) -> DataFrame:
    m = matrix.where(F.col("k") == k).withColumn("pct", F.round(F.col("n_reached") * 100 / F.col("n_test"), 6))
    return m.groupBy("train_source").pivot("test_source", sources).agg(F.max("pct"))


def cross_corpus_pivots(matrix: DataFrame) -> DataFrame:
    """(train_source, k, a column for every test source there is): per cent reached within k hops, for every k."""
    m = cut(matrix.withColumn("pct", F.round(F.col("n_reached") * 100 / F.col("n_test"), 6)), "matrix")  # read for its sources, too
    return m.groupBy("train_source", "k").pivot("test_source").agg(F.max("pct"))


def horizon_curve(pred: DataFrame, edges_by_axis: dict[str, DataFrame], max_hop: int = 5, least: int = 5) -> DataFrame:
    """(axis, source, hop, n, auroc): how AUROC falls with the distance from train; 99 means out of reach."""
    out = None
    for axis, e in edges_by_axis.items():
        d = bfs(e, _nodes(pred, "train"), max_hop).select(F.col("node_id").alias("example_id"), "hop")
        t = pred.where("fold = 'test'").join(d, "example_id", "left").withColumn("hop", F.coalesce("hop", F.lit(99)))
        a = auroc(t, ["source", "hop"]).withColumn("n", F.col("n_pos") + F.col("n_neg")).where(F.col("n") >= least)
        part = a.select(F.lit(axis).alias("axis"), "source", "hop", "n", "auroc")
        out = part if out is None else out.union(part)
    return out


def hub_partition(pred: DataFrame, nodes: DataFrame, edges: DataFrame, max_hop: int = 2) -> DataFrame:
    """(source, near_hub, n, auroc) of test predictions within ``max_hop`` of a hub and beyond; with no hub all are far."""
    d = bfs(edges, nodes.where("is_hub").select("node_id"), max_hop).select(F.col("node_id").alias("example_id"), F.lit(True).alias("near"))
    t = pred.where("fold = 'test'").join(d, "example_id", "left").withColumn("near_hub", F.coalesce("near", F.lit(False)))
    a = auroc(t, ["source", "near_hub"])
    return a.select("source", "near_hub", (F.col("n_pos") + F.col("n_neg")).alias("n"), "auroc")


def dirty_negatives(labelled: DataFrame, sample: int = 3) -> DataFrame:
    """Negatives whose content is a known positive for a different target: example_id, source, lig, target, n_other,
    other_sample. ``labelled``: example_id, source, lig, target, label. Positives are reduced to distinct
    (lig, target) before the join."""
    pos = labelled.where("label = 1 and lig is not null and target is not null").select("lig", F.col("target").alias("other")).distinct()
    neg = labelled.where("label = 0 and lig is not null and target is not null").select("example_id", "source", "lig", "target").distinct()
    hit = neg.select("lig", "target").distinct().join(pos, "lig").where("other <> target")
    per = hit.groupBy("lig", "target").agg(F.count(F.lit(1)).alias("n_other"), F.slice(F.sort_array(F.collect_set("other")), 1, sample).alias("other_sample"))
    return neg.join(per, ["lig", "target"]).select("example_id", "source", "lig", "target", "n_other", "other_sample")


def dirty_negative_summary(labelled: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, n_negatives, n_dirty, pct_dirty) by distinct example."""
    n = labelled.where("label = 0").groupBy("source").agg(F.countDistinct("example_id").alias("n_negatives"))
    d = rows.groupBy("source").agg(F.countDistinct("example_id").alias("n_dirty"))
    return n.join(d, "source", "left").select("source", "n_negatives", F.coalesce("n_dirty", F.lit(0)).alias("n_dirty"), F.round(F.coalesce("n_dirty", F.lit(0)) * 100 / F.col("n_negatives"), 2).alias("pct_dirty"))


def retrospective(pred: DataFrame, edges: DataFrame, hops: int = 2, anchor: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(source, part, n, auroc) for all, leaking and clean test predictions; ``anchor`` replaces the train fold."""
    reach = bfs(edges, anchor if anchor is not None else _nodes(pred, "train"), hops).select(F.col("node_id").alias("example_id"), F.lit(True).alias("hit"))
    t = cut(pred.where("fold = 'test'").join(reach, "example_id", "left").withColumn("part", F.when(F.col("hit"), "leak").otherwise("clean")).drop("hit"), "tagged")
    every = t.unionByName(t.withColumn("part", F.lit("all")))
    a = auroc(every, ["source", "part"]).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return a.where(F.col("n") >= least).select("source", "part", "n", "auroc")


def compare_models(pred: DataFrame, reps: int = INTERVAL_REPS) -> DataFrame:
    """(model, source, point, lower, upper, n_pos, n_neg) of test predictions."""
    return bootstrap_interval(pred.where("fold = 'test'"), ["model", "source"], "example_id", reps)


def nearest_label_scores(examples: DataFrame, edges: DataFrame) -> DataFrame:
    """A baseline without features: the mean label of the nearest train examples (one hop, else two over a shared
    node); train rows score their own label, unreached rows 0.5. ``examples``: node_id, label, fold.

    Labels are first reduced per shared node to whether it holds a positive and a negative train example, so the two-hop
    mean weighs shared nodes, not their train examples, and a hub is one row."""
    e = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    train = examples.where("fold = 'train' and label in (0, 1)").select("node_id", "label")
    rest = examples.where("fold <> 'train'").select("node_id")
    one = rest.join(e.withColumnRenamed("src", "node_id"), "node_id").join(train.select(F.col("node_id").alias("dst"), "label"), "dst").select("node_id", "label").distinct()
    one = one.groupBy("node_id").agg(F.avg("label").alias("score1"))
    mids = e.join(train.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("mid")).agg(F.countDistinct("label").alias("m"), F.sum_distinct("label").alias("s"))
    two = rest.join(e.select(F.col("src").alias("node_id"), F.col("dst").alias("mid")), "node_id").distinct().join(mids, "mid")
    two = two.groupBy("node_id").agg((F.sum("s") / F.sum("m")).alias("score2"))
    own = examples.select("node_id", "label", "fold").join(one, "node_id", "left").join(two, "node_id", "left")
    score = F.when(F.col("fold") == "train", F.col("label").cast("double")).otherwise(F.coalesce("score1", "score2", F.lit(0.5)))
    return own.select("node_id", "label", "fold", score.alias("score"))


def split_head_to_head(folds: DataFrame, edges: DataFrame, axes: dict[str, list[str]], hops: int = 2) -> DataFrame:
    """(protocol, axis, pct_leak) of every protocol of a fold table (protocol, node_id, fold) at ``hops``."""
    from taintgraph.operators.graph import residual_leak

    out = None
    for name in [r[0] for r in folds.select("protocol").distinct().orderBy("protocol").collect()]:
        f = folds.where(F.col("protocol") == name)
        leak = residual_leak(edges, f.where("fold = 'train'"), f.where("fold = 'test'"), axes, hops).where(F.col("k") == hops)
        part = leak.select(F.lit(name).alias("protocol"), "axis", "n_test", "n_leak", "pct_leak")
        out = part if out is None else out.union(part)
    return out


def auroc_all_splits(pred: DataFrame, base: str = "random") -> DataFrame:
    """(protocol, source, auroc, n_pos, n_neg, delta) of test predictions; delta is against the base protocol."""
    a = auroc(pred.where("fold = 'test'"), ["protocol", "source"])
    b = a.where(F.col("protocol") == base).select("source", F.col("auroc").alias("base"))
    return a.join(b, "source", "left").select("protocol", "source", "auroc", "n_pos", "n_neg", (F.col("auroc") - F.col("base")).alias("delta"))


def winners(report: DataFrame) -> DataFrame:
    """(source, protocol, auroc): the protocol with the highest AUROC per source, ties to the first name."""
    w = Window.partitionBy("source").orderBy(F.desc("auroc"), "protocol")
    return report.where(~F.isnan("auroc")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("source", "protocol", "auroc")
