"""Split protocols. Every protocol is ``f(ctx, **params) -> DataFrame(node_id, fold, leak_mask)`` under a name.

Shuffles are hash orders (``md5(seed|id)``), so a split depends on ids and seed only. Flip loops move leaking test
examples to train, at most ``max_iter`` times; each pass is one multi-source search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgraph.functions.stats import hash_rank
from taintgraph.operators.build import rank_in_order
from taintgraph.operators.graph import bfs, symmetrise
from taintgraph.session import cut, discard
from taintgraph.vocab import AXES


@dataclass
class SplitContext:
    """examples: node_id, label; edges: src, dst, edge_type (canonical)."""

    examples: DataFrame
    edges: DataFrame
    seed: int = 42
    test: float = 0.15
    val: float = 0.0
    coarse: DataFrame | None = None  # scaffold, coarse: groups of scaffolds


PROTOCOLS: dict[str, Callable[..., DataFrame]] = {}


def protocol(name: str):
    def register(f):
        if name in PROTOCOLS:
            raise ValueError(f"protocol {name!r} is registered already")
        PROTOCOLS[name] = f
        return f

    return register


def build_split(name: str, ctx: SplitContext, **params) -> DataFrame:
    """Split by a registered protocol; an unknown name is a KeyError."""
    return PROTOCOLS[name](ctx, **params)


def param_string(params: dict) -> str:
    """Parameters as a file-name part: sorted keys, floats as ``%g``."""
    parts = [f"{k}{format(v, 'g') if isinstance(v, float) else v}" for k, v in sorted(params.items())]
    return "_".join(parts) or "default"


def _types(axes: list[str]) -> list[str]:
    return sorted({t for a in axes for t in AXES[a]})


def stratified_assign(rows: DataFrame, strata: list[str], ctx: SplitContext) -> DataFrame:
    """Per stratum in hash order: the first round(n * test) to test, the next round(n * val) to val (half to even)."""
    r = hash_rank(rows, strata, "node_id", ctx.seed)
    n_test, n_val = F.bround(F.col("size") * ctx.test), F.bround(F.col("size") * ctx.val)
    fold = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return r.select("node_id", "label", fold.alias("fold"))


def _done(split: DataFrame, leak: bool = False) -> DataFrame:
    return split.select("node_id", "fold", F.lit(leak).alias("leak_mask"))


@protocol("random")
def random_split(ctx: SplitContext) -> DataFrame:
    return _done(stratified_assign(ctx.examples.select("node_id", "label"), ["label"], ctx))


@protocol("random_per_target")
def random_per_target(ctx: SplitContext) -> DataFrame:
    first = ctx.edges.where("edge_type = 'example_has_protein'").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("target"))
    rows = ctx.examples.select("node_id", "label").join(first, "node_id", "left").select("node_id", "label", F.coalesce("target", F.lit("_no_target")).alias("target"))
    return _done(stratified_assign(rows, ["target", "label"], ctx))


def group_split(ctx: SplitContext, groups: DataFrame, at_least_one: bool = False) -> DataFrame:
    """Whole groups (node_id, grp) to test in hash order; examples without a group go to train."""
    known = groups.where("grp is not null").select(F.col("grp").alias("node_id")).distinct()
    r = hash_rank(known, [], "node_id", ctx.seed)
    n_test = F.bround(F.col("size") * ctx.test)
    if at_least_one:
        n_test = F.greatest(n_test, F.lit(1.0))
    n_val = F.bround(F.col("size") * ctx.val)
    fold = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    placed = r.select(F.col("node_id").alias("grp"), fold.alias("fold"))
    x = ctx.examples.select("node_id").join(groups.select("node_id", "grp"), "node_id", "left").join(placed, "grp", "left")
    return _done(x.select("node_id", F.coalesce("fold", F.lit("train")).alias("fold")))


def _scaffolds(ctx: SplitContext) -> DataFrame:
    has = ctx.edges.where("edge_type = 'example_has_ligand'").select(F.col("src").alias("node_id"), F.col("dst").alias("lig"))
    sca = ctx.edges.where("edge_type = 'ligand_scaffold'").select(F.col("src").alias("lig"), F.col("dst").alias("grp"))
    return has.join(sca, "lig").groupBy("node_id").agg(F.min("grp").alias("grp"))


@protocol("scaffold")
def scaffold_split(ctx: SplitContext) -> DataFrame:
    return group_split(ctx, _scaffolds(ctx))


@protocol("scaffold_generic")
def scaffold_generic(ctx: SplitContext, coarse: DataFrame | None = None) -> DataFrame:
    """``coarse``: scaffold -> coarser group, computed by the caller once per distinct scaffold (grp, coarse); the
    context's where none is given."""
    coarse = coarse if coarse is not None else ctx.coarse
    if coarse is None:
        raise ValueError("scaffold_generic needs the groups of scaffolds")
    g = _scaffolds(ctx).join(coarse, "grp", "left").select("node_id", F.coalesce("coarse", "grp").alias("grp"))
    return group_split(ctx, g)


@protocol("protein_cluster")
def protein_cluster(ctx: SplitContext, identity: str = "30") -> DataFrame:
    has = ctx.edges.where("edge_type = 'example_has_protein'").select(F.col("src").alias("node_id"), F.col("dst").alias("prot"))
    inc = ctx.edges.where("edge_type = 'protein_in_cluster'").where(F.col("dst").contains(f"::{identity}::")).select(F.col("src").alias("prot"), F.col("dst").alias("grp"))
    return group_split(ctx, has.join(inc, "prot").groupBy("node_id").agg(F.min("grp").alias("grp")), at_least_one=True)


def _flip_loop(ctx: SplitContext, leaking: Callable[[DataFrame], DataFrame], max_iter: int) -> DataFrame:
    """``leaking(split)`` gives node_id of test examples that leak; they move to train until none does."""
    split = before = cut(stratified_assign(ctx.examples.select("node_id", "label"), ["label"], ctx), "split")
    for _ in range(max_iter):
        flip = leaking(split).select("node_id").distinct().withColumn("flip", F.lit(True))
        nxt = cut(
            split.join(flip, "node_id", "left").select("node_id", "label", F.when((F.col("fold") == "test") & F.col("flip"), "train").otherwise(F.col("fold")).alias("fold"), (F.coalesce("flip", F.lit(False)) & (F.col("fold") == "test")).alias("moved")),
            "split",
        )
        moved = nxt.where("moved").limit(1).count()
        discard(before)
        before, split = nxt, nxt.drop("moved")
        if not moved:
            break
    return _done(split)


def _disjoint(ctx: SplitContext, hops: int, axes: list[str], max_iter: int) -> DataFrame:
    both = cut(symmetrise(ctx.edges.where(F.col("edge_type").isin(_types(axes)))), "both")  # once for all passes
    return _flip_loop(ctx, lambda s: bfs(both, s.where("fold = 'train'"), hops, symmetric=True).where("hop > 0"), max_iter)


@protocol("kg_kdisjoint")
def kg_kdisjoint(ctx: SplitContext, K: int = 2, axes: tuple[str, ...] = ("ligand",), max_iter: int = 3) -> DataFrame:
    """No test example within K hops of train, as far as max_iter passes get. K = 1 changes nothing: two examples are
    never adjacent."""
    return _disjoint(ctx, K, list(axes), max_iter)


@protocol("kg_maxmin")
def kg_maxmin(ctx: SplitContext, T: int = 3, axes: tuple[str, ...] = ("ligand",), max_iter: int = 5) -> DataFrame:
    """Test examples at least T hops from train: the same as no one within T - 1."""
    return _disjoint(ctx, T - 1, list(axes), max_iter)


@protocol("plinder_style")
def plinder_style(ctx: SplitContext, depth: int = 2, protein: bool = False) -> DataFrame:
    return _disjoint(ctx, depth, ["ligand", "scaffold"] + ["protein"] * protein, 1)


@protocol("kg_axis_budget")
def kg_axis_budget(ctx: SplitContext, budgets: dict[str, float] | None = None, hops: int = 2, **budget_of: float) -> DataFrame:
    """Axis by axis at most int(budget * n_test) test examples may lie within ``hops`` of train; the closest surplus is
    moved (ties by id). Later axes see the test set that earlier ones left, so a budget may be exceeded in the end.
    ``budget_<axis>`` changes one budget."""
    budgets = dict(budgets or {"ligand": 0.05, "scaffold": 0.05, "publication": 0.05, "assay": 0.05, "protein": 0.5})
    for name, v in budget_of.items():
        axis = name.removeprefix("budget_")
        if not name.startswith("budget_") or axis not in AXES:
            raise TypeError(f"kg_axis_budget has no parameter {name!r}")
        budgets[axis] = v
    split = cut(stratified_assign(ctx.examples.select("node_id", "label"), ["label"], ctx), "split")
    for axis in ("ligand", "scaffold", "publication", "assay", "protein"):
        if axis not in budgets:
            continue
        e = ctx.edges.where(F.col("edge_type").isin(AXES[axis]))
        test = split.where("fold = 'test'").select("node_id")
        near = cut(bfs(e, split.where("fold = 'train'"), hops).where("hop > 0").join(test, "node_id", "left_semi"), "near")
        n_test, n_near = test.count(), near.count()
        surplus = n_near - int(budgets[axis] * n_test)
        if surplus <= 0:
            continue
        flip = rank_in_order(near, [], ["hop", "node_id"], "nth").where(F.col("nth") < surplus).select("node_id", F.lit(True).alias("flip"))
        split = cut(split.join(flip, "node_id", "left").select("node_id", "label", F.when(F.col("flip"), "train").otherwise(F.col("fold")).alias("fold")), "split")
    return _done(split)


def _similar_flips(ctx: SplitContext, min_similarity: float, symmetric: bool, actives_only: bool) -> Callable[[DataFrame], DataFrame]:
    has = ctx.edges.where("edge_type = 'example_has_ligand'").select(F.col("src").alias("node_id"), F.col("dst").alias("lig"))
    sim = ctx.edges.where("edge_type = 'ligand_similar'")
    if "similarity" in ctx.edges.columns:
        sim = sim.where(F.coalesce("similarity", F.lit(1.0)) >= min_similarity)
    sim = sim.select("src", "dst")
    if symmetric:
        sim = sim.union(sim.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def leaking(split: DataFrame) -> DataFrame:
        s = split.where("label = 1") if actives_only else split
        train = has.join(s.where("fold = 'train'"), "node_id", "left_semi").select(F.col("lig").alias("src")).distinct()
        hit = sim.join(train, "src", "left_semi").select(F.col("dst").alias("lig")).distinct()
        return has.join(s.where("fold = 'test'"), "node_id", "left_semi").join(hit, "lig", "left_semi")

    return leaking


@protocol("tanimoto_maxmin")
def tanimoto_maxmin(ctx: SplitContext, T: float = 0.0, max_iter: int = 3, symmetric: bool = False) -> DataFrame:
    """Moves test examples whose ligand is the far end of a similarity edge from a train ligand."""
    return _flip_loop(ctx, _similar_flips(ctx, T, symmetric, False), max_iter)


@protocol("ave_wallach")
def ave_wallach(ctx: SplitContext, max_iter: int = 5, symmetric: bool = False) -> DataFrame:
    return _flip_loop(ctx, _similar_flips(ctx, 0.0, symmetric, True), max_iter)


@protocol("datasail")
def datasail(ctx: SplitContext) -> DataFrame:
    """The external solver is not part of this library: a random split with its leak mask set says so."""
    return random_split(ctx).withColumn("leak_mask", F.lit(True))


def audit_split(split: DataFrame, examples: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """One row: sizes, shares of actives, leak per axis, targets, and whether the test fold is large enough to use."""
    from taintgraph.operators.graph import residual_leak

    s = cut(split.join(examples.select("node_id", "label"), "node_id").select("node_id", "label", "fold"), "split")
    is_ = lambda f, cond: F.sum(((F.col("fold") == f) & cond).cast("long"))
    any_, active, decoy = F.lit(True), F.col("label") == 1, F.col("label") == 0
    head = s.agg(
        *[F.coalesce(is_(f, any_), F.lit(0)).alias(f"n_{f}") for f in ("train", "val", "test")],
        F.coalesce(is_("test", active), F.lit(0)).alias("n_test_active"),
        F.coalesce(is_("test", decoy), F.lit(0)).alias("n_test_decoy"),
        (F.avg(F.when(F.col("fold") == "train", active.cast("int"))) * 100).alias("pct_active_train"),
        (F.avg(F.when(F.col("fold") == "test", active.cast("int"))) * 100).alias("pct_active_test"),
    )
    leak = residual_leak(edges, s.where("fold = 'train'"), s.where("fold = 'test'"), AXES, hops).where(F.col("k") == hops)
    wide = leak.groupBy().agg(*[F.max(F.when(F.col("axis") == a, F.col("pct_leak"))).alias(f"pct_leak_{a}") for a in AXES])
    targets = edges.where("edge_type = 'example_has_protein'").join(s.where("fold = 'test'").select(F.col("node_id").alias("src")), "src", "left_semi").agg(F.countDistinct("dst").alias("n_unique_targets_test"))
    feasible = (F.col("n_test") >= 500) & (F.col("n_test_active") >= 10) & (F.col("n_test_decoy") >= 10)
    row = [d.withColumn("one", F.lit(1)) for d in (head, wide, targets)]
    return row[0].join(F.broadcast(row[1]), "one").join(F.broadcast(row[2]), "one").drop("one").withColumn("feasible", feasible)


def sweep(ctx: SplitContext, configs: list[tuple[str, dict]], out_dir: str, done: set[str] = frozenset()) -> list[dict]:
    """Build, write and audit many splits; finished ones are skipped, a failing one becomes a row with its error."""
    rows = []
    for name, params in configs:
        key = f"{name}_{param_string(params)}"
        if key in done:
            continue
        try:
            split = build_split(name, ctx, **params).withColumns({"protocol": F.lit(name), "seed": F.lit(ctx.seed), "params": F.lit(param_string(params))})
            split.write.mode("overwrite").parquet(f"{out_dir}/{key}")
            stored = split.sparkSession.read.parquet(f"{out_dir}/{key}")
            rows.append({"key": key, "error": None, **audit_split(stored, ctx.examples, ctx.edges).first().asDict()})
        except Exception as e:  # noqa: BLE001
            rows.append({"key": key, "error": str(e)[:500]})
    return rows


#: the configurations of a full sweep
SWEEP = [
    ("random", {}), ("random_per_target", {}), ("scaffold", {}), ("scaffold_generic", {}), ("tanimoto_maxmin", {"T": 0.4}),
    ("protein_cluster", {"identity": "30"}), ("protein_cluster", {"identity": "50"}), ("protein_cluster", {"identity": "90"}),
    ("kg_kdisjoint", {"K": 2, "axes": ("ligand", "scaffold")}), ("kg_kdisjoint", {"K": 2, "axes": ("ligand", "scaffold", "publication", "assay")}),
    ("kg_maxmin", {"T": 3, "axes": ("ligand", "scaffold")}), ("kg_maxmin", {"T": 3, "axes": ("ligand", "scaffold", "publication", "assay")}),
    ("kg_axis_budget", {"budget_assay": 1.0, "budget_publication": 1.0}), ("kg_axis_budget", {}),
]
#: what names a row of a sweep's report
AUDIT_KEY = ["corpus", "protocol", "params", "seed"]


def stored_name(protocol: str, params: str, seed: int) -> str:
    return f"{protocol}__{params}__seed{seed}"


def parse_stored_name(name: str) -> tuple[str, str, int] | None:
    """(protocol, params, seed), or None for a name of another form."""
    part = name.split("__")
    if len(part) != 3 or not part[2].startswith("seed") or not part[2][4:].lstrip("-").isdigit():
        return None
    return part[0], part[1], int(part[2][4:])


def reaudit(spark, root: str, corpus: str, examples: DataFrame, edges: DataFrame) -> DataFrame | None:
    """Audits of all stored splits of a corpus (folders ``root/corpus/protocol__params__seedN``), without building them
    again; folders of another name are passed over. None where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{corpus}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    out = None
    for f in sorted(str(x.getPath().getName()) for x in fs.listStatus(path)):
        named = parse_stored_name(f)
        if named is None:
            continue
        a = audit_split(spark.read.parquet(f"{root}/{corpus}/{f}").select("node_id", "fold"), examples, edges)
        a = a.withColumns(dict(zip(AUDIT_KEY, map(F.lit, (corpus, *named)))))
        out = a if out is None else out.unionByName(a)
    return out


def merge_audits(parts: list[DataFrame]) -> DataFrame:
    """One report of several; of rows for one split, that of the last report counts, also where reports differ in columns."""
    if not parts:
        raise ValueError("no reports to merge")
    x = None
    for k, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(k))
        x = p if x is None else x.unionByName(p, allowMissingColumns=True)
    rest = [c for c in x.columns if c not in AUDIT_KEY and c != "__part"]
    return x.groupBy(*AUDIT_KEY).agg(F.max_by(F.struct(*rest), "__part").alias("x")).select(*AUDIT_KEY, "x.*")
