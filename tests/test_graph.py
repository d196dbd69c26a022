import math

import pytest
from pyspark.sql import functions as F

from taintgraph.functions import stats
from taintgraph.operators import audits, graph, splits
from taintgraph.vocab import AXES, AXES_WITH_FULL

EDGES = [
    ("e1", "a", "example_has_ligand"), ("e2", "b", "example_has_ligand"), ("e3", "a", "example_has_ligand"), ("e4", "c", "example_has_ligand"), ("e5", "d", "example_has_ligand"),
    ("b", "c", "ligand_similar"), ("e1", "p", "example_from_publication"), ("e5", "p", "example_from_publication"),
]
EXAMPLES = [("e1", 1, "train"), ("e2", 0, "train"), ("e3", 1, "test"), ("e4", 0, "test"), ("e5", 1, "test")]


@pytest.fixture(scope="module")
def g(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, edge_type string").cache()
    x = spark.createDataFrame(EXAMPLES, "node_id string, label int, fold string").cache()
    return e, x


def reach(df):
    return {r["node_id"]: r["hop"] for r in df.collect()}


def test_bfs_by_axis(spark, g):
    e, x = g
    train = x.where("fold = 'train'")
    assert reach(graph.bfs(graph.axis_edges(e, "ligand", AXES), train, 3)) == {"e1": 0, "e2": 0, "a": 1, "b": 1, "e3": 2, "c": 2, "e4": 3}
    assert reach(graph.bfs(graph.axis_edges(e, "publication", AXES), train, 2)) == {"e1": 0, "e2": 0, "p": 1, "e5": 2}
    assert reach(graph.khop_neighbours(graph.axis_edges(e, "publication", AXES), train, 1)) == {"p": 1}
    assert reach(graph.distance_to(graph.axis_edges(e, "publication", AXES), train, x.where("fold = 'test'"), 2)) == {"e3": None, "e4": None, "e5": 2}
    with pytest.raises(KeyError):
        graph.axis_edges(e, "nothing", AXES)


def test_bfs_without_seeds(spark, g):
    out = graph.bfs(g[0], g[1].limit(0), 3)
    assert out.columns == ["node_id", "hop"] and out.count() == 0


def test_bfs_grows_with_hops(g):
    e, x = g
    sets = [set(reach(graph.bfs(e, x.where("fold = 'train'"), k))) for k in range(1, 4)]
    assert sets[0] <= sets[1] <= sets[2]


def test_residual_leak(g):
    e, x = g
    r = graph.residual_leak(e, x.where("fold = 'train'"), x.where("fold = 'test'"), AXES_WITH_FULL, 3).collect()
    n = {(q["axis"], q["k"]): q["n_leak"] for q in r}
    assert (n["ligand", 1], n["ligand", 2], n["ligand", 3]) == (0, 1, 2)
    assert n["publication", 2] == 1 and n["assay", 3] == 0 and n["full", 3] == 3
    none = graph.residual_leak(e, x.where("fold = 'train'"), x.limit(0), AXES, 1).collect()
    assert all(math.isnan(q["pct_leak"]) and q["n_leak"] == 0 for q in none)


def ctx(g, folds=None):
    return splits.SplitContext(g[1].select("node_id", "label"), g[0])


def fixed(monkeypatch, g):
    monkeypatch.setattr(splits, "stratified_assign", lambda rows, strata, c: g[1])


def test_disjoint_split_flips(monkeypatch, g):
    fixed(monkeypatch, g)

    def test_of(name, **p):
        return {r["node_id"] for r in splits.build_split(name, ctx(g), **p).where("fold = 'test'").collect()}

    assert test_of("kg_kdisjoint", K=2, axes=("ligand",)) == {"e4", "e5"}
    assert test_of("kg_kdisjoint", K=2, axes=("ligand", "publication")) == {"e4"}
    assert test_of("kg_kdisjoint", K=1, axes=("ligand",)) == {"e3", "e4", "e5"}
    assert test_of("kg_maxmin", T=3, axes=("ligand",)) == {"e4", "e5"}
    assert test_of("kg_maxmin", T=2, axes=("ligand",)) == {"e3", "e4", "e5"}
    assert test_of("tanimoto_maxmin") == {"e3", "e5"}
    assert test_of("ave_wallach") == {"e3", "e4", "e5"}


def test_protocol_registry():
    with pytest.raises(KeyError):
        splits.build_split("no such protocol", None)
    with pytest.raises(ValueError):
        splits.protocol("random")(lambda c: None)
    assert splits.param_string({"K": 2, "axes": "ligand,scaffold"}) == "K2_axesligand,scaffold"
    assert splits.param_string({}) == "default" and splits.param_string({"T": 0.4}) == "T0.4"


def test_random_split_quotas(spark):
    x = spark.createDataFrame([(f"n{i}", i % 2) for i in range(200)], "node_id string, label int")
    e = spark.createDataFrame([], "src string, dst string, edge_type string")
    s = splits.build_split("random", splits.SplitContext(x, e, test=0.15, val=0.1)).join(x, "node_id")
    n = {(r["fold"], r["label"]): r["count"] for r in s.groupBy("fold", "label").count().collect()}
    assert n["test", 0] == n["test", 1] == 15 and n["val", 0] == n["val", 1] == 10


def test_path_atlas(g):
    e, x = g
    p = x.select(F.col("node_id").alias("example_id"), F.lit("s").alias("source"), F.when(F.col("label") == 1, 0.1).otherwise(0.9).alias("score"), "label", "fold")
    a = {r["example_id"]: (r["hop"], r["category"]) for r in audits.path_atlas(p, e, 0.5, 3).collect()}
    assert a == {"e3": (2, "example_has_ligand"), "e4": (3, "similar_ligand"), "e5": (2, "publication")}


def test_shared_neighbours(g):
    e, x = g
    n = graph.shared_neighbour_count(e.where("edge_type = 'example_from_publication'"), x.where("fold = 'train'"), x.where("fold = 'test'"))
    assert {r["node_id"]: r["n_shared"] for r in n.collect()} == {"e5": 1, "e3": 0, "e4": 0}


def test_nearest_label_scores(g):
    e, x = g
    s = {r["node_id"]: r["score"] for r in audits.nearest_label_scores(x, e.where("edge_type <> 'ligand_similar'")).collect()}
    assert s == {"e1": 1.0, "e2": 0.0, "e3": 1.0, "e4": 0.5, "e5": 1.0}


def test_auroc(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)]
    df = spark.createDataFrame([("g", s, y) for s, y in rows] + [("one", 0.2, 1), ("one", None, 0), ("one", 0.3, -1)], "k string, score double, label int")
    a = {r["k"]: r["auroc"] for r in stats.auroc(df, ["k"]).collect()}
    assert a["g"] == 0.75 and math.isnan(a["one"])
    back = stats.auroc(df.withColumn("score", -F.col("score")), ["k"]).where("k = 'g'").first()["auroc"]
    assert back == 0.25


def test_bootstrap_is_reproducible_and_p_is_at_most_one(spark):
    df = spark.createDataFrame([(f"r{i}", "k", (i * 37 % 101) / 101, i % 3 == 0 and 1 or 0, i % 2 == 0) for i in range(300)], "id string, k string, score double, label int, flag boolean")
    a, b = (stats.bootstrap_interval(df, ["k"], "id", 20).first().asDict() for _ in range(2))
    assert a == b and a["lower"] <= a["point"] <= a["upper"]
    assert 0 <= stats.delta_test(df, ["k"], "flag", "id", 20).first()["p"] <= 1


def test_hash_rank_is_exact(spark):
    df = spark.createDataFrame([(f"n{i}", i % 3) for i in range(500)], "node_id string, label int")
    got = stats.hash_rank(df, ["label"], "node_id", 42, 16).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in got if r["label"] == k) == list(range(1, sum(r["label"] == k for r in got) + 1))


def test_structure_operators(spark, g):
    e, _ = g
    n = spark.createDataFrame([("e1", "Example", "x", "{}"), ("a", "Ligand", "x", "{}"), ("q", "Ligand", "x", "{}"), ("src:1", "DatasetSource", "x", "{}")], "node_id string, node_type string, label string, props string")
    assert {(r["src"], r["dst"]) for r in graph.prune_dangling(n, e).collect()} == {("e1", "a")}
    assert {r["node_id"] for r in graph.drop_orphans(n, e).collect()} == {"e1", "a", "src:1"}
    hubs = {r["node_id"]: (r["degree"], r["is_hub"]) for r in graph.flag_hubs(n, e, 1).collect()}
    assert hubs == {"e1": (2, True), "a": (2, True), "q": (0, False), "src:1": (0, False)}
    m = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "a"), ("lone", "z"), (None, "y")], "key string, m string")
    assert {(r["src"], r["dst"]) for r in graph.star_bridges(m, "key", "m").collect()} == {("a", "b")}
    p = spark.createDataFrame([("b", "a", "s"), ("a", "b", "s"), ("b", "a", "t")], "src string, dst string, edge_type string")
    assert sorted(map(tuple, graph.canonical_pairs(p, ["s"]).collect())) == [("a", "b", "s"), ("b", "a", "t")]
