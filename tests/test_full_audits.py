"""Audits at the sizes of the reference, beside those that SQL checks at smaller ones."""

import pytest

import __spark_entry__ as entry_module
from taintgraph.functions import stats
from taintgraph.operators import audits, graph
from taintgraph.plans import kg


@pytest.mark.parametrize("name, reps", [("delta_auroc_test_full", 1000), ("bootstrap_ci_full", 500), ("baseline_compare_full", 500)])
def test_replicates(spark, smallest, monkeypatch, name, reps):
    seen, plain = [], stats.bootstrap
    monkeypatch.setattr(stats, "bootstrap", lambda df, keys, row_id, n, *a: seen.append(n) or plain(df, keys, row_id, n, *a))
    entry_module.queries()[name](spark, smallest)
    assert seen and set(seen) == {reps}


def test_every_corpus_and_three_hops(spark, smallest):
    q = entry_module.queries()
    rows = [r.asDict() for r in q["cross_corpus_pivot_full"](spark, smallest).collect()]
    sources = {r[0] for r in kg.examples(spark, smallest).where("source is not null").select("source").distinct().collect()}
    assert {(r["train_source"], r["k"]) for r in rows} == {(s, k) for s in sources for k in (1, 2, 3)}
    assert set(rows[0]) == {"train_source", "k"} | sources
    small = {r["train_source"]: r.asDict() for r in q["cross_corpus_pivot"](spark, smallest).collect()}
    assert small == {r["train_source"]: {c: r.get(c) for c in ("train_source", "chembl", "bindingdb", "dude")} for r in rows if r["k"] == 2}


def test_searches_are_as_long_as_the_references(spark, smallest, monkeypatch):
    seen, plain = [], graph.flag_hubs
    monkeypatch.setattr(graph, "flag_hubs", lambda n, e, cap: seen.append(cap) or plain(n, e, cap))
    for f in ("path_atlas", "path_atlas_counts", "horizon_curve", "hub_partition"):
        monkeypatch.setattr(audits, f, lambda *a, f=f: seen.append((f, a[-1])))
    q = entry_module.queries()
    for name in ("horizon_curve_full", "path_atlas_full", "hub_flag_full", "hub_partition_full"):
        q[name](spark, smallest)
    assert seen == [("horizon_curve", 5), ("path_atlas", 4), 1000, 1000, ("hub_partition", 2)]


def test_far_examples_are_reached(spark):
    ids = ["ex:a", "lig:1", "lig:2", "lig:3", "ex:b", "lig:4"]
    e = spark.createDataFrame([(a, b, "ligand_similar") for a, b in zip(ids, [*ids[1:], "ex:c"])], "src string, dst string, edge_type string")
    rows = [("ex:a", "s", 1, "train", 0.9), ("ex:b", "s", 1, "test", 0.1), ("ex:c", "s", 0, "test", 0.1)]
    p = spark.createDataFrame(rows[:2], "example_id string, source string, label int, fold string, score double")
    assert [(r["hop"], r["category"]) for r in audits.path_atlas(p, e).collect()] == [(4, "similar_ligand")]
    e5 = e.where("dst <> 'ex:c'").unionByName(spark.createDataFrame([("ex:b", "ex:c", "ligand_similar")], e.schema))
    p = spark.createDataFrame([rows[0], rows[2]], p.schema)
    assert [r["hop"] for r in audits.horizon_curve(p, {"x": e5}, least=1).collect()] == [5]
