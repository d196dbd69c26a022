from taintgraph.operators import splits
from taintgraph.plans import pipeline
from taintgraph.streaming import tagger


def test_tasks_go_on_after_a_failure(spark):
    seen = []

    def bad():
        raise RuntimeError("no")

    status, code = pipeline.run_all([("a", lambda: seen.append("a"), None), ("b", bad, None), ("c", lambda: seen.append("c"), None)], spark)
    assert seen == ["a", "c"] and code == 1 and status.todo == ["b"]
    assert "TODO: b" in status.markdown()


def test_graph_is_built_once(spark, tmp_path):
    n = spark.createDataFrame([("ex:1", "Example", "x", "{}"), ("lig:1", "Ligand", "CC", "{}"), ("src:s", "DatasetSource", "s", "{}")], "node_id string, node_type string, label string, props string")
    e = spark.createDataFrame([("ex:1", "lig:1", "example_has_ligand"), ("ex:1", "gone:1", "example_has_ligand")], "src string, dst string, edge_type string")
    out = f"file://{tmp_path}/g"
    status, code = pipeline.build_graph(spark, n, e, out)
    assert code == 0 and not any(r["skipped"] for r in status.rows)
    assert spark.read.parquet(f"{out}/edges").count() == 1
    again, code = pipeline.build_graph(spark, n, e, out)
    assert code == 0 and [r["skipped"] for r in again.rows] == [True, False, True]


def test_sweep_records_errors_and_skips(spark, tmp_path):
    x = spark.createDataFrame([(f"ex:{i}", i % 2) for i in range(60)], "node_id string, label int")
    e = spark.createDataFrame([(f"ex:{i}", f"lig:{i // 3}", "example_has_ligand") for i in range(60)], "src string, dst string, edge_type string")
    ctx = splits.SplitContext(x, e)
    rows = splits.sweep(ctx, [("random", {}), ("nothing", {}), ("datasail", {})], f"file://{tmp_path}/s", done={"datasail_default"})
    assert [r["key"] for r in rows] == ["random_default", "nothing_default"] and rows[0]["n_test"] == 8 and rows[1]["error"]
    texts = x.selectExpr("node_id", "concat('CCO', node_id) as text")
    status, code = pipeline.train_all_splits(spark, ctx, texts, f"file://{tmp_path}/t", [("random", {})])
    assert code == 1 and "too small" in status.rows[0]["error"]


def test_streamed_tags_equal_batch_tags(spark, tmp_path):
    side = spark.createDataFrame([("A:1",), ("b:2",), (None,)], "example_id string")
    rows = [(1, "m", " a:1", None), (2, "m", "z:9", None), (3, "n", None, None)]
    schema = "manifest_id long, model string, example_id string, requested_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in.parquet")
    got = {r["manifest_id"]: r["state"] for r in tagger.run_once(spark, f"{tmp_path}/in.parquet", side, tmp_path.name).collect()}
    assert got == {1: "found", 2: "missing", 3: "no_id"}
    # what was read once is not read again; what arrives is added
    spark.createDataFrame([(4, "n", "B:2 ", None)], schema).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    got = tagger.run_once(spark, f"{tmp_path}/in.parquet", side, tmp_path.name)
    assert got.count() == 4 and got.where("manifest_id = 4").first()["state"] == "found"
    monthly = tagger.monthly_states(got.selectExpr("manifest_id", "model", "state", "timestamp'2023-01-05 00:00:00' as requested_at"))
    assert {(r["model"], r["state"]): r["n"] for r in monthly.collect()} == {("m", "found"): 1, ("m", "missing"): 1, ("n", "no_id"): 1, ("n", "found"): 1}
