import pytest
from pyspark.sql import functions as F

from taintgraph.operators import build, similarity
from taintgraph.sources import readers, sinks


def test_ids_labels_and_emission(spark):
    x = spark.createDataFrame([("s", "t", "CCO", None, 1, 2), ("s", "t", "c1ccccc1", "c1ccccc1", 0, 1)], "source string, target string, smiles_canonical string, scaffold_smiles string, label int, k int")
    ids = build.example_ids(x, ["k"])
    assert [r["example_id"] for r in ids.orderBy("k").collect()] == ["ex:s:t:0", "ex:s:t:1"]
    n, e = build.emit(ids)
    assert {r["node_type"] for r in n.collect()} == {"Example", "Ligand", "Scaffold", "ProteinTarget", "DatasetSource"} and e.count() == 8
    lab = spark.createDataFrame([("BDB50",), ("zinc9",), ("X1",), (None,)], "i string")
    assert [r[0] for r in lab.select(build.label_of_id(F.col("i"))).collect()] == [1, 0, -1, -1]


def test_consolidation_and_invariants(spark):
    n = spark.createDataFrame(
        [("ex:1", "Example", "x", "{}"), ("lig:1", "Ligand", "CC", "{}"), ("sca:0", "Scaffold", "", "{}"), ("sca:1", "Scaffold", "c1ccccc1CCN", "{}"), ("tgt:s:P12345", "ProteinTarget", "x", "{}"), ("lt:1", "LabelType", "x", "{}"), ("src:s", "DatasetSource", "s", "{}")],
        "node_id string, node_type string, label string, props string",
    )
    e = spark.createDataFrame([("ex:1", "lig:1", "example_has_ligand"), ("lig:1", "sca:0", "ligand_has_scaffold"), ("lig:1", "sca:1", "ligand_has_scaffold"), ("ex:1", "tgt:s:P12345", "example_targets_protein"), ("ex:1", "lt:1", "example_has_label")], "src string, dst string, edge_type string")
    cn, ce = build.consolidate(n, e)
    assert {r["node_id"] for r in cn.collect()} == {"ex:1", "lig:1", "sca:1", "protein:p12345", "src:s"}
    assert {(r["dst"], r["edge_type"]) for r in ce.collect()} == {("lig:1", "example_has_ligand"), ("sca:1", "ligand_scaffold"), ("protein:p12345", "example_has_protein")}
    build.assert_invariants(cn, ce)
    with pytest.raises(ValueError):
        build.assert_invariants(n, e.withColumn("dst", F.lit("gone")))


def test_reference_map_uses_both_keys_before_either(spark):
    b = spark.createDataFrame([("d", "K1", "T9"), ("d", "K9", "T2"), ("d", None, None)], "dataset string, key string, text string")
    r = spark.createDataFrame([("r2", "K1", "T1"), ("r1", "K1", "T1"), ("r3", None, "T2")], "ref_id string, key string, text string")
    got = {(x["key"], x["ref_id"], x["match_method"]) for x in build.reference_map(b, r).collect()}
    assert got == {("K1", "r1", "key"), ("K9", "r3", "text"), (None, None, "unmatched")}


def test_hydration_trainsets_and_upsert(spark):
    side = spark.createDataFrame([(" A:1", "chembl", 1.0), ("a:1", "chembl", 1.0), ("b:2", "nowhere", None), (None, "dude", None)], "example_id string, source string, label double")
    rows, missing = build.hydrate(spark.createDataFrame([("a:1",), ("A:1 ",), ("z:9",), (None,), (" ",)], "example_id string"), side)
    assert rows.count() == 1 and [r["key"] for r in missing.collect()] == ["z:9"]
    assert build.coverage(rows, missing).first()["coverage"] == 0.5
    v = {r["problem"]: r["n"] for r in build.validate_side_table(side, {"example_id": "string", "source": "int", "target": "string"}).collect()}
    assert v["unknown source"] == 1 and v["null example_id"] == 1 and v["missing column target"] == 1 and v["extra column label"] == 1 and v["column source is string, not int"] == 1
    m = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "q"), ("m", None)], "model string, example_id string")
    ex = spark.createDataFrame([("ex:a",)], "node_id string")
    n, e, un = build.trainset(m, ex)
    assert n.count() == 1 and e.count() == 1 and {r["node_id"] for r in un.collect()} == {"ex:q", None}
    up = build.upsert_latest(spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 2, "y")], "k string, t int, v string"), ["k"], ["t"])
    assert [tuple(r) for r in up.collect()] == [("k", 2, "y")]


def test_similarity_join_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    sets = [frozenset(rnd.sample(range(40), rnd.randint(1, 15))) for _ in range(60)]
    sets += [frozenset(list(s)[1:]) for s in sets if len(s) > 4] + sets[:5] + [frozenset()]
    df = spark.createDataFrame([(f"k{i:03}", sorted(s)) for i, s in enumerate(sets)], "key string, bits array<int>")
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(s, f"k{i:03}")
    want = set()
    items = sorted((k, s) for s, k in first.items())
    for i, (a, s) in enumerate(items):
        want |= {(a, b) for b, t in items[i + 1 :] if len(s & t) * 10 >= len(s | t) * 7}
    pairs = similarity.fingerprint_pairs(df, "key", "bits", 0.7)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert similarity.fingerprint_classes(df, "key", "bits").count() == len(sets) - 1
    assert {r["threshold"]: r["n_pairs"] for r in similarity.pair_counts(pairs, [0.7]).collect()} == {0.7: len(want)}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "aa2ar").mkdir()
    (tmp_path / "aa2ar" / "actives.smi").write_text("# head\nCCO a1 x extra\n\n  CCC\tZINC9\nCCN\n")
    x = readers.read_smi(spark, str(tmp_path / "aa2ar" / "actives.smi"), "dude", "aa2ar", 1, "active")
    assert [(r["smiles_input"], r["ext_id_1"], r["ext_id_2"]) for r in x.collect()] == [("CCO", "a1", "x"), ("CCC", "ZINC9", None), ("CCN", None, None)]
    (tmp_path / "aa2ar" / "inactives.smi").write_text("")
    t = readers.read_corpus(spark, str(tmp_path), "LIT-PCBA")
    assert {(r["target"], r["label"], r["label_type"], r["split"], r["source_file"]) for r in t.collect()} == {("aa2ar", 1, "active", "unknown", "actives.smi")} and t.count() == 3
    (tmp_path / "a.csv").write_text("uniprot,lig_smiles,standard_value,odd\nP1,CC,1.5,z\nP2,CN,bad,z\n")
    assert [(r["lig_smiles"], r["standard_value"], r["active"]) for r in readers.read_activities_csv(spark, str(tmp_path / "a.csv")).collect()] == [("CC", 1.5, None), ("CN", None, None)]
    (tmp_path / "w.tsv").write_text("A\tB\tC\n1\t2\t3\nshort\n4\t5\t6\n")
    assert [tuple(r) for r in readers.read_wide_tsv(spark, str(tmp_path / "w.tsv"), {"C": "c", "A": "a"}).collect()] == [("3", "1"), ("6", "4")]
    (tmp_path / "n.tsv").write_text("1\t2\n")
    assert readers.read_tsv(spark, str(tmp_path / "n.tsv"), ["x", "y"]).first()["y"] == "2"
    assert readers.read_manifest(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(ValueError):
        readers.read_manifest(spark, "a.xml")
    e = spark.createDataFrame([("a", "b", "s"), ("a", "c", "t")], "src string, dst string, edge_type string")
    sinks.write_edges(e, str(tmp_path / "e"))
    sinks.replace_edge_types(spark.createDataFrame([("x", "y", "s")], e.schema), str(tmp_path / "e"), ["s"])
    assert {(r["src"], r["edge_type"]) for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {("x", "s"), ("a", "t")}
    k = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.upsert_csv(k, str(tmp_path / "r"), ["k"])
    sinks.upsert_csv(spark.createDataFrame([("b", 3)], k.schema), str(tmp_path / "r"), ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.option("header", True).schema(k.schema).csv(str(tmp_path / "r")).collect()} == {("a", 1), ("b", 3)}
    assert sinks.markdown(k.where("k = 'a'"), "T").splitlines()[2:] == ["| k | v |", "| --- | --- |", "| a | 1 |"]
    sinks.write_fasta(spark.createDataFrame([("i", "ABCDEFG")], "i string, s string"), str(tmp_path / "f"), "i", "s", 3)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()] == [">i", "ABC", "DEF", "G"]
