import pytest
from pyspark.sql import functions as F

from taintgraph.functions import chem, text
from taintgraph.operators import build, layers, side_table, splits
from taintgraph.plans import pipeline
from taintgraph.sources import readers, sinks


def raw(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, edge_type string")


CHAINS = [
    ("ex:1", "lig:1", "example_has_ligand"), ("ex:2", "lig:1", "example_has_ligand"), ("ex:3", "lig:9", "example_has_ligand"),
    ("lig:1", "chembl_lig:C", "benchmark_ligand_same_inchikey_as_chembl_ligand"), ("lig:1", "bdb_lig:K", "benchmark_ligand_same_inchikey_as_bindingdb_ligand"),
    *[(f"chembl_act:{i}", "chembl_lig:C", "chembl_activity_has_ligand") for i in range(9)],
    *[(f"chembl_act:{i}", f"chembl_asy:A{i % 8}", "chembl_activity_has_assay") for i in range(9)],
    ("chembl_act:0", "chembl_doc:D", "chembl_activity_has_document"), ("chembl_act:1", "chembl_doc:D", "chembl_activity_has_document"),
    ("bdb_lig:K", "pub:pmid:7", "bindingdb_ligand_in_publication"), ("bdb_lig:K", "protein:P12345", "bindingdb_ligand_targets_protein"),
]


def test_four_chains_become_direct_edges(spark):
    got = {(r["src"], r["dst"], r["edge_type"], r["origin"]) for r in layers.provenance_edges(raw(spark, CHAINS + CHAINS)).collect()}
    want = set()
    for e in ("ex:1", "ex:2"):
        want |= {(e, "chembl_doc:D", "example_from_publication", "ChEMBL"), (e, "pub:pmid:7", "example_from_publication", "BindingDB"), (e, "protein:P12345", "example_has_protein", "BindingDB")}
        want |= {(e, f"chembl_asy:A{i}", "example_from_assay", "ChEMBL") for i in range(5)}  # the first five of eight
    assert got == want
    assert layers.provenance_edges(raw(spark, [])).count() == 0


def test_consolidation_wires_the_layers_before_orphans_go(spark):
    types = {"ex": "Example", "lig": "Ligand", "chembl_lig": "ChEMBLLigand", "chembl_act": "ChEMBLActivity", "chembl_asy": "ChEMBLAssay", "chembl_doc": "ChEMBLDocument", "pub": "Publication", "protein": "Protein", "bdb_lig": "BindingDBLigand"}
    ids = sorted({x for s, d, _ in CHAINS for x in (s, d)}) + ["lig:alone"]
    n = spark.createDataFrame([(i, types[i.split(":")[0]], i, "{}") for i in ids], "node_id string, node_type string, label string, props string")
    odd = [("ex:1", "lig:1", "no_known_type"), ("ex:1", "lig:1", "example_in_split")]
    cn, ce = build.consolidate(n, raw(spark, CHAINS + odd))
    edges = {(r["src"], r["dst"], r["edge_type"]) for r in ce.collect()}
    assert ("ex:1", "protein:p12345", "example_has_protein") in edges and ("ex:2", "chembl_doc:D", "example_from_publication") in edges
    assert {t for _, _, t in edges} == {"example_has_ligand", "example_from_assay", "example_from_publication", "example_has_protein"}
    kept = {r["node_id"]: r["node_type"] for r in cn.collect()}
    assert kept["chembl_asy:A0"] == "Assay" and "chembl_asy:A7" not in kept and "lig:alone" not in kept and not any(k.startswith(("chembl_act", "bdb_lig")) for k in kept)
    build.assert_invariants(cn, ce)


def test_layers_leave_out_open_ends_and_choose_the_publication(spark):
    m = spark.createDataFrame([("CC", "K1", "key"), ("CN", "K2", "unmatched"), ("CO", None, "key")], "canonical_smiles string, inchikey string, match_method string")
    r = spark.createDataFrame([("K1", "C", " 12 ", "10.1/x", "P12345", "r1"), ("K1", "C", "", "10.1/y", None, None), ("K1", "C", None, None, " ", "r2"), ("K2", "N", "99", None, None, "r9")], "ligand_inchikey string, ligand_smiles string, pmid string, doi string, uniprot string, record_id string")
    n, e = layers.record_layer(m, r)
    ids = {x["node_id"] for x in n.collect()}
    assert {"pub:pmid:12", "pub:doi:10.1/y", "protein:P12345", "bdb_rec:r1", "bdb_rec:r2", "bdb_lig:K1"} <= ids and "bdb_lig:K2" not in ids and not any("99" in i for i in ids)
    edges = {(x["src"], x["edge_type"]) for x in e.collect()}
    assert ("bdb_rec:r1", "bindingdb_record_has_protein") in edges and ("bdb_rec:r2", "bindingdb_record_has_protein") not in edges
    n, e = layers.activity_layer(
        spark.createDataFrame([("CC", "K", 1, "CHEMBL1", "C-C", "key"), ("CD", "K", 1, "CHEMBL1", "C-C", "key"), ("CE", "K", None, None, None, "unmatched")], "canonical_smiles string, inchikey string, molregno long, molecule_id string, ref_smiles string, match_method string"),
        spark.createDataFrame([(5, "CHEMBL1", "Ki", 1.0, "nM", 9.0, "A", None, None), (None, "CHEMBL1", "Ki", 1.0, "nM", 9.0, "A", "D", "T")], "activity_id long, molecule_id string, standard_type string, standard_value double, standard_units string, pchembl_value double, assay_ref string, doc_ref string, target_ref string"),
    )
    assert {x["node_id"] for x in n.collect()} == {"src:ChEMBL35", "dbrel:ChEMBL_35", "chembl_lig:CHEMBL1", "chembl_act:5", "chembl_asy:A"}
    assert not e.where("dst is null or src is null").count() and e.where("edge_type = 'benchmark_ligand_same_inchikey_as_chembl_ligand'").count() == 1


def test_corpora_and_their_merge(spark):
    a = spark.createDataFrame([("CC", "P1", True), ("CCl", "P1", None), (" ", "P1", True), ("CC", None, False)], "lig_smiles string, uniprot string, active boolean")
    ex, n, e = layers.measured_corpus(a)
    assert {(r["label"], r["label_type"]) for r in ex.collect()} == {(1, "active"), (0, "inactive")} and ex.count() == 3
    assert not e.where("edge_type = 'example_uses_decoy_protocol'").count() and e.where("edge_type = 'example_targets_protein'").count() == 2
    d = layers.decoy_corpus(spark.createDataFrame([("CC.O", "dir", "P9", 1), ("[CH3]C", "dir", None, 0)], "smiles_input string, target string, uniprot string, label int"), "BayesBind")
    assert {r["target"] for r in d[0].collect()} == {"P9", "dir"} and d[2].where("edge_type = 'example_uses_decoy_protocol'").count() == 2
    mn, me = layers.merge_corpora([(n, e), d[1:]], [ex, d[0]])
    assert mn.count() == mn.select("node_id").distinct().count() == n.union(d[1]).select("node_id").distinct().count()
    assert me.where("edge_type = 'same_parent_inchikey_as'").count() == 2 and not me.where("edge_type = 'same_inchikey_as'").count()
    with pytest.raises(ValueError):
        layers.merge_corpora([], [])


def test_positions_under_a_hot_key(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 3}", i) for i in range(30)] + [(None, 5), (None, 4)]
    x = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r["k"], r["v"]): r["n"] for r in build.rank_in_order(x, ["k"], ["v"], "n").collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        for n, v in enumerate(sorted(v for q, v in rows if q == k)):
            assert got[k, v] == n
    assert sorted(r["n"] for r in build.rank_in_order(x, [], ["v", "k"], "n").collect()) == list(range(len(rows)))


def test_side_table_sources(spark):
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "chembl": {"ligands": t([("CHEMBL1", "CC"), (None, "CN")], "Molecule_ChEMBL_ID string, Canonical_SMILES string")},
        "bindingdb": {"records": t([(7, "CC")], "no_id long, smiles string")},
        "pdbbind": {"index": t([("1abc", 5.5), ("2def", None)], "PDB string, pKd double"), "ligands": t([("1abc", "CO")], "pdb_id string, smiles string"), "proteins": None},
        "dude": {"rows": t([("a:b", "CC", "active"), ("a:b", "CC", "decoy"), ("", "CN", "Ki")], "compound_id string, smiles string, label_type string")},
    }
    got = {r["example_id"]: r for r in side_table.build_side_table(tables).collect()}
    assert {"chembl:CHEMBL1", "pdbbind:1abc", "pdbbind:2def", "dude:a_b"} < set(got) and len(got) == 5
    own = next(k for k in got if k.startswith("dude:na_row"))
    assert got[own]["label_kind"] == "pact" and got["dude:a_b"]["label_kind"] == "binary" and got["pdbbind:1abc"]["label"] == 5.5 and got["pdbbind:2def"]["smiles"] is None
    side_table.checked(side_table.build_side_table(tables))
    assert all(r["smiles_canonical"] is None for r in got.values()) or chem.toolkit_installed()
    with pytest.raises(KeyError):
        side_table.build_side_table({**tables, "nowhere": {}})
    with pytest.raises(ValueError):
        side_table.build_side_table({"bindingdb": tables["bindingdb"]})
    with pytest.raises(ValueError):
        side_table.checked(side_table.build_side_table(tables).drop("pdb_id"))


def test_manifests_by_identifier(spark):
    ex = spark.createDataFrame([("ex:s:1",), ("ex:s:2",)], "node_id string")
    ids = spark.createDataFrame([("s", "1", "s:1"), ("s", "1", "s:9"), ("s", "2", "s:2"), ("s", "3", "s:3"), ("s", "4", None)], "source string, identifier string, example_id string")
    m = spark.createDataFrame([("m", "s", "1"), ("m", "s", "3"), ("m", "s", "4"), ("m", "s", "5"), ("other", "s", "2")], "model string, source string, identifier string")
    n, e, un = build.ingest_manifest(m, ex, ids, "m")
    assert [r["node_id"] for r in n.collect()] == ["trainset:m"] and [(r["src"], r["dst"]) for r in e.collect()] == [("ex:s:1", "trainset:m")]
    assert {r["node_id"] for r in un.collect()} == {"ex:s:3", "s:4", "s:5"}
    many = build.ingest_many([("a", m.drop("model")), ("b", m.where("identifier = '2'").drop("model"))], ex, ids)
    assert {(r["src"], r["dst"]) for r in many[1].collect()} == {("ex:s:1", "trainset:a"), ("ex:s:2", "trainset:a"), ("ex:s:2", "trainset:b")}
    with pytest.raises(ValueError):
        build.ingest_manifest(m, ex)
    with pytest.raises(ValueError):
        build.ingest_manifest(m.drop("identifier"), ex, ids)


def test_example_ids_are_parsed_or_refused(spark):
    x = spark.createDataFrame([("chembl:A:1",), ("Chembl:A",), ("a::b",), ("a:",), (None,)], "i string")
    p = [r["p"] for r in x.select(text.parse_example_id(F.col("i")).alias("p")).collect()]
    assert tuple(p[0]) == ("chembl", "A:1") and p[1:] == [None] * 4
    with pytest.raises(Exception, match="malformed"):
        x.select(text.parse_example_id(F.col("i"), strict=True)).collect()
    assert [r[0] for r in spark.createDataFrame([("a", "b"), ("a:b", "c"), ("", "c"), ("a", ":b"), ("a", "")], "s string, i string").select(text.example_id(F.col("s"), F.col("i"))).collect()] == ["a:b", None, None, None, None]


def test_features_without_a_toolkit_are_null(spark):
    x = spark.createDataFrame([("CCO",), ("",), (None,)], "t string")
    got = x.select(chem.featurize(F.col("t"), chem.ToolkitFeatures()).alias("f"), chem.ToolkitFeatures().fingerprint(F.col("t")).alias("b")).collect()
    if chem.toolkit_installed():
        assert got[0]["f"]["smiles_canonical"] == "CCO" and got[1]["f"]["parse_ok"] is False
    else:
        assert all(r["f"]["smiles_canonical"] is None and r["f"]["inchikey"] is None and not r["f"]["parse_ok"] and r["b"] is None for r in got)
    bits = spark.createDataFrame([([0, 7, 8, 2047],), ([],), (None,)], "b array<int>").select("b", chem.bits_to_hex(F.col("b")).alias("h"))
    rows = bits.select("b", "h", chem.hex_to_bits(F.col("h")).alias("again")).collect()
    assert all(r["b"] == r["again"] for r in rows) and rows[0]["h"].startswith("8180") and len(rows[1]["h"]) == 512 and rows[2]["h"] is None


def test_sinks_say_what_they_leave_out(spark, tmp_path):
    x = spark.range(5).selectExpr("id", "'a|b' as t")
    md = sinks.markdown(x, "T", most=2)
    assert "3 of 5 rows are left out." in md and "a\\|b" in md and md.index("| 0 |") < md.index("| 1 |")
    p = str(tmp_path / "e")
    sinks.write_edges(raw(spark, [("a", "b", "s"), ("c", "d", "t"), ("e", "f", "u")]), p)
    sinks.replace_edge_types(raw(spark, [("x", "y", "s")]), p, ["s", "t"])
    assert {(r["src"], r["edge_type"]) for r in spark.read.parquet(p).collect()} == {("x", "s"), ("e", "u")}
    with pytest.raises(ValueError):
        sinks.replace_edge_types(raw(spark, [("x", "y", "u")]), p, ["s"])


def test_corpus_files(spark, tmp_path):
    for path, body in {
        "AVE/T1/active_T.smi": "CC id1\n", "AVE/T1/inactive_V.smi": "", "DEK/T2/active_decoys.smi": "CC BDB1\nCN zinc2\nCO x\n", "BB/test/T3/actives.csv": "uniprot,lig_smiles\nP1,CC\n", "BB/val/T4/random.csv": "lig_smiles,pocket\nCN,p\n,q\n",
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    rows = lambda df, *c: {tuple(r[k] for k in c) for r in df.collect()}
    assert rows(readers.read_corpus(spark, str(tmp_path / "AVE"), "LIT-PCBA-AVE"), "target", "label", "split") == {("T1", 1, "train")}
    assert rows(readers.read_corpus(spark, str(tmp_path / "DEK"), "DEKOIS"), "ext_id_1", "label", "label_type") == {("BDB1", 1, "active"), ("zinc2", 0, "decoy"), ("x", -1, "unknown")}
    b = readers.read_table_corpus(spark, str(tmp_path / "BB"))
    assert rows(b, "target", "split", "label", "label_type", "uniprot", "pocket") == {("T3", "test", 1, "active", "P1", None), ("T4", "val", 0, "random", None, "p")}
    with pytest.raises(KeyError):
        readers.read_corpus(spark, str(tmp_path), "nowhere")
    assert readers.read_activities_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_sweep_in_waves_and_reaudit(spark, tmp_path):
    x = spark.createDataFrame([(f"ex:{i}", i % 2) for i in range(60)], "node_id string, label int")
    e = raw(spark, [(f"ex:{i}", f"lig:{i // 3}", "example_has_ligand") for i in range(60)])
    ctx = {c: splits.SplitContext(x, e) for c in ("A", "B")}
    out = f"file://{tmp_path}"
    configs = [("random", {}), ("kg_axis_budget", {"budget_ligand": 1.0}), ("scaffold_generic", {})]
    status, code = pipeline.sweep_corpora(spark, ctx, [["A", "B"]], out, configs)
    assert code == 1 and {t.split("/")[1].split("__")[0] for t in status.todo} == {"scaffold_generic"}  # no groups given
    again, _ = pipeline.sweep_corpora(spark, ctx, [["A"], ["B"]], out, configs[:2])
    assert all(r["skipped"] for r in again.rows) and len(again.rows) == 4
    got = splits.reaudit(spark, out, "A", x, e)
    assert {(r["protocol"], r["seed"]) for r in got.collect()} == {("random", 42), ("kg_axis_budget", 42)}
    assert splits.reaudit(spark, out, "C", x, e) is None
    assert splits.parse_stored_name("a__b") is None and splits.parse_stored_name("a__b__seedx") is None and splits.parse_stored_name("a__b__seed7") == ("a", "b", 7)
    assert len(splits.SWEEP) == 14
    with pytest.raises(TypeError):
        splits.build_split("kg_axis_budget", ctx["A"], budget_nothing=1.0)


def test_shared_folder_is_asked_for_on_a_cluster():
    from taintgraph.session import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared_dir(Session())
    Context.master = "local[4]"
    assert shared_dir(Session()).startswith("file:///")
