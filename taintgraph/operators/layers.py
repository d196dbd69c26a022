"""Reference layers of the raw graph: measured activities (layer A), binding records (layer B), their contraction to
direct edges of examples, corpus builders and the merge of corpora.

A layer is one explode of structs per input row and a distinct; rows with an open end are left out. Where several rows
describe one thing, the least row counts. Ids and types are fixed names (``vocab``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgraph.functions import chem
from taintgraph.operators import build, graph
from taintgraph.vocab import REFERENCE_A, REFERENCE_B


def _props(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _node(i: Column, t: str, label: Column, props: Column | None = None) -> Column:
    return F.struct(i.alias("node_id"), F.lit(t).alias("node_type"), label.cast("string").alias("label"), (F.lit("{}") if props is None else props).alias("props"))


def _edge(a: Column, b: Column, t: str, props: Column | None = None) -> Column:
    return F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("edge_type"), (F.lit("{}") if props is None else props).alias("props"))


def _explode(df: DataFrame, *structs: Column) -> DataFrame:
    return df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def _id(prefix: str, c: Column) -> Column:
    """Null stays null."""
    return F.concat(F.lit(prefix), c.cast("string"))


def _nodes(df: DataFrame) -> DataFrame:
    """One row per id, the least of its rows."""
    return df.where("node_id is not null").groupBy("node_id").agg(F.min(F.struct("node_type", "label", "props")).alias("x")).select("node_id", "x.*")


def _edges(df: DataFrame) -> DataFrame:
    return df.where("src is not null and dst is not null").distinct()


def least_row(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the least by its other columns in order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("x")).select(*key, "x.*")


def release_nodes(spark, names: dict[str, str]) -> DataFrame:
    """A DatasetSource and a DatabaseRelease node per layer. ``names``: source -> release."""
    rows = [r for s, d in names.items() for r in ((f"src:{s}", "DatasetSource", s, "{}"), (f"dbrel:{d}", "DatabaseRelease", d, "{}"))]
    return spark.createDataFrame(rows, "node_id string, node_type string, label string, props string")


def activity_layer(mapped: DataFrame, provenance: DataFrame, names: dict[str, str] = REFERENCE_A) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of layer A.

    ``mapped``: canonical_smiles, inchikey, molregno, molecule_id, ref_smiles, match_method; one ligand node per molregno.
    ``provenance``: activity_id, molecule_id, standard_type, standard_value, standard_units, pchembl_value, assay_ref,
    doc_ref, target_ref; one activity node per activity_id."""
    spark, src = mapped.sparkSession, F.lit(f"src:{names['source']}")
    m = least_row(mapped.where("molregno is not null").select("molregno", "molecule_id", "canonical_smiles", "ref_smiles", "inchikey", "match_method"), ["molregno"])
    lig, bench = _id("chembl_lig:", F.col("molecule_id")), build.ligand_id(F.col("canonical_smiles"))
    facts = _props(molregno=F.col("molregno"), canonical_smiles_chembl=F.col("ref_smiles"), canonical_smiles_benchmark=F.col("canonical_smiles"), inchikey=F.col("inchikey"))
    p = least_row(
        provenance.where("activity_id is not null").select("activity_id", "molecule_id", "standard_type", "standard_value", "standard_units", "pchembl_value", "assay_ref", "doc_ref", "target_ref"), ["activity_id"]
    )
    act, asy, doc, tgt = _id("chembl_act:", F.col("activity_id")), _id("chembl_asy:", F.col("assay_ref")), _id("chembl_doc:", F.col("doc_ref")), _id("chembl_tgt:", F.col("target_ref"))
    value = _props(**{c: F.col(c) for c in ("standard_type", "standard_value", "standard_units", "pchembl_value")})
    nodes = (
        release_nodes(spark, {names["source"]: names["release"]})
        .union(_explode(m, _node(lig, "ChEMBLLigand", F.col("molecule_id"), facts)))
        .union(
            _explode(
                p, _node(act, "ChEMBLActivity", F.col("activity_id"), value), _node(asy, "ChEMBLAssay", F.col("assay_ref")), _node(doc, "ChEMBLDocument", F.col("doc_ref")), _node(tgt, "ChEMBLTarget", F.col("target_ref"))
            )
        )
    )
    how = _props(match_method=F.col("match_method"))
    edges = _explode(
        m, _edge(lig, src, "chembl_ligand_from_source"), _edge(bench, lig, "benchmark_ligand_same_inchikey_as_chembl_ligand", how), _edge(bench, lig, "ligand_also_in_chembl")
    ).union(
        _explode(
            p,
            _edge(act, _id("chembl_lig:", F.col("molecule_id")), "chembl_activity_has_ligand"),
            _edge(act, asy, "chembl_activity_has_assay"),
            _edge(asy, doc, "chembl_assay_from_document"),
            _edge(act, doc, "chembl_activity_has_document"),
            _edge(doc, F.when(doc.isNotNull(), src), "chembl_document_from_source"),
            _edge(act, tgt, "chembl_activity_has_target"),
        )
    )
    return _nodes(nodes), _edges(edges)


def _given(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def publication_id(pmid: str = "pmid", doi: str = "doi") -> Column:
    """A publication goes by its PubMed id, without one by its DOI, without both it is none."""
    return F.coalesce(_id("pub:pmid:", _given(pmid)), _id("pub:doi:", _given(doi)))


def record_layer(mapped: DataFrame, records: DataFrame, names: dict[str, str] = REFERENCE_B) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of layer B, for records of mapped ligands only.

    ``mapped``: canonical_smiles, inchikey, match_method. ``records``: ligand_inchikey, ligand_smiles, pmid, doi, uniprot,
    record_id."""
    spark, src = mapped.sparkSession, F.lit(f"src:{names['source']}")
    m = mapped.where("match_method <> 'unmatched' and trim(inchikey) <> ''").select("inchikey", "canonical_smiles", "match_method").distinct()
    keys = m.select("inchikey").distinct()
    r = records.withColumnRenamed("ligand_inchikey", "inchikey").join(keys, "inchikey", "left_semi")
    smiles = r.groupBy("inchikey").agg(F.min("ligand_smiles").alias("smiles"))
    lig, bench = _id("bdb_lig:", F.col("inchikey")), build.ligand_id(F.col("canonical_smiles"))
    pub, prot, rec = publication_id(), _id("protein:", _given("uniprot")), _id("bdb_rec:", _given("record_id"))
    pmid, doi = _given("pmid"), _given("doi")
    facts = F.when(pmid.isNotNull(), _props(pmid=pmid, doi=doi)).otherwise(_props(doi=doi))
    nodes = (
        release_nodes(spark, {names["source"]: names["release"]})
        .union(_explode(keys.join(smiles, "inchikey", "left"), _node(lig, "BindingDBLigand", F.col("inchikey"), _props(smiles=F.col("smiles")))))
        .union(
            _explode(
                r,
                _node(pub, "Publication", F.coalesce(pmid, doi), facts),
                _node(prot, "Protein", _given("uniprot"), _props(uniprot=_given("uniprot"), source=F.lit("BindingDB"))),
                _node(rec, "Assay", _given("record_id"), _props(source=F.lit("BindingDB"), bindingdb_record_id=_given("record_id"))),
            )
        )
    )
    how = _props(match_method=F.col("match_method"))
    edges = _explode(
        m, _edge(lig, src, "bindingdb_record_from_source"), _edge(bench, lig, "ligand_also_in_bindingdb"), _edge(bench, lig, "benchmark_ligand_same_inchikey_as_bindingdb_ligand", how)
    ).union(
        _explode(
            r,
            _edge(pub, F.when(pub.isNotNull(), src), "publication_from_source"),
            _edge(lig, pub, "bindingdb_ligand_in_publication"),
            _edge(lig, prot, "bindingdb_ligand_targets_protein"),
            _edge(rec, lig, "bindingdb_record_has_ligand"),
            _edge(rec, F.when(rec.isNotNull(), prot), "bindingdb_record_has_protein"),
        )
    )
    return _nodes(nodes), _edges(edges)


# -- contraction -----------------------------------------------------------------------------------------------------
def provenance_edges(raw: DataFrame, assay_cap: int = 5) -> DataFrame:
    """(src, dst, edge_type, origin): direct edges of examples to the assays, publications and proteins that raw edges
    (src, dst, edge_type) reach over reference ligands.

    Four chains: over measured activities to publications and to assays, of which a benchmark ligand keeps the first
    ``assay_cap`` by id; over binding records to publications and to proteins. Every step is distinct before the next join, so a promiscuous
    ligand costs its distinct ends, not its activities; the cap is a row-number limit, which Spark applies before the shuffle too."""

    def pairs(edge_type: str, a: str, b: str, forth: bool = True) -> DataFrame:
        ends = ("src", "dst") if forth else ("dst", "src")
        return raw.where(F.col("edge_type") == edge_type).select(F.col(ends[0]).alias(a), F.col(ends[1]).alias(b)).distinct()

    def chain(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        return left.join(right, on).drop(on).distinct()

    ex = pairs("example_has_ligand", "src", "bench")
    to_a = pairs("benchmark_ligand_same_inchikey_as_chembl_ligand", "bench", "lig")
    act = pairs("chembl_activity_has_ligand", "lig", "act", forth=False)
    doc = chain(to_a, chain(act, pairs("chembl_activity_has_document", "act", "dst"), "act"), "lig")
    asy = chain(to_a, chain(act, pairs("chembl_activity_has_assay", "act", "dst"), "act"), "lig")
    first = Window.partitionBy("bench").orderBy("dst")
    asy = asy.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= assay_cap).drop("rn")
    to_b = pairs("benchmark_ligand_same_inchikey_as_bindingdb_ligand", "bench", "lig")
    pub = chain(to_b, pairs("bindingdb_ligand_in_publication", "lig", "dst"), "lig")
    prot = chain(to_b, pairs("bindingdb_ligand_targets_protein", "lig", "dst"), "lig")
    parts = [(doc, "example_from_publication", "ChEMBL"), (asy, "example_from_assay", "ChEMBL"), (pub, "example_from_publication", "BindingDB"), (prot, "example_has_protein", "BindingDB")]
    out = [chain(ex, p, "bench").select("src", "dst", F.lit(t).alias("edge_type"), F.lit(o).alias("origin")) for p, t, o in parts]
    return reduce(DataFrame.union, out)


def candidate_provenance(mapped: DataFrame, activities: DataFrame, assays: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Mapped ligands with all their activities and how much of the chain ligand - target - assay - document is known.

    ``mapped``: benchmark_dataset, canonical_smiles, inchikey, molregno, molecule_id; one row per molregno counts, a ligand
    without activities stays. ``activities``: molregno, activity_id, assay_id, doc_id and the values; ``assays``: assay_id,
    assay_ref, tid; ``documents``: doc_id, doc_ref; ``targets``: tid, target_ref. All three joins keep the left row."""
    m = least_row(mapped.where("molregno is not null").select("molregno", "benchmark_dataset", "canonical_smiles", "inchikey", "molecule_id"), ["molregno"])
    values = ["standard_type", "standard_relation", "standard_value", "standard_units", "pchembl_value"]
    x = activities.select("molregno", "activity_id", "assay_id", "doc_id", *values).join(m.select("molregno"), "molregno", "left_semi")
    x = x.join(assays.select("assay_id", "assay_ref", "tid"), "assay_id", "left").join(documents.select("doc_id", "doc_ref"), "doc_id", "left").join(targets.select("tid", "target_ref"), "tid", "left")
    level = (
        F.when(F.col("target_ref").isNotNull() & F.col("doc_ref").isNotNull(), "ligand_target_assay_document")
        .when(F.col("doc_ref").isNotNull(), "ligand_assay_document")
        .when(F.col("assay_ref").isNotNull(), "ligand_assay")
        .otherwise("ligand_only")
    )
    x = x.withColumn("provenance_level", level).withColumn("confidence", F.lit("candidate"))
    return m.join(x, "molregno", "left").select(
        "benchmark_dataset", "canonical_smiles", "inchikey", "molregno", "molecule_id", "activity_id", "assay_id", "assay_ref", "doc_id", "doc_ref", "target_ref", *values, "provenance_level", "confidence"
    )


# -- corpora ---------------------------------------------------------------------------------------------------------
def corpus(rows: DataFrame, order_by: list[str], decoy_protocol: bool, provider: chem.ContentFeatures | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, nodes, edges) of loaded rows: smiles_input, source, target, label, label_type, split, ext_id_1 and more.

    Texts that the provider cannot read are left out."""
    f = rows.withColumn("f", chem.featurize(F.col("smiles_input"), provider)).where("f.parse_ok")
    x = f.select(*rows.columns, "f.smiles_canonical", "f.inchikey", "f.scaffold_smiles")
    e = build.example_ids(x, order_by)
    return e, *build.emit(e, decoy_protocol)


def measured_corpus(activities: DataFrame, source: str = "BigBind", order_by: tuple[str, ...] = ("smiles_canonical",), provider: chem.ContentFeatures | None = None):
    """A corpus of measured activities (lig_smiles, uniprot, active, ...): no decoy protocol, target is the accession."""
    on = F.coalesce(F.col("active"), F.lit(False))
    ext = F.col("ex_rec_pdb") if "ex_rec_pdb" in activities.columns else F.lit(None).cast("string")
    x = activities.withColumns(
        {
            "smiles_input": F.col("lig_smiles"), "source": F.lit(source), "target": F.col("uniprot"), "label": on.cast("tinyint"),
            "label_type": F.when(on, "active").otherwise("inactive"), "split": F.lit("unknown"), "ext_id_1": ext, "ext_id_2": F.lit(None).cast("string"),
        }
    )
    return corpus(x, list(order_by), False, provider)


def decoy_corpus(rows: DataFrame, source: str, order_by: tuple[str, ...] = ("smiles_canonical",), provider: chem.ContentFeatures | None = None):
    """A corpus of actives and decoys per target (smiles_input, target, label, ...): the accession is the target where known."""
    x = rows.withColumn("target", F.coalesce(F.col("uniprot"), F.col("target"))) if "uniprot" in rows.columns else rows
    have = {"source": F.lit(source), "ext_id_1": F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")}
    for c in ("label_type", "split"):
        if c not in rows.columns:
            have[c] = F.lit(None).cast("string")
    return corpus(x.withColumns(have), list(order_by), True, provider)


def merge_corpora(corpora: list[tuple[DataFrame, DataFrame]], examples: list[DataFrame], provider: chem.ContentFeatures | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several corpora: one row per node id and edge, and bridges between ligands of equal key, and of
    equal parent key, whose texts differ. ``examples``: smiles_canonical, inchikey each."""
    if not corpora:
        raise ValueError("no corpora to merge")
    p = provider or chem.TextFeatures()
    n = reduce(lambda a, b: a.unionByName(b), [c[0] for c in corpora])
    e = reduce(lambda a, b: a.unionByName(b), [c[1].select("src", "dst", "edge_type") for c in corpora])
    lig = reduce(DataFrame.union, [x.select("smiles_canonical", "inchikey") for x in examples]).where("smiles_canonical is not null and inchikey is not null").distinct()
    out = e
    for key, t in ((F.col("inchikey"), "same_inchikey_as"), (p.parent_key(F.col("smiles_canonical")), "same_parent_inchikey_as")):
        keyed = lig.select(key.alias("key"), F.col("smiles_canonical").alias("smi")).where("key is not null").distinct()
        stars = graph.star_bridges(keyed, "key", "smi")  # the least text is the middle
        out = out.union(stars.select(build.ligand_id(F.col("src")).alias("src"), build.ligand_id(F.col("dst")).alias("dst"), F.lit(t).alias("edge_type")))
    return _nodes(n.select("node_id", "node_type", "label", "props")), out.distinct()
