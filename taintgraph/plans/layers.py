"""Queries over the reference layers, corpora, side table, manifests, sources and sinks, each with its SQL.

The test tables hold no reference databases, so each query states which of their columns stand for what."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph import vocab
from taintgraph.functions import chem, text
from taintgraph.functions.text import accession, clean_id, strip
from taintgraph.operators import build, layers, side_table, similarity, splits
from taintgraph.plans import kg
from taintgraph.session import cut, shared_dir, table
from taintgraph.sources import readers, reference_db, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_T = lambda c: f"nullif(trim({c}, {kg.BLANKS}), '')"
_ACC = r"nullif(regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace({0}, '\s+', '', 'g')), '^[A-Z]+\|([^|]*)(\|.*)?$', '\1'), '^[A-Z][A-Z0-9_.]*:', ''), '[-.]\d+$', ''), '')"
_ACC_RE = "^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def _given(c):
    return F.nullif(strip(c), F.lit(""))


# -- layer A: structures of side_table that activities measured; molregno names the molecule ---------------------------
def _mapped_a(spark: SparkSession, sf: str) -> DataFrame:
    s, a = table(spark, sf, "side_table"), table(spark, sf, "activities")
    bench = s.select(_given(s["smiles_canonical"]).alias("canonical_smiles")).where("canonical_smiles is not null").distinct()
    ref = a.select(_given(a["lig_smiles"]).alias("ref_smiles"), "molregno").where("ref_smiles is not null").distinct()
    x = bench.join(ref, F.col("canonical_smiles") == F.col("ref_smiles"))
    return x.select(
        F.lit("side").alias("benchmark_dataset"), "canonical_smiles", F.md5("canonical_smiles").alias("inchikey"), "molregno", F.concat(F.lit("CHEMBL"), F.col("molregno").cast("string")).alias("molecule_id"), "ref_smiles", F.lit("text").alias("match_method")
    )


def _provenance_a(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "activities")
    m = _mapped_a(spark, sf).select("molregno", "molecule_id").distinct()
    x = a.join(m, "molregno")
    return x.select(
        "activity_id", "molecule_id", "standard_type", "standard_value", "standard_units", "pchembl_value", F.col("assay_id").alias("assay_ref"), F.col("doc_id").alias("doc_ref"), accession(x["uniprot"]).alias("target_ref")
    )


_SQL_A = f"""
bench as (select distinct {_T('smiles_canonical')} smi from side_table where {_T('smiles_canonical')} is not null),
ma0 as (select molregno, min(smi) smi from bench join (select distinct {_T('lig_smiles')} l, molregno from activities) a on a.l = smi where molregno is not null group by 1),
ma as (select molregno, 'CHEMBL' || molregno mol, smi from ma0),
pa as (select distinct activity_id, mol, assay_id asy, doc_id doc, {_ACC.format('uniprot')} tgt from activities join ma using (molregno)),
ea as (select 'chembl_lig:' || mol src, 'src:ChEMBL35' dst, 'chembl_ligand_from_source' edge_type from ma
  union select 'lig:' || md5(smi), 'chembl_lig:' || mol, 'benchmark_ligand_same_inchikey_as_chembl_ligand' from ma
  union select 'lig:' || md5(smi), 'chembl_lig:' || mol, 'ligand_also_in_chembl' from ma
  union select 'chembl_act:' || activity_id, 'chembl_lig:' || mol, 'chembl_activity_has_ligand' from pa
  union select 'chembl_act:' || activity_id, 'chembl_asy:' || asy, 'chembl_activity_has_assay' from pa
  union select 'chembl_asy:' || asy, 'chembl_doc:' || doc, 'chembl_assay_from_document' from pa
  union select 'chembl_act:' || activity_id, 'chembl_doc:' || doc, 'chembl_activity_has_document' from pa
  union select 'chembl_doc:' || doc, case when doc is not null then 'src:ChEMBL35' end, 'chembl_document_from_source' from pa
  union select 'chembl_act:' || activity_id, 'chembl_tgt:' || tgt, 'chembl_activity_has_target' from pa)"""


@query(f"with {_SQL_A} select * from ea where src is not null and dst is not null")
def layer_a_edges(spark, sf):
    return layers.activity_layer(_mapped_a(spark, sf), _provenance_a(spark, sf))[1].select("src", "dst", "edge_type").distinct()


@query(
    f"""with {_SQL_A} select 'src:ChEMBL35' as node_id, 'DatasetSource' as node_type, 'ChEMBL35' as label union select 'dbrel:ChEMBL_35', 'DatabaseRelease', 'ChEMBL_35'
 union select 'chembl_lig:' || mol, 'ChEMBLLigand', mol from ma union select 'chembl_act:' || activity_id, 'ChEMBLActivity', activity_id::varchar from pa
 union select 'chembl_asy:' || asy, 'ChEMBLAssay', asy::varchar from pa where asy is not null union select 'chembl_doc:' || doc, 'ChEMBLDocument', doc::varchar from pa where doc is not null
 union select 'chembl_tgt:' || tgt, 'ChEMBLTarget', tgt from pa where tgt is not null"""
)
def layer_a_nodes(spark, sf):
    return layers.activity_layer(_mapped_a(spark, sf), _provenance_a(spark, sf))[0].select("node_id", "node_type", "label")


# -- layer B: side_table rows with a bindingdb_id are the records; assay_id stands for the pmid, chembl_id for the doi ---
def _records_b(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "side_table").where("bindingdb_id is not null")
    return s.select(
        F.md5(_given(s["smiles_canonical"])).alias("ligand_inchikey"), _given(s["smiles"]).alias("ligand_smiles"), _given(s["assay_id"]).alias("pmid"), _given(s["chembl_id"]).alias("doi"), accession(s["uniprot"]).alias("uniprot"), _given(s["bindingdb_id"]).alias("record_id")
    )


def _mapped_b(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "side_table")
    x = s.where(_given(s["smiles_canonical"]).isNotNull() & s["inchikey"].isNotNull())
    return x.select(_given(x["smiles_canonical"]).alias("canonical_smiles"), F.md5(_given(x["smiles_canonical"])).alias("inchikey"), F.lit("key").alias("match_method")).distinct()


_SQL_B = f"""
mb as (select distinct {_T('smiles_canonical')} smi, md5({_T('smiles_canonical')}) ik from side_table where {_T('smiles_canonical')} is not null and inchikey is not null),
rb as (select md5({_T('smiles_canonical')}) ik, {_T('assay_id')} pmid, {_T('chembl_id')} doi, {_ACC.format('uniprot')} uni, {_T('bindingdb_id')} rec from side_table where bindingdb_id is not null and md5({_T('smiles_canonical')}) in (select ik from mb)),
rp as (select *, coalesce('pub:pmid:' || pmid, 'pub:doi:' || doi) pub from rb),
eb as (select 'bdb_lig:' || ik src, 'src:BindingDB202605' dst, 'bindingdb_record_from_source' edge_type from mb
  union select 'lig:' || md5(smi), 'bdb_lig:' || ik, 'ligand_also_in_bindingdb' from mb
  union select 'lig:' || md5(smi), 'bdb_lig:' || ik, 'benchmark_ligand_same_inchikey_as_bindingdb_ligand' from mb
  union select pub, case when pub is not null then 'src:BindingDB202605' end, 'publication_from_source' from rp
  union select 'bdb_lig:' || ik, pub, 'bindingdb_ligand_in_publication' from rp
  union select 'bdb_lig:' || ik, 'protein:' || uni, 'bindingdb_ligand_targets_protein' from rp
  union select 'bdb_rec:' || rec, 'bdb_lig:' || ik, 'bindingdb_record_has_ligand' from rp
  union select 'bdb_rec:' || rec, case when rec is not null then 'protein:' || uni end, 'bindingdb_record_has_protein' from rp)"""


@query(f"with {_SQL_B} select * from eb where src is not null and dst is not null")
def layer_b_edges(spark, sf):
    return layers.record_layer(_mapped_b(spark, sf), _records_b(spark, sf))[1].select("src", "dst", "edge_type").distinct()


@query(
    f"""with {_SQL_B} select 'src:BindingDB202605' as node_id, 'DatasetSource' as node_type, 'BindingDB202605' as label union select 'dbrel:BindingDB_2026_05', 'DatabaseRelease', 'BindingDB_2026_05'
 union select 'bdb_lig:' || ik, 'BindingDBLigand', ik from mb union select pub, 'Publication', coalesce(pmid, doi) from rp where pub is not null
 union select 'protein:' || uni, 'Protein', uni from rp where uni is not null union select 'bdb_rec:' || rec, 'Assay', rec from rp where rec is not null"""
)
def layer_b_nodes(spark, sf):
    return layers.record_layer(_mapped_b(spark, sf), _records_b(spark, sf))[0].select("node_id", "node_type", "label")


@query(
    f"""with {_SQL_B} select pub as node_id, min(case when pmid is not null then '{{"pmid":"' || pmid || '","doi":' || coalesce('"' || doi || '"', 'null') || '}}' else '{{"doi":"' || doi || '"}}' end) as props from rp where pub is not null group by 1"""
)
def publication_props(spark, sf):
    n = layers.record_layer(_mapped_b(spark, sf), _records_b(spark, sf))[0]
    return n.where("node_type = 'Publication'").select("node_id", "props")


# -- contraction ---------------------------------------------------------------------------------------------------------
def _raw_with_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The ligand edges of the side table's examples with both layers behind them."""
    s = table(spark, sf, "side_table")
    own = s.select(F.concat(F.lit("ex:"), clean_id(s["example_id"])).alias("src"), F.concat(F.lit("lig:"), F.md5(_given(s["smiles_canonical"]))).alias("dst"), F.lit("example_has_ligand").alias("edge_type"))
    both = layer_a_edges(spark, sf).union(layer_b_edges(spark, sf))
    return cut(own.where("src is not null and dst is not null").distinct().union(both), "raw")


_SQL_RAW = f"""{_SQL_A}, {_SQL_B},
ex as (select distinct 'ex:' || {kg.sql_id('example_id')} e, 'lig:' || md5({_T('smiles_canonical')}) b from side_table where {kg.sql_id('example_id')} is not null and {_T('smiles_canonical')} is not null),
act as (select distinct 'lig:' || md5(smi) b, asy, doc from ma join pa using (mol)),
asy5 as (select b, d from (select b, d, row_number() over (partition by b order by d) rn from (select distinct b, 'chembl_asy:' || asy d from act where asy is not null)) where rn <= 5),
bl as (select distinct 'lig:' || md5(smi) b, pub, uni from mb join rp using (ik)),
direct as (select e src, 'chembl_doc:' || doc dst, 'example_from_publication' edge_type, 'ChEMBL' origin from ex join act using (b) where doc is not null
  union select e, d, 'example_from_assay', 'ChEMBL' from ex join asy5 using (b)
  union select e, pub, 'example_from_publication', 'BindingDB' from ex join bl using (b) where pub is not null
  union select e, 'protein:' || uni, 'example_has_protein', 'BindingDB' from ex join bl using (b) where uni is not null)"""


def _direct(edge_type: str, origin: str):
    def run(spark, sf):
        d = layers.provenance_edges(_raw_with_layers(spark, sf))
        return d.where((F.col("edge_type") == edge_type) & (F.col("origin") == origin)).select("src", "dst")

    return run


for _name, _type, _origin in (
    ("contract_assay_a", "example_from_assay", "ChEMBL"), ("contract_publication_a", "example_from_publication", "ChEMBL"),
    ("contract_publication_b", "example_from_publication", "BindingDB"), ("contract_protein_b", "example_has_protein", "BindingDB"),
):
    QUERIES[_name] = _direct(_type, _origin)
    ORACLE[_name] = f"with {_SQL_RAW} select src, dst from direct where edge_type = '{_type}' and origin = '{_origin}'"


@query(
    f"""with {_SQL_RAW}, e0 as (select e src, b dst, 'example_has_ligand' edge_type from ex),
tn as (select distinct node_id, node_type from (select e node_id, 'Example' node_type from ex union all select b, 'Ligand' from ex union all select 'src:ChEMBL35', 'DatasetSource' union all select 'src:BindingDB202605', 'DatasetSource'
 union all select 'chembl_asy:' || asy, 'Assay' from pa where asy is not null union all select 'chembl_doc:' || doc, 'Publication' from pa where doc is not null
 union all select pub, 'Publication' from rp where pub is not null union all select 'bdb_rec:' || rec, 'Assay' from rp where rec is not null
 union all select 'protein:' || case when regexp_matches(uni, '{_ACC_RE}') then lower(uni) else uni end, 'Protein' from rp where uni is not null)),
ce as (select * from e0 union select src, case when edge_type = 'example_has_protein' and regexp_matches(substr(dst, 9), '{_ACC_RE}') then lower(dst) else dst end, edge_type from direct),
cn as (select * from tn where node_type = 'DatasetSource' or node_id in (select src from ce union select dst from ce))
select 'nodes.' || node_type as metric, count(*) as value from cn group by 1 union all select 'edges.' || edge_type, count(*) from ce group by 1"""
)
def consolidate_layers(spark, sf):
    """Sizes of the canonical graph built from the raw graph of both layers, with the direct edges."""
    raw = _raw_with_layers(spark, sf)
    a, b = layers.activity_layer(_mapped_a(spark, sf), _provenance_a(spark, sf))[0], layers.record_layer(_mapped_b(spark, sf), _records_b(spark, sf))[0]
    own = raw.where("edge_type = 'example_has_ligand'")
    ends = own.select(F.col("src").alias("node_id"), F.lit("Example").alias("node_type")).union(own.select("dst", F.lit("Ligand"))).distinct()
    n = a.unionByName(b).unionByName(ends.withColumns({"label": F.lit(None).cast("string"), "props": F.lit("{}")}))
    return sinks.stats_table(*build.consolidate(n, raw))


@query(
    f"""with {_SQL_A}, mp as (select molregno, mol, smi from ma),
x as (select distinct m.molregno, a.activity_id, a.assay_id, case when a.assay_id % 7 <> 0 then 'A' || a.assay_id end aref, a.doc_id, case when d.source is not null then 'D' || a.doc_id end dref,
  case when a.assay_id % 7 <> 0 and a.assay_id % 3 <> 0 then 'T' || (a.assay_id % 100) end tref, a.standard_type from mp m left join activities a using (molregno) left join (select distinct doc_id, source from documents) d on d.doc_id = a.doc_id)
select molregno, activity_id, aref as assay_ref, dref as doc_ref, tref as target_ref, case when tref is not null and dref is not null then 'ligand_target_assay_document' when dref is not null then 'ligand_assay_document'
 when aref is not null then 'ligand_assay' else 'ligand_only' end as provenance_level, 'candidate' as confidence from x"""
)
def candidate_provenance(spark, sf):
    """Assays whose id 7 divides are unknown, targets are known unless 3 divides it; documents are those of the table."""
    a = table(spark, sf, "activities").distinct()
    ids = a.select("assay_id").where("assay_id is not null and assay_id % 7 <> 0").distinct()
    assays = ids.select("assay_id", F.concat(F.lit("A"), F.col("assay_id").cast("string")).alias("assay_ref"), (F.col("assay_id") % 100).alias("tid").cast("long")).withColumn("tid", F.when(F.col("assay_id") % 3 != 0, F.col("tid")))
    docs = table(spark, sf, "documents").select("doc_id").distinct().select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_ref"))
    targets = assays.where("tid is not null").select("tid").distinct().select("tid", F.concat(F.lit("T"), F.col("tid").cast("string")).alias("target_ref"))
    x = layers.candidate_provenance(_mapped_a(spark, sf), a, assays, docs, targets)
    return x.select("molregno", "activity_id", "assay_ref", "doc_ref", "target_ref", "provenance_level", "confidence").distinct()


# -- corpora: activities are the measured corpus, side_table rows per accession the one with decoys ----------------------
def _measured(spark, sf):
    a = table(spark, sf, "activities").distinct().withColumn("uniprot", accession(F.col("uniprot")))
    return layers.measured_corpus(a, order_by=("smiles_canonical", "activity_id"))


def _decoys(spark, sf):
    s = table(spark, sf, "side_table").distinct()
    x = s.select(_given(s["smiles_canonical"]).alias("smiles_input"), accession(s["uniprot"]).alias("uniprot"), F.lit("t").alias("target"), F.when(s["label"] > 0, 1).otherwise(0).alias("label"), clean_id(s["example_id"]).alias("k"))
    return layers.decoy_corpus(x, "BayesBind", order_by=("smiles_canonical", "k"))


_SQL_BIG = f"""
g0 as (select distinct activity_id, {_T('lig_smiles')} smi, {_ACC.format('uniprot')} t, case when active then 1 else 0 end lab from activities where {_T('lig_smiles')} is not null),
g as (select *, concat_ws(':', 'ex', 'BigBind', t, (row_number() over (partition by t order by smi, activity_id) - 1)::varchar) ex, {{scaffold}} sca from g0)"""
_SCAFFOLD = r"'sca:' || md5(regexp_replace(regexp_extract(smi, '([A-Za-z]\d[^.]*\d)', 1), '\([^()]*\)', '', 'g'))"
_SQL_G = _SQL_BIG.format(scaffold=_SCAFFOLD)


@query(
    f"""with {_SQL_G} select ex as src, 'lig:' || md5(smi) as dst, 'example_has_ligand' as edge_type from g union select 'lig:' || md5(smi), sca, 'ligand_has_scaffold' from g union select ex, 'src:BigBind', 'example_from_source' from g
 union select ex, 'tgt:BigBind:' || t, 'example_targets_protein' from g where t is not null union select ex, 'split:BigBind:unknown', 'example_in_split' from g
 union select ex, 'lt:' || case lab when 1 then 'active' else 'inactive' end, 'example_has_label_type' from g"""
)
def measured_corpus_edges(spark, sf):
    return _measured(spark, sf)[2]


@query(
    f"""with {_SQL_G} select ex as node_id, '{{"label":' || lab || ',"target":' || coalesce('"' || t || '"', 'null') || ',"source":"BigBind"}}' as props from g"""
)
def example_props(spark, sf):
    return _measured(spark, sf)[1].where("node_type = 'Example'").select("node_id", "props")


_SQL_BAYES = f"""
b0 as (select distinct * from side_table),
b1 as (select {_T('smiles_canonical')} smi, coalesce({_ACC.format('uniprot')}, 't') t, {kg.sql_id('example_id')} k, case when label > 0 then 1 else 0 end lab from b0 where {_T('smiles_canonical')} is not null),
b as (select *, concat_ws(':', 'ex', 'BayesBind', t, (row_number() over (partition by t order by smi, k) - 1)::varchar) ex, {_SCAFFOLD} sca from b1)"""


@query(
    f"""with {_SQL_BAYES} select node_type, count(*) as n from (select distinct ex id, 'Example' node_type from b union all select distinct md5(smi), 'Ligand' from b union all select distinct sca, 'Scaffold' from b
 union all select distinct t, 'ProteinTarget' from b union all select 's', 'DatasetSource' union all select 'd', 'DecoyProtocol') group by 1"""
)
def decoy_corpus_nodes(spark, sf):
    return _decoys(spark, sf)[1].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


_RED = (
    rf"regexp_replace(regexp_replace((list_sort(list_filter(string_split(smi, '.'), lambda p: length(p) = list_max(list_transform(string_split(smi, '.'), lambda q: length(q))))))[1], '[@/\\]', '', 'g'), "
    r"'\[\d*([A-Z][a-z]?|[a-z])(?:H\d*)?(?:[+-]\d*)?\]', '\1', 'g')"
)


@query(
    f"""with {_SQL_G}, {_SQL_BAYES}, smis as (select distinct smi from g union select distinct smi from b), par as (select smi, md5({_RED}) k from smis), low as (select k, min(smi) a from par group by 1)
select 'lig:' || md5(a) as src, 'lig:' || md5(smi) as dst from par join low using (k) where smi <> a"""
)
def merged_parent_bridges(spark, sf):
    """Bridges between ligands of one parent over two merged corpora."""
    one, two = _measured(spark, sf), _decoys(spark, sf)
    e = layers.merge_corpora([one[1:], two[1:]], [one[0], two[0]])[1]
    return e.where("edge_type = 'same_parent_inchikey_as'").select("src", "dst")


@query(
    f"""with {_SQL_G}, {_SQL_BAYES}, t as (select 'Example' node_type, ex id from g union select 'Example', ex from b union select 'Ligand', md5(smi) from g union select 'Ligand', md5(smi) from b union select 'Scaffold', sca from g union select 'Scaffold', sca from b
 union select 'ProteinTarget', 'g' || t from g where t is not null union select 'ProteinTarget', 'b' || t from b union select 'DatasetSource', x from (values ('g'), ('b')) v(x) union select 'DecoyProtocol', 'b'
 union select 'Split', 'u' union select 'LabelType', lab::varchar from g)
select node_type, count(*) as n from t group by 1"""
)
def merged_corpora_nodes(spark, sf):
    one, two = _measured(spark, sf), _decoys(spark, sf)
    return layers.merge_corpora([one[1:], two[1:]], [one[0], two[0]])[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


# -- side table and manifests --------------------------------------------------------------------------------------------
def _side_sources(spark: SparkSession, sf: str) -> dict:
    """Tables of the seven loaders, cut from side_table and activities; column names are those that loaders look for."""
    s = table(spark, sf, "side_table").distinct()
    of = lambda name: s.where(F.lower(strip(F.col("source"))) == name)
    rows = lambda name: of(name).select(F.col("source_id").alias("Compound_ID"), F.col("smiles").alias("SMILES"), F.col("inchikey").alias("InChIKey"), "uniprot", "label", F.lit("active").alias("label_type"))
    x = of("pdbbind").where("pdb_id is not null")
    by_pdb = lambda *cols: x.groupBy(F.col("pdb_id").alias("pdb_code")).agg(*[F.min(c).alias(n) for c, n in cols])
    return {
        "chembl": {"ligands": of("chembl").select(F.col("source_id").alias("molecule_chembl_id"), F.col("smiles").alias("canonical_smiles"), F.col("inchikey").alias("standard_InChIKey"))},
        "bindingdb": {"records": of("bindingdb").select(F.col("source_id").alias("BindingDB_ID"), F.col("smiles").alias("Ligand_SMILES"), F.col("uniprot").alias("target_uniprot"), "target_sequence")},
        "pdbbind": {"index": by_pdb(("label", "pK")), "ligands": by_pdb(("smiles", "smiles")), "proteins": by_pdb(("uniprot", "uniprot_id"), ("target_sequence", "sequence"))},
        **{n: {"rows": rows(n)} for n in ("litpcba", "dude", "dekois", "bayesbind")},
    }


_SRC = f"lower({_T('source')})"


@query(
    f"""with s as (select distinct * from side_table), pdb as (select pdb_id id, min(smiles) smi, min(uniprot) uni, min(label) lab from s where {_SRC} = 'pdbbind' and pdb_id is not null group by 1),
x as (select 'chembl' source, source_id sid, smiles smi, null uni, 0.0::double lab, null kind from s where {_SRC} = 'chembl' union all select 'bindingdb', source_id, smiles, uniprot, 0.0, null from s where {_SRC} = 'bindingdb'
 union all select 'pdbbind', id, smi, uni, coalesce(lab, 0.0), 'pact' from pdb union all select {_SRC}, replace(coalesce(nullif(source_id, ''), '?'), ':', '_'), smiles, uniprot, coalesce(label, 0.0), 'binary' from s where {_SRC} in ('litpcba', 'dude', 'dekois', 'bayesbind'))
select source, count(distinct {kg.sql_id("source || ':' || sid")}) as n from x where sid is not null and sid <> '' group by 1 union all select 'total', count(distinct {kg.sql_id("source || ':' || sid")}) from x where sid is not null and sid <> ''"""
)
def side_table_counts(spark, sf):
    return side_table.counts(side_table.build_side_table(_side_sources(spark, sf)))


@query(
    f"""with s as (select distinct * from side_table), x as (select {_SRC} src, {_SRC} || ':' || replace(source_id, ':', '_') eid, smiles, uniprot, label from s where {_SRC} in ('litpcba', 'dude', 'dekois', 'bayesbind') and source_id <> '')
select eid as example_id, src as source, min(coalesce(label, 0.0)) as label, 'binary' as label_kind, null::varchar as smiles_canonical from x group by 1, 2"""
)
def side_table_benchmarks(spark, sf):
    """Canonical structures are null: no toolkit is installed here, and nothing stands in for one."""
    parts = {k: v for k, v in _side_sources(spark, sf).items() if k in ("litpcba", "dude", "dekois", "bayesbind")}
    x = side_table.build_side_table(parts)
    return x.groupBy("example_id", "source", "label_kind").agg(F.min("label").alias("label"), F.max("smiles_canonical").alias("smiles_canonical")).select("example_id", "source", "label", "label_kind", "smiles_canonical")


@query(
    f"""select 'repeated example_id' as problem, count(*) as n from (select example_id from side_table where example_id is not null group by 1 having count(*) > 1) union all
select 'null example_id', count(*) from side_table where example_id is null union all
select 'unknown source', count(*) from side_table where coalesce(lower(trim(source, {kg.BLANKS})) not in ({', '.join(f"'{s}'" for s in vocab.SIDE_SOURCES)}), true) union all
select 'missing column pdb_id', 1 union all select 'extra column checked', 1 union all select 'column label is string, not double', 1"""
)
def side_table_schema(spark, sf):
    """Against the fixed schema with types, of a table with a column missing, one too many and one of another type."""
    s = table(spark, sf, "side_table").drop("pdb_id").withColumn("checked", F.lit(1)).withColumn("label", F.col("label").cast("string"))
    return build.validate_side_table(s)


def _by_identifier(spark, sf):
    m = table(spark, sf, "trainset_manifest")
    k = clean_id(m["example_id"])
    x = m.select("model", F.split_part(k, F.lit(":"), F.lit(1)).alias("source"), F.regexp_replace(k, "^[^:]*:?", "").alias("identifier")).where("source is not null")
    s = table(spark, sf, "side_table")
    j = clean_id(s["example_id"])
    ids = s.select(F.split_part(j, F.lit(":"), F.lit(1)).alias("source"), F.regexp_replace(j, "^[^:]*:?", "").alias("identifier"), j.alias("example_id"))
    return x, ids


_SQL_ID = f"""m as (select distinct model, {kg.sql_id('example_id')} k from trainset_manifest where {kg.sql_id('example_id')} is not null), h as (select distinct {kg.sql_id('example_id')} k from side_table where {kg.sql_id('example_id')} is not null),
n as (select {kg.sql_id('node_id')} node_id from canonical_nodes where node_type = 'Example')"""


@query(f"with {_SQL_ID} select distinct 'ex:' || k as src, 'trainset:' || model as dst from m where k in (select k from h) and 'ex:' || k in (select node_id from n)")
def trainset_by_identifier(spark, sf):
    x, ids = _by_identifier(spark, sf)
    return build.ingest_manifest(x, kg.examples(spark, sf), ids)[1].select("src", "dst")


@query(f"with {_SQL_ID} select model, count(*) as n from (select distinct model, k from m where k not in (select k from h) or 'ex:' || k not in (select node_id from n)) group by 1")
def trainset_identifier_unresolved(spark, sf):
    x, ids = _by_identifier(spark, sf)
    return build.ingest_manifest(x, kg.examples(spark, sf), ids)[2].groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SQL_ID} select 'trainset:' || model as node_id, count(*) as n_edges from (select distinct model, k from m where 'ex:' || k in (select node_id from n)) group by 1")
def trainset_many(spark, sf):
    m = table(spark, sf, "trainset_manifest")
    names = [r[0] for r in m.select("model").distinct().orderBy("model").collect()]  # models are few: one node each
    _, e, _ = build.ingest_many([(k, m.where(F.col("model") == k).drop("model")) for k in names], kg.examples(spark, sf))
    return e.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_edges"))


# -- ids, features, audits -----------------------------------------------------------------------------------------------
@query("select source, count(*) as n, sum((source is null)::integer) as n_bad from (select case when regexp_matches(example_id, '^[a-z][a-z0-9_]*:[^:].*$') then split_part(example_id, ':', 1) end source from trainset_manifest where example_id is not null) group by 1")
def example_id_parts(spark, sf):
    m = table(spark, sf, "trainset_manifest").where("example_id is not null")
    p = m.select(text.parse_example_id(F.col("example_id"))["source"].alias("source"))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("source").isNull().cast("int")).alias("n_bad"))


_FP = kg.sql(""", l as (select distinct label t from nodes where node_type = 'Ligand' and length(label) >= 6),
f as (select t, list_sort(list_distinct(list_transform(range(1, length(t) - 4), lambda i: (cast('0x' || substr(md5(substr(t, i, 6)), 1, 8) as bigint) % 256)::integer))) b from l)""")


@query(_FP + " select t as text, len(b)::integer as n_bits, true as same, array_to_string(list_transform(range(0, 32), lambda k: printf('%02X', coalesce(list_sum(list_transform(list_filter(b, lambda x: x // 8 = k), lambda x: 1 << (7 - (x % 8)::integer))), 0)::integer)), '') as bytes from f")
def fingerprint_bytes(spark, sf):
    """Fingerprints as bytes, and whether reading the bytes gives the bits again."""
    n = kg.nodes(spark, sf).where("node_type = 'Ligand' and length(label) >= 6").select(F.col("label").alias("text")).distinct()
    x = n.withColumn("b", F.array_sort(similarity.shingle_bits(F.col("text"), 6, 256))).withColumn("bytes", chem.bits_to_hex(F.col("b"), 256))
    return x.select("text", F.size("b").alias("n_bits"), (chem.hex_to_bits(F.col("bytes")) == F.col("b")).alias("same"), "bytes")


@query(f"select distinct {_T('smiles_canonical')} as smiles_input, null::varchar as smiles_canonical, null::varchar as inchikey, null::varchar as scaffold_smiles, false as parse_ok from side_table where {_T('smiles_canonical')} is not null")
def featurize_toolkit(spark, sf):
    """Without a toolkit every feature is null and nothing counts as read."""
    s = table(spark, sf, "side_table")
    x = s.select(_given(s["smiles_canonical"]).alias("t")).where("t is not null").distinct()
    return x.select(chem.featurize(F.col("t"), chem.ToolkitFeatures()).alias("f")).select("f.*")


_SQL_DRIFT = f"""d as (select {_T('inchikey')} k, list_sort(list(distinct {_T('source')})) s from side_table where {_T('inchikey')} is not null and {_T('smiles_canonical')} is not null group by 1 having count(distinct {_T('smiles_canonical')}) > 1)"""


@query(f"with {_SQL_DRIFT} select array_to_string(s, '+') as corpora, count(*) as n_keys from d group by 1")
def drift_by_corpora(spark, sf):
    s = table(spark, sf, "side_table")
    rows = s.select(_given(s["inchikey"]).alias("key"), _given(s["smiles_canonical"]).alias("text"), _given(s["source"]).alias("source"))
    return build.drift_by_corpora(build.key_drift(rows))


@query(
    kg.sql(
        """, l as (select distinct src e, dst l from edges where edge_type = 'example_has_ligand'), p as (select distinct src e, dst t from edges where edge_type = 'example_has_protein'), s as (select distinct src e, dst s from edges where edge_type = 'example_from_source')
select s as source_id, t as target_id, l as ligand_id, count(*) as n_examples from l join p using (e) join s using (e) group by 1, 2, 3 having count(*) > 1"""
    )
)
def example_ghosts(spark, sf):
    return build.example_ghosts(kg.edges(spark, sf))


# -- a reference database whose tables are cut from the test tables -------------------------------------------------------
def _db(spark: SparkSession, sf: str):
    a, d, s = table(spark, sf, "activities").distinct(), table(spark, sf, "documents"), table(spark, sf, "side_table")
    none = F.lit(None).cast("string")
    acc = s.select(accession(s["uniprot"]).alias("accession"), "target_sequence").where("accession is not null").groupBy("accession").agg(F.min("target_sequence").alias("sequence"))
    mol = a.select("molregno").distinct()
    tables = {
        "molecule_dictionary": lambda: mol.select("molregno", F.concat(F.lit("CHEMBL"), F.col("molregno").cast("string")).alias("chembl_id"), none.alias("pref_name"), none.alias("max_phase")),
        "compound_structures": lambda: a.where("molregno % 5 <> 0").groupBy("molregno").agg(F.min(_given(F.col("lig_smiles"))).alias("canonical_smiles")).withColumn("standard_inchi_key", F.md5("canonical_smiles")),
        "activities": lambda: a,
        "assays": lambda: a.groupBy("assay_id").agg(F.min("doc_id").alias("doc_id"), F.min(F.col("assay_id") % 10).alias("tid")).select("assay_id", F.concat(F.lit("A"), F.col("assay_id").cast("string")).alias("chembl_id"), none.alias("assay_type"), none.alias("description"), "doc_id", "tid"),
        "docs": lambda: d.select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("chembl_id"), none.alias("pubmed_id"), none.alias("doi"), F.year("added_at").alias("year"), F.col("source").alias("journal"), none.alias("title")),
        "target_dictionary": lambda: acc.select(F.col("accession").alias("tid"), F.concat(F.lit("T"), F.col("accession")).alias("chembl_id"), none.alias("pref_name"), F.lit("SINGLE PROTEIN").alias("target_type"), none.alias("organism")),
        "target_components": lambda: acc.select(F.col("accession").alias("tid"), F.concat(F.lit("c"), F.col("accession")).alias("component_id")),
        "component_sequences": lambda: acc.select(F.concat(F.lit("c"), F.col("accession")).alias("component_id"), "accession", "sequence", F.when(F.substring("accession", 1, 1) < "Q", "PROTEIN").otherwise("DNA").alias("component_type"), none.alias("organism"), none.alias("description")),
    }
    return lambda name: tables[name]()


@query(f"""with a as (select distinct * from activities), s as (select molregno, min({_T('lig_smiles')}) smi from a where molregno % 5 <> 0 group by 1)
select m.molregno, 'CHEMBL' || m.molregno as molecule_chembl_id, s.smi as canonical_smiles from (select distinct molregno from a) m left join s on s.molregno = m.molregno""")
def db_ligands(spark, sf):
    return reference_db.ligands(_db(spark, sf)).select("molregno", "molecule_chembl_id", "canonical_smiles")


@query(f"""with t as (select {_ACC.format('uniprot')} acc, min(target_sequence) seq from side_table where {_ACC.format('uniprot')} is not null group by 1)
select acc as tid, 'T' || acc as target_chembl_id, acc as accession, seq as sequence from t where seq is not null and substr(acc, 1, 1) < 'Q'""")
def db_target_sequences(spark, sf):
    return reference_db.target_sequences(_db(spark, sf)).select("tid", "target_chembl_id", "accession", "sequence")


@query(f"""with a as (select distinct * from activities), s as (select molregno from a where molregno % 5 <> 0 group by 1 having min({_T('lig_smiles')}) is not null)
select activity_id, molregno, assay_id, standard_type, doc_id from a where molregno in (select molregno from s)""")
def db_activities(spark, sf):
    read = _db(spark, sf)
    return reference_db.activities_of(read, reference_db.ligands(read).where("canonical_smiles is not null")).select("activity_id", "molregno", "assay_id", "standard_type", "doc_id")


@query("""select a.assay_id, 'A' || a.assay_id as assay_chembl_id, d.document_chembl_id, d.year from (select assay_id, min(doc_id) doc_id from activities group by 1) a
left join (select doc_id, 'D' || doc_id as document_chembl_id, year(added_at) as year from documents) d on d.doc_id = a.doc_id""")
def db_assay_documents(spark, sf):
    read = _db(spark, sf)
    return reference_db.assays(read).join(reference_db.documents(read), "doc_id", "left").select("assay_id", "assay_chembl_id", "document_chembl_id", "year")


@query(f"""with x as (select {_T('smiles')} smi, md5({_T('smiles')}) ik, {_T('assay_id')} pmid, {kg.sql_id('example_id')} k from side_table where {kg.sql_id('example_id')} is not null and {_T('smiles')} is not null and not regexp_matches({_T('smiles')}, '[\n\r\t]'))
select ik as ligand_inchikey, min(smi) as ligand_smiles, count(*) as n_records, count(pmid) as n_pmid from x group by 1""")
def binding_table(spark, sf):
    """A wide table with known and unknown columns in another order, and lines that end early."""
    s, path = table(spark, sf, "side_table"), _place(spark)
    x = s.select(clean_id(s["example_id"]).alias("k"), _given(s["smiles"]).alias("smi"), _given(s["assay_id"]).alias("pmid")).where("k is not null and smi is not null")
    x = x.where(~F.col("smi").rlike("[\n\r\t]"))
    head = spark.createDataFrame([("odd\tPMID\tLigand InChI Key\tLigand SMILES\tmore",), ("x\t1\tshort",)], "value string")
    line = x.select(F.concat_ws("\t", F.lit("-"), F.coalesce("pmid", F.lit("")), F.md5("smi"), "smi").alias("value"))
    head.union(line).coalesce(1).write.text(path)
    rec, lig = reference_db.binding_records(spark, path)
    n = rec.groupBy("ligand_inchikey").agg(F.count(F.lit(1)).alias("n_records"), F.count("pmid").alias("n_pmid"))
    return lig.join(n, "ligand_inchikey").select("ligand_inchikey", "ligand_smiles", "n_records", "n_pmid")


# -- sources and sinks: written to the shared folder and read again --------------------------------------------------------
def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query(f"select distinct {_T('lig_smiles')} as lig_smiles, standard_type, standard_value, pchembl_value, active from activities where {_T('lig_smiles')} is not null")
def activities_csv(spark, sf):
    """Written as CSV in another column order with a stray column, and read by name."""
    a, path = table(spark, sf, "activities"), _place(spark)
    x = a.select("pchembl_value", F.lit("x").alias("stray"), _given(a["lig_smiles"]).alias("lig_smiles"), "standard_value", "standard_type", "active").where("lig_smiles is not null")
    x.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_activities_csv(spark, path).select("lig_smiles", "standard_type", "standard_value", "pchembl_value", "active").distinct()


@query(f"select {kg.sql_id('example_id')} as k, min(assay_id) as first_assay, count(*) as n from side_table where {kg.sql_id('example_id')} is not null and assay_id is not null group by 1")
def wide_tsv_projection(spark, sf):
    """Two columns of a wide TSV by header name, without lines that are too short; the first-seen row per key."""
    s, path = table(spark, sf, "side_table"), _place(spark)
    x = s.select(clean_id(s["example_id"]).alias("k"), "assay_id").where("k is not null and assay_id is not null")
    line = x.select(F.concat_ws("\t", F.lit("-"), "k", F.lit("-"), "assay_id").alias("value"))
    head = spark.createDataFrame([("a\tkey\tb\tassay",), ("short\tline",)], "value string")
    head.union(line).coalesce(1).write.text(path)
    got = readers.read_wide_tsv(spark, path, {"assay": "assay_id", "key": "k"})
    n = got.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return readers.first_seen(got, "k", "assay_id").join(n, "k").select("k", F.col("assay_id").alias("first_assay"), "n")


def _put(spark: SparkSession, path: str, body: str) -> None:
    """One small file of a given name."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath)
    out.write(bytearray(body.encode("utf-8")))
    out.close()


@query("""select r_name as target, case when n_nationkey % 2 = 1 then 1 else 0 end as label, case when n_nationkey % 2 = 1 then 'active' else 'inactive' end as label_type,
 case when n_nationkey % 3 = 0 then 'validation' else 'train' end as split, 'C' || n_nationkey as smiles_input, 'n' || n_nationkey as ext_id_1 from nation join region on n_regionkey = r_regionkey""")
def corpus_files(spark, sf):
    """A corpus of files by target folder, label and split by file name; an empty file beside them."""
    root = _place(spark)
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey").collect()  # fixed tables of 25 and 5 rows
    files: dict[str, list[str]] = {"NONE/active_T.smi": []}
    for r in rows:
        name = ("active" if r["n_nationkey"] % 2 else "inactive") + ("_V" if r["n_nationkey"] % 3 == 0 else "_T") + ".smi"
        files.setdefault(f"{r['r_name']}/{name}", []).append(f"C{r['n_nationkey']} n{r['n_nationkey']}\n")
    for name, lines in files.items():
        _put(spark, f"{root}/{name}", "".join(lines))
    return readers.read_corpus(spark, root, "LIT-PCBA-AVE").select("target", F.col("label").cast("int").alias("label"), "label_type", "split", "smiles_input", "ext_id_1")


@query(f"select {_T('smiles_canonical')} as text, count(*) as n from side_table where {_T('smiles_canonical')} is not null group by 1")
def text_by_schema(spark, sf):
    """The column of structures, chosen from the schema alone."""
    s = table(spark, sf, "side_table").select(F.col("smiles_canonical").alias("canonical_smiles"), "label")
    c = readers.text_column(s)
    return s.select(_given(s[c]).alias("text")).where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("select n_nationkey::varchar as key, n_name as name from nation")
def headerless_tsv(spark, sf):
    path = _place(spark)
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.option("sep", "\t").csv(path)
    return readers.read_tsv(spark, path, ["key", "name"])


@query(rf"select {_T('smiles')} as smiles_input, {_T('source_id')} as ext_id_1, 'ts' as target, 1 as label from side_table where not regexp_matches(coalesce({_T('smiles')}, ' '), '\s') and not regexp_matches(coalesce({_T('source_id')}, ' '), '\s') and not starts_with({_T('smiles')}, '#')")
def smi_files(spark, sf):
    s, path = table(spark, sf, "side_table"), _place(spark)
    x = s.select(_given(s["smiles"]).alias("smi"), _given(s["source_id"]).alias("sid"))
    x = x.where(~F.coalesce("smi", F.lit(" ")).rlike(r"\s") & ~F.coalesce("sid", F.lit(" ")).rlike(r"\s"))
    x.select(F.concat_ws(" ", "smi", "sid")).write.text(path)
    got = readers.read_smi(spark, path, "side", "ts", 1, "active")
    return got.select("smiles_input", "ext_id_1", "target", F.col("label").cast("int").alias("label"))


@query("select edge_type, count(*) as n, min(src) as first_src from (select distinct src, dst, edge_type from canonical_edges) where edge_type <> 'ligand_similar' and edge_type <> 'ligand_exact' group by 1 union all select 'ligand_exact', 1, 'a'")
def edge_store(spark, sf):
    """Edges stored by type; of two types replaced, one has new edges and the other none."""
    e, path = table(spark, sf, "canonical_edges").select("src", "dst", "edge_type").distinct(), _place(spark)
    sinks.write_edges(e, path)
    sinks.replace_edge_types(spark.createDataFrame([("a", "b", "ligand_exact")], "src string, dst string, edge_type string"), path, ["ligand_similar", "ligand_exact"])
    return spark.read.parquet(path).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"))


@query("select n_regionkey::bigint as k, count(*) as v from nation group by 1 union all select 100, 7")
def report_upsert(spark, sf):
    """A CSV report whose rows of one key are replaced, and one added."""
    path = _place(spark)
    one = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    sinks.upsert_csv(one.withColumn("v", F.when(F.col("k") == 1, -5).otherwise(F.col("v")).cast("long")), path, ["k"])
    sinks.upsert_csv(one.where("k = 1").union(spark.createDataFrame([(100, 7)], "k long, v long")), path, ["k"])
    return spark.read.option("header", True).schema("k long, v long").csv(path)


@query(f"select {_ACC.format('uniprot')} as id, min(target_sequence) as seq from side_table where {_ACC.format('uniprot')} is not null and target_sequence is not null group by 1")
def fasta_records(spark, sf):
    """Written as FASTA with wrapped lines and put together again."""
    s, path = table(spark, sf, "side_table"), _place(spark)
    x = s.select(accession(s["uniprot"]).alias("id"), "target_sequence").where("id is not null and target_sequence is not null").groupBy("id").agg(F.min("target_sequence").alias("seq"))
    sinks.write_fasta(x, path, "id", "seq")
    rec = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    return rec.select(F.substring_index("value", "\n", 1).alias("id"), F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n", ""), "\n", "").alias("seq"))


@query("select n_regionkey::varchar as k, count(*)::varchar as n from nation group by 1")
def markdown_rows(spark, sf):
    """A report as Markdown, read back from its lines."""
    x = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("k")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    lines = [ln.strip("| ").split(" | ") for ln in sinks.markdown(x, "nations").splitlines()[4:] if ln.startswith("|")]
    return spark.createDataFrame([tuple(ln) for ln in lines], "k string, n string")


@query("select model, count(*) as n from trainset_manifest group by 1")
def manifest_files(spark, sf):
    m, path = table(spark, sf, "trainset_manifest"), _place(spark) + ".tsv"
    m.select("model", "example_id").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_manifest(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("select corpus, protocol, params, seed, v, w from (values ('a', 'random', 'default', 42, 3, null), ('a', 'random', 'default', 7, 1, null), ('b', 'scaffold', 'default', 42, 5, 9)) t(corpus, protocol, params, seed, v, w)")
def merged_audits(spark, sf):
    del sf
    one = spark.createDataFrame([("a", "random", "default", 42, 2), ("a", "random", "default", 7, 1)], "corpus string, protocol string, params string, seed int, v int")
    two = spark.createDataFrame([("a", "random", "default", 42, 3, None), ("b", "scaffold", "default", 42, 5, 9)], "corpus string, protocol string, params string, seed int, v int, w int")
    return splits.merge_audits([one, two])
