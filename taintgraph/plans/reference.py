"""Queries over the graph operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taintgraph import vocab
from taintgraph.functions import chem, stats
from taintgraph.functions.text import accession, clean_id, inchi_block, strip
from taintgraph.operators import audits, build, graph, models, similarity, splits
from taintgraph.plans import kg
from taintgraph.session import table
from taintgraph.sources import readers, sinks
from taintgraph.streaming import tagger
from taintgraph.vocab import AXES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- build -----------------------------------------------------------------------------------------------------------
@query(kg.sql("select * from nodes"))
def kg_nodes(spark, sf):
    return kg.nodes(spark, sf)


@query(kg.sql("select * from edges"))
def kg_edges(spark, sf):
    return kg.edges(spark, sf)


@query(kg.sql("select edge_type, count(*) as n from edges group by 1"))
def edge_type_counts(spark, sf):
    return kg.edges(spark, sf).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(kg.sql("select source, label, count(*) as n, count(target) as n_target from examples group by 1, 2"))
def examples_json(spark, sf):
    return kg.examples(spark, sf).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("n_target"))


@query(kg.sql("select source, label, count(*) as n_examples from examples where source = 'chembl' group by 1, 2"))
def corpus_examples(spark, sf):
    return kg.examples(spark, sf).where("source = 'chembl'").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_examples"))


_SIDE = f"(select distinct {kg.sql_id('example_id')} k, trim(source, {kg.BLANKS}) source, trim(smiles_canonical, {kg.BLANKS}) smi, trim(source_id, {kg.BLANKS}) sid, label from side_table)"


def _side(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "side_table")
    return s.select(clean_id(s["example_id"]).alias("k"), strip(s["source"]).alias("source"), strip(s["smiles_canonical"]).alias("smi"), strip(s["source_id"]).alias("sid"), "label").distinct()


@query(
    f"""with s as (select distinct k, source, smi from {_SIDE} where k is not null and smi <> ''), e as (
 select 'ex:' || source || ':t:' || (row_number() over (partition by source order by k, smi) - 1) ex, 'lig:' || md5(smi) lig, 'src:' || source so from s)
select ex as src, lig as dst, 'example_has_ligand' as edge_type from e union select ex, so, 'example_from_source' from e
union select lig, 'sca:' || md5(''), 'ligand_has_scaffold' from e union select ex, 'tgt:' || split_part(so, ':', 2) || ':t', 'example_targets_protein' from e"""
)
def emit_edges(spark, sf):
    s = _side(spark, sf).where("k is not null and smi <> ''").select("k", "source", "smi").distinct()
    x = s.select("source", F.lit("t").alias("target"), F.col("smi").alias("smiles_canonical"), F.lit(None).cast("string").alias("scaffold_smiles"), "k", F.lit(1).alias("label"))
    return build.emit(build.example_ids(x, ["k", "smiles_canonical"]))[1]


@query(
    f"""with s as (select distinct k, source, smi from {_SIDE} where k is not null and smi <> ''), e as (
 select 'ex:' || source || ':t:' || (row_number() over (partition by source order by k, smi) - 1) ex, 'lig:' || md5(smi) lig, source so, smi from s)
select node_type, count(*) as n from (select ex id, 'Example' node_type from e union select lig, 'Ligand' from e union select 'sca', 'Scaffold' from e
 union select so, 'ProteinTarget' from e union select so, 'DatasetSource' from e) group by 1"""
)
def emit_node_counts(spark, sf):
    s = _side(spark, sf).where("k is not null and smi <> ''").select("k", "source", "smi").distinct()
    x = s.select("source", F.lit("t").alias("target"), F.col("smi").alias("smiles_canonical"), F.lit(None).cast("string").alias("scaffold_smiles"), "k", F.lit(1).alias("label"))
    return build.emit(build.example_ids(x, ["k", "smiles_canonical"]))[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select lab as label_type, count(*) as n from (select case when regexp_matches(sid, '(?i)^BDB\\d+') then 1 when regexp_matches(sid, '(?i)^ZINC\\d+') then 0 else -1 end lab
from {_SIDE} where sid is not null) group by 1"""
)
def id_prefix_label(spark, sf):
    s = _side(spark, sf).where("sid is not null")
    return s.select(build.label_of_id(F.col("sid")).alias("label_type")).groupBy("label_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with l as (select coalesce(smiles, '') || ' ' || coalesce(source_id, '') || ' ' || coalesce(source, '') v from side_table),
t as (select regexp_split_to_array(trim(v, {kg.BLANKS}), '\\s+') t, v from l where trim(v) <> '' and not starts_with(ltrim(v), '#'))
select t[1] as smiles_input, t[2] as ext_id_1, t[3] as ext_id_2 from t"""
)
def smi_text_scan(spark, sf):
    s = table(spark, sf, "side_table")
    line = F.concat(F.coalesce("smiles", F.lit("")), F.lit(" "), F.coalesce("source_id", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")))
    return readers.parse_smi(s.select(line.alias("value")))


_IK = r"substr(regexp_replace(upper(regexp_replace(inchikey, '\s+', '', 'g')), '^INCHIKEY=', ''), 1, 14)"


@query(f"select {_IK} as block, count(*) as n from side_table where length({_IK}) = 14 group by 1")
def prefix_key(spark, sf):
    s = table(spark, sf, "side_table")
    return s.select(inchi_block(s["inchikey"]).alias("block")).where("block is not null").groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query(kg.sql("select node_id, length(regexp_replace(label, '[^A-Za-z]', '', 'g')) as letters from nodes where node_type = 'Scaffold'"))
def letter_count(spark, sf):
    return kg.nodes(spark, sf).where("node_type = 'Scaffold'").select("node_id", chem.letter_count(F.col("label")).alias("letters"))


@query(
    f"""select smi as smiles_input, smi as smiles_canonical, md5(smi) as inchikey, true as parse_ok from {_SIDE} where smi <> '' group by smi"""
)
def featurize(spark, sf):
    s = _side(spark, sf).where("smi <> ''").select("smi").distinct()
    return s.select(chem.featurize(F.col("smi")).alias("f")).select("f.smiles_input", "f.smiles_canonical", "f.inchikey", "f.parse_ok")


_GEN = r"regexp_replace(regexp_replace({0}, '\[[^\]]*\]|Cl|Br|[A-Za-z]', 'C', 'g'), '[=#/\\@+\-]', '', 'g')"


@query(kg.sql(f"select distinct label as scaffold, {_GEN.format('label')} as generic from nodes where node_type = 'Scaffold'"))
def generic_scaffolds(spark, sf):
    n = kg.nodes(spark, sf).where("node_type = 'Scaffold'").select("label").distinct()
    return n.select(F.col("label").alias("scaffold"), chem.generic_scaffold(F.col("label")).alias("generic"))


# -- canonicalisation ------------------------------------------------------------------------------------------------
_RAW_NODES = f"(select {kg.sql_id('node_id')} node_id, node_type from canonical_nodes where {kg.sql_id('node_id')} is not null)"


@query(f"select node_type, count(distinct node_id) as n from {_RAW_NODES} group by 1")
def type_map(spark, sf):
    n = table(spark, sf, "canonical_nodes").withColumn("node_id", clean_id(F.col("node_id"))).where("node_id is not null")
    return build.map_node_types(n).groupBy("node_type").agg(F.countDistinct("node_id").alias("n"))


_ACC = r"upper(regexp_extract(node_id, '^(?:tgt:.*|protein):([^:]+)$', 1))"


@query(
    f"""select new_id as node_id, count(*) as n from (select distinct node_id, case when regexp_matches({_ACC}, '^([OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}})$')
 then 'protein:' || lower({_ACC}) else node_id end new_id from {_RAW_NODES} where node_type = 'Protein') group by 1"""
)
def protein_collapse(spark, sf):
    n = kg.nodes(spark, sf).where("node_type = 'Protein'")
    return n.select(build.protein_node(F.col("node_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query(kg.sql("select node_id from nodes where node_type = 'Scaffold' and coalesce(length(regexp_replace(label, '[^A-Za-z]', '', 'g')), 0) <= 60"))
def trivial_scaffolds(spark, sf):
    return build.trivial_scaffolds(kg.nodes(spark, sf), 60).select("node_id")


@query(
    kg.sql(
        """, gone as (select node_id from nodes where node_type = 'Scaffold' and coalesce(length(regexp_replace(label, '[^A-Za-z]', '', 'g')), 0) <= 60)
select edge_type, count(*) as n from edges where src not in (select node_id from gone) and dst not in (select node_id from gone) group by 1"""
    )
)
def trivial_scaffold_drop(spark, sf):
    n, e = kg.nodes(spark, sf), kg.edges(spark, sf)
    return build.drop_nodes(n, e, build.trivial_scaffolds(n, 60))[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(kg.sql("select src, dst, edge_type from edges where src in (select node_id from nodes) and dst in (select node_id from nodes)"))
def dangling_prune(spark, sf):
    return graph.prune_dangling(kg.nodes(spark, sf), kg.edges(spark, sf)).select("src", "dst", "edge_type")


@query(
    kg.sql("select node_id, node_type from nodes where node_type in ('DatasetSource', 'DecoyProtocol') or node_id in (select src from edges union select dst from edges)")
)
def orphan_drop(spark, sf):
    return graph.drop_orphans(kg.nodes(spark, sf), kg.edges(spark, sf)).select("node_id", "node_type")


_DEG = ", deg as (select node_id, count(*) d from (select src node_id from edges union all select dst from edges) group by 1)"


@query(kg.sql(_DEG + " select node_id, d as degree from deg"))
def node_degree(spark, sf):
    return graph.degrees(kg.edges(spark, sf))


@query(kg.sql(_DEG + " select n.node_id, coalesce(d, 0) as degree, coalesce(d, 0) > 50 as is_hub from nodes n left join deg using (node_id)"))
def hub_flag(spark, sf):
    return graph.flag_hubs(kg.nodes(spark, sf), kg.edges(spark, sf), 50).select("node_id", "degree", "is_hub")


@query()
def hub_flag_full(spark, sf):
    return graph.flag_hubs(kg.nodes(spark, sf), kg.edges(spark, sf), vocab.HUB_DEGREE).select("node_id", "degree", "is_hub")


_PAPERS = f"(select upper(split_part({kg.sql_id('node_id')}, ':', 2)) a from canonical_nodes where node_type = 'Protein')"


@query(f"""select distinct 'protein:' || lower(a) as src, 'ProteinCluster::' || r || '::' || substr(a, 1, l) as dst, 'protein_in_cluster' as edge_type
from {_PAPERS}, (values ('30', 1), ('50', 2), ('90', 3)) v(r, l)""")
def cluster_edges(spark, sf):
    n = kg.nodes(spark, sf).where("node_type = 'Protein'").select(F.upper(F.split_part("node_id", F.lit(":"), F.lit(2))).alias("accession"))
    c = n.select("accession", F.explode(F.array(*[F.struct(F.lit(r).alias("resolution"), F.substring("accession", 1, k).alias("cluster_id")) for r, k in (("30", 1), ("50", 2), ("90", 3))])).alias("x"))
    return build.cluster_nodes_edges(c.select("accession", "x.*"))[1]


@query(
    kg.sql(
        """select distinct l.dst as src, p.dst as dst from edges l join edges p on l.src = p.src
where l.edge_type = 'example_has_ligand' and p.edge_type = 'example_from_publication'"""
    )
)
def provenance_contract(spark, sf):
    e = kg.edges(spark, sf)
    left = e.where("edge_type = 'example_has_ligand'").select(F.col("dst").alias("src"), F.col("src").alias("mid"))
    right = e.where("edge_type = 'example_from_publication'").select(F.col("src").alias("mid"), "dst")
    return graph.contract_paths(left, right)


@query(
    kg.sql(
        """, la as (select distinct l.dst lig, p.dst assay from edges l join edges p on l.src = p.src where l.edge_type = 'example_has_ligand' and p.edge_type = 'example_from_assay')
select lig as ligand, assay from (select *, row_number() over (partition by lig order by assay) rn from la) where rn <= 5"""
    )
)
def top5_assay_cap(spark, sf):
    e = kg.edges(spark, sf)
    left = e.where("edge_type = 'example_has_ligand'").select(F.col("dst").alias("src"), F.col("src").alias("mid"))
    right = e.where("edge_type = 'example_from_assay'").select(F.col("src").alias("mid"), "dst")
    pairs = graph.contract_paths(left, right).select(F.col("src").alias("ligand"), F.col("dst").alias("assay"))
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy("ligand").orderBy("assay"))).where("rn <= 5").drop("rn")


@query(
    """with d as (select doc_id, min(source) s from documents group by 1), a as (select distinct * from activities)
select case when s is not null and pchembl_value is not null then 'full' when s is not null then 'document' when assay_id is not null then 'assay' else 'none' end as provenance_level,
case when pchembl_value is not null then 1.0::double else 0.5::double end as confidence, count(*) as n from a left join d using (doc_id) group by 1, 2"""
)
def provenance_level(spark, sf):
    p = build.provenance(table(spark, sf, "activities").distinct(), table(spark, sf, "documents"))
    return p.groupBy("provenance_level", "confidence").agg(F.count(F.lit(1)).alias("n"))


def _maps(spark, sf):
    s = table(spark, sf, "side_table")
    bench = s.select(strip(s["source"]).alias("dataset"), inchi_block(s["inchikey"]).alias("key"), strip(s["smiles_canonical"]).alias("text")).where("dataset <> 'chembl'").distinct()
    c = s.where(strip(s["source"]) == "chembl")
    ref = c.select(strip(c["source_id"]).alias("ref_id"), inchi_block(c["inchikey"]).alias("key"), strip(c["smiles_canonical"]).alias("text"))
    return build.reference_map(bench, ref)


_MAP = f"""with s as (select trim(source, {kg.BLANKS}) src, case when length({_IK}) = 14 then {_IK} end k, trim(smiles_canonical, {kg.BLANKS}) t, trim(source_id, {kg.BLANKS}) i from side_table),
b as (select distinct src as dataset, k, t from s where src <> 'chembl'),
rk as (select k, min(i) i from s where src = 'chembl' and k is not null group by 1), rt as (select t, min(i) i from s where src = 'chembl' and t is not null group by 1),
m as (select dataset, b.k as key, b.t as text, coalesce(rk.i, rt.i) as ref_id, case when rk.i is not null then 'key' when rt.i is not null then 'text' else 'unmatched' end as match_method
 from b left join rk on rk.k = b.k left join rt on rt.t = b.t)"""


@query(_MAP + " select * from m")
def ref_map_cascade(spark, sf):
    return _maps(spark, sf)


@query(_MAP + " select dataset, match_method, count(*) as n from m group by 1, 2")
def ref_map_rates(spark, sf):
    return build.match_rates(_maps(spark, sf))


@query(
    f"""with s as (select distinct {_IK} k, 'lig:' || md5(trim(smiles_canonical, {kg.BLANKS})) m from side_table where length({_IK}) = 14 and trim(smiles_canonical, {kg.BLANKS}) <> ''),
f as (select k, min(m) src from s group by 1) select distinct src, m as dst from s join f using (k) where m <> src"""
)
def same_key_bridge(spark, sf):
    s = table(spark, sf, "side_table")
    x = s.select(inchi_block(s["inchikey"]).alias("k"), F.nullif(strip(s["smiles_canonical"]), F.lit("")).alias("t")).select("k", F.concat(F.lit("lig:"), F.md5("t")).alias("m"))
    return graph.star_bridges(x, "k", "m")


@query(
    kg.sql("select distinct least(src, dst) as src, greatest(src, dst) as dst, edge_type from edges where edge_type = 'ligand_similar' union all select src, dst, edge_type from edges where edge_type <> 'ligand_similar'")
)
def pair_canonical_dedup(spark, sf):
    return graph.canonical_pairs(kg.edges(spark, sf), ["ligand_similar"])


@query(
    f"""select k as key, count(distinct t) as n_text, list_sort(list(distinct s)) as sources from (select case when length({_IK}) = 14 then {_IK} end k, nullif(trim(smiles_canonical, {kg.BLANKS}), '') t, trim(source, {kg.BLANKS}) s from side_table)
where k is not null and t is not null group by 1 having count(distinct t) > 1"""
)
def key_drift(spark, sf):
    s = table(spark, sf, "side_table")
    return build.key_drift(s.select(inchi_block(s["inchikey"]).alias("key"), F.nullif(strip(s["smiles_canonical"]), F.lit("")).alias("text"), strip(s["source"]).alias("source")))


@query("select substr(k, 1, 14) as block, count(distinct k) as n_keys from (select upper(trim(inchikey)) k from side_table where inchikey is not null) group by 1 having count(distinct k) > 1")
def prefix_drift(spark, sf):
    s = table(spark, sf, "side_table")
    return build.prefix_drift(s.select(F.upper(F.trim("inchikey")).alias("key")))


@query(kg.sql("select src, dst, edge_type, count(*) as n from raw_edges group by 1, 2, 3 having count(*) > 1"))
def ghost_triples(spark, sf):
    return build.ghost_triples(kg.raw_edges(spark, sf))


@query(kg.sql("select n as times, count(*) as n_triples from (select count(*) n from raw_edges group by src, dst, edge_type having count(*) > 1) group by 1"))
def ghost_histogram(spark, sf):
    return build.ghost_histogram(build.ghost_triples(kg.raw_edges(spark, sf)))


@query(
    kg.sql(
        """select 'duplicate_id' as "check", 0::bigint as n_bad union all select 'no_prefix', count(*) from nodes where node_id not like '%:%'
union all select 'dangling_end', count(*) from (select src i from edges union all select dst from edges) where i not in (select node_id from nodes)"""
    )
)
def build_invariants(spark, sf):
    return build.invariants(kg.nodes(spark, sf), kg.edges(spark, sf))


def _nid(c: str) -> str:
    acc = f"upper(regexp_extract({c}, '^(?:tgt:.*|protein):([^:]+)$', 1))"
    return f"case when regexp_matches({acc}, '^([OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}})$') then 'protein:' || lower({acc}) else {c} end"


@query(
    kg.sql(
        f""", n0 as (select {_nid('node_id')} node_id, min(node_type) node_type, min(label) label from nodes group by 1), e0 as (select distinct {_nid('src')} src, {_nid('dst')} dst, edge_type from edges),
gone as (select node_id from n0 where node_type = 'Scaffold' and coalesce(length(regexp_replace(label, '[^A-Za-z]', '', 'g')), 0) <= 6), n1 as (select * from n0 where node_id not in (select node_id from gone)),
e1 as (select * from e0 where src in (select node_id from n1) and dst in (select node_id from n1)),
n2 as (select * from n1 where node_type in ('DatasetSource', 'DecoyProtocol') or node_id in (select src from e1 union select dst from e1)),
e2 as (select distinct least(src, dst) src, greatest(src, dst) dst, edge_type from e1 where edge_type = 'ligand_similar' union select * from e1 where edge_type <> 'ligand_similar')
select 'nodes.' || node_type as metric, count(*) as value from n2 group by 1 union all select 'edges.' || edge_type, count(*) from e2 group by 1"""
    )
)
def consolidate_stats(spark, sf):
    n = table(spark, sf, "canonical_nodes").withColumn("node_id", clean_id(F.col("node_id"))).where("node_id is not null").select("node_id", "node_type", "label", "props").distinct()
    return sinks.stats_table(*build.consolidate(n, kg.raw_edges(spark, sf).select("src", "dst", "edge_type").distinct()))


# -- traversal -------------------------------------------------------------------------------------------------------
_LIGAND = kg.sql_types(vocab.AXES["ligand"])
_TRAIN = "select node_id from folds where fold = 'train'"


def _train(spark, sf):
    return kg.folds(spark, sf).where("fold = 'train'").select("node_id")


def _axis(spark, sf, axis="ligand", axes=None):
    return graph.axis_edges(kg.edges(spark, sf), axis, axes or vocab.AXES)


@query(kg.sql("select a as axis, count(*) as n from edges join (values " + ", ".join(f"('{a}', '{t}')" for a, ts in vocab.AXES.items() for t in ts) + ") v(a, t) on t = edge_type group by 1"))
def axis_edges(spark, sf):
    e = kg.edges(spark, sf)
    out = None
    for a in vocab.AXES:
        part = graph.axis_edges(e, a, vocab.AXES).select(F.lit(a).alias("axis"))
        out = part if out is None else out.union(part)
    return out.groupBy("axis").agg(F.count(F.lit(1)).alias("n"))


@query(kg.sql(f"select src, dst from edges where {_LIGAND} union select dst, src from edges where {_LIGAND}"))
def symmetric_edges(spark, sf):
    return graph.symmetrise(_axis(spark, sf))


def _bfs_query(k: int):
    def f(spark, sf):
        return graph.bfs(_axis(spark, sf), _train(spark, sf), k)

    f.__name__ = f"bfs_hop{k}"
    return query(kg.sql(kg.sql_bfs("r", _TRAIN, _LIGAND, k) + " select node_id, hop from r"))(f)


bfs_hop1, bfs_hop2, bfs_hop3 = (_bfs_query(k) for k in (1, 2, 3))


@query(kg.sql(kg.sql_bfs("r", "select node_id from nodes where node_type = 'DecoyProtocol'", "edge_type in ('source_decoy_protocol', 'example_from_source')", 2) + " select node_id, hop from r where hop > 0"))
def khop_neighbors(spark, sf):
    e = graph.edges_of_types(kg.edges(spark, sf), ["source_decoy_protocol", "example_from_source"])
    return graph.khop_neighbours(e, kg.nodes(spark, sf).where("node_type = 'DecoyProtocol'"), 2)


@query(kg.sql(kg.sql_bfs("r", _TRAIN, kg.sql_types(vocab.AXES["publication"]), 2) + " select f.node_id, hop from folds f left join r using (node_id) where fold = 'test'"))
def dist_to_anchor(spark, sf):
    f = kg.folds(spark, sf)
    return graph.distance_to(_axis(spark, sf, "publication"), f.where("fold = 'train'"), f.where("fold = 'test'"), 2)


_FULL = kg.sql_types(vocab.AXES_WITH_FULL["full"])
_PATHS = f""", pb as (select src, dst, edge_type from edges where {_FULL} union select dst, src, edge_type from edges where {_FULL}),
p0 as (select distinct example_id node_id, 0 hop, '' path from pred where fold = 'train'),
p1 as (select * from p0 union all (select dst, 1, min(edge_type) from pb join p0 on src = node_id where dst not in (select node_id from p0) group by dst)),
p2 as (select * from p1 union all (select dst, 2, min(path || '|' || edge_type) from pb join p1 on src = node_id and hop = 1 where dst not in (select node_id from p1) group by dst)),
wrong as (select * from pred where fold = 'test' and ((label = 1 and score < 0.5) or (label = 0 and score >= 0.5))),
atlas as (select w.example_id, w.source, coalesce(hop, -1) as hop, case when path is null then 'unreachable' when path = '' then '(seed)'
 when list_has_any(string_split(path, '|'), ['ligand_exact', 'ligand_parent_exact', 'ligand_fingerprint_exact']) then 'exact_ligand' when list_contains(string_split(path, '|'), 'ligand_similar') then 'similar_ligand'
 when list_contains(string_split(path, '|'), 'ligand_scaffold') then 'scaffold' when list_contains(string_split(path, '|'), 'example_from_publication') then 'publication'
 when list_contains(string_split(path, '|'), 'example_from_assay') then 'assay' when list_contains(string_split(path, '|'), 'protein_in_cluster') then 'protein_cluster' else split_part(path, '|', 1) end as category
 from wrong w left join p2 on p2.node_id = w.example_id)"""


def _atlas(spark, sf, max_hop: int = 2):
    e = graph.edges_of_types(kg.edges(spark, sf), vocab.AXES_WITH_FULL["full"])
    return audits.path_atlas(kg.predictions(spark, sf), e, 0.5, max_hop)


@query(kg.sql(_PATHS + " select * from atlas"))
def path_atlas(spark, sf):
    return _atlas(spark, sf)


@query(kg.sql(_PATHS + ", c as (select source, category, count(*) n from atlas group by 1, 2), k as (select *, row_number() over (partition by source order by n desc, category) place from c) select source, category, n, place::integer as place, place <= 3 as is_top from k"))
def path_atlas_counts(spark, sf):
    return audits.path_atlas_counts(_atlas(spark, sf))


@query()
def path_atlas_full(spark, sf):
    return _atlas(spark, sf, 4)


@query()
def path_atlas_counts_full(spark, sf):
    return audits.path_atlas_counts(_atlas(spark, sf, 4))


def _leak_sql(axes: dict[str, list[str]]) -> str:
    views, rows = "", []
    for i, (a, ts) in enumerate(axes.items()):
        views += kg.sql_bfs(f"x{i}_", _TRAIN, kg.sql_types(ts), 2)
        for k in (1, 2):
            rows.append(
                f"select '{a}' as axis, {k} as k, (select count(*) from folds where fold = 'test') as n_test, (select count(*) from folds where fold = 'test' and node_id in (select node_id from x{i}_ where hop between 1 and {k})) as n_leak"
            )
    return kg.sql(views + " select *, n_leak * 100 / n_test::double as pct_leak from (" + " union all ".join(rows) + ")")


@query(_leak_sql(vocab.AXES_WITH_FULL))
def residual_leak(spark, sf):
    f = kg.folds(spark, sf)
    return graph.residual_leak(kg.edges(spark, sf), f.where("fold = 'train'"), f.where("fold = 'test'"), vocab.AXES_WITH_FULL, 2)


@query("select axis, max(case when k = 1 then n_leak end) as k1, max(case when k = 2 then n_leak end) as k2 from (" + _leak_sql(vocab.AXES) + ") group by 1")
def residual_leak_pivot(spark, sf):
    f = kg.folds(spark, sf)
    r = graph.residual_leak(kg.edges(spark, sf), f.where("fold = 'train'"), f.where("fold = 'test'"), vocab.AXES, 2)
    return r.groupBy("axis").pivot("k", [1, 2]).agg(F.max("n_leak")).withColumnsRenamed({"1": "k1", "2": "k2"})


# -- splits ----------------------------------------------------------------------------------------------------------
def _ctx(spark, sf, **kw) -> splits.SplitContext:
    return splits.SplitContext(kg.examples(spark, sf).where("label in (0, 1)"), kg.edges(spark, sf), **kw)


_EX = ", ex as (select node_id, label from examples where label in (0, 1))"


def _strat_sql(strata: str, source: str = "ex", val: float = 0.0) -> str:
    return f"""select node_id, case when rn <= round_even(n * 0.15, 0) then 'test' when rn <= round_even(n * 0.15, 0) + round_even(n * {val}, 0) then 'val' else 'train' end as fold, false as leak_mask
from (select node_id, row_number() over (partition by {strata} order by md5('42|' || node_id), node_id) rn, count(*) over (partition by {strata}) n from {source})"""


@query(kg.sql(_EX + " " + _strat_sql("label")))
def split_random(spark, sf):
    return splits.build_split("random", _ctx(spark, sf))


@query(kg.sql(_EX + " " + _strat_sql("label", val=0.1)))
def split_random_val(spark, sf):
    return splits.build_split("random", _ctx(spark, sf, val=0.1))


@query(
    kg.sql(
        _EX
        + ", tg as (select src node_id, min(dst) t from edges where edge_type = 'example_has_protein' group by 1), et as (select ex.node_id, label, coalesce(t, '_no_target') t from ex left join tg using (node_id)) "
        + _strat_sql("t, label", "et")
    )
)
def split_per_target(spark, sf):
    return splits.build_split("random_per_target", _ctx(spark, sf))


def _group_sql(groups: str, least: int) -> str:
    return kg.sql(
        _EX
        + f""", gr as ({groups}), gs as (select grp, row_number() over (order by md5('42|' || grp), grp) rn, count(*) over () n from (select distinct grp from gr))
select ex.node_id, case when rn <= greatest(round_even(n * 0.15, 0), {least}) then 'test' else 'train' end as fold, false as leak_mask from ex left join gr using (node_id) left join gs using (grp)"""
    )


@query(_group_sql("select h.src node_id, min(s.dst) grp from edges h join edges s on s.src = h.dst where h.edge_type = 'example_has_ligand' and s.edge_type = 'ligand_scaffold' group by 1", 0))
def split_scaffold(spark, sf):
    return splits.build_split("scaffold", _ctx(spark, sf))


def _cluster_query(res: str):
    def f(spark, sf):
        return splits.build_split("protein_cluster", _ctx(spark, sf), identity=res)

    f.__name__ = f"split_cluster{res}"
    return query(
        _group_sql(f"select h.src node_id, min(s.dst) grp from edges h join edges s on s.src = h.dst where h.edge_type = 'example_has_protein' and s.edge_type = 'protein_in_cluster' and contains(s.dst, '::{res}::') group by 1", 1)
    )(f)


split_cluster30, split_cluster90 = _cluster_query("30"), _cluster_query("90")


def _flip_sql(types: list[str], hops: int, passes: int) -> str:
    body = _EX + ", f0 as (select node_id, label, fold from (select b.node_id, ex.label, b.fold from (" + _strat_sql("label") + ") b join ex using (node_id)))"
    for k in range(1, passes + 1):
        body += kg.sql_bfs(f"w{k}_", f"select node_id from f{k - 1} where fold = 'train'", kg.sql_types(types), hops)
        body += f", f{k} as (select node_id, label, case when fold = 'test' and node_id in (select node_id from w{k}_ where hop > 0) then 'train' else fold end fold from f{k - 1})"
    return kg.sql(body + f" select node_id, fold, false as leak_mask from f{passes}")


_STRUCT = sorted(set(vocab.AXES["ligand"] + vocab.AXES["scaffold"]))


@query(_flip_sql(_STRUCT, 2, 3))
def split_kdisjoint_structural(spark, sf):
    return splits.build_split("kg_kdisjoint", _ctx(spark, sf), K=2, axes=("ligand", "scaffold"))


@query(_flip_sql(vocab.AXES["publication"], 2, 3))
def split_kdisjoint_publication(spark, sf):
    return splits.build_split("kg_kdisjoint", _ctx(spark, sf), K=2, axes=("publication",))


@query(_flip_sql(vocab.AXES["ligand"], 2, 5))
def split_maxmin3(spark, sf):
    return splits.build_split("kg_maxmin", _ctx(spark, sf), T=3, axes=("ligand",))


@query(_flip_sql(_STRUCT, 2, 1))
def split_plinder(spark, sf):
    return splits.build_split("plinder_style", _ctx(spark, sf))


def _similar_sql(passes: int, actives: bool) -> str:
    act = " and label = 1" if actives else ""
    body = _EX + ", f0 as (select b.node_id, ex.label, b.fold from (" + _strat_sql("label") + ") b join ex using (node_id)), hl as (select src, dst from edges where edge_type = 'example_has_ligand')"
    for k in range(1, passes + 1):
        body += f""", f{k} as (select node_id, label, case when fold = 'test'{act} and node_id in (select h.src from hl h join edges s on s.dst = h.dst where s.edge_type = 'ligand_similar'
 and s.src in (select t.dst from hl t join f{k - 1} g on g.node_id = t.src where g.fold = 'train'{act})) then 'train' else fold end fold from f{k - 1})"""
    return kg.sql(body + f" select node_id, fold, false as leak_mask from f{passes}")


@query(_similar_sql(3, False))
def split_similarity_flip(spark, sf):
    return splits.build_split("tanimoto_maxmin", _ctx(spark, sf))


@query(_similar_sql(5, True))
def split_ave(spark, sf):
    return splits.build_split("ave_wallach", _ctx(spark, sf))


def _budget_sql() -> str:
    body = _EX + ", f0 as (select b.node_id, ex.label, b.fold from (" + _strat_sql("label") + ") b join ex using (node_id))"
    for k, (axis, share) in enumerate((("ligand", 0.05), ("scaffold", 0.05), ("publication", 0.05), ("assay", 0.05), ("protein", 0.5)), 1):
        body += kg.sql_bfs(f"b{k}_", f"select node_id from f{k - 1} where fold = 'train'", kg.sql_types(AXES[axis]), 2)
        body += f""", n{k} as (select r.node_id, row_number() over (order by hop, r.node_id) rn, count(*) over () n from b{k}_ r join f{k - 1} f on f.node_id = r.node_id where f.fold = 'test' and hop > 0),
f{k} as (select node_id, label, case when node_id in (select node_id from n{k} where rn <= n - floor({share} * (select count(*) from f{k - 1} where fold = 'test'))) then 'train' else fold end fold from f{k - 1})"""
    return kg.sql(body + " select node_id, fold, false as leak_mask from f5")


@query(_budget_sql())
def split_axis_budget(spark, sf):
    return splits.build_split("kg_axis_budget", _ctx(spark, sf))


@query(kg.sql(_EX + " select node_id, fold, true as leak_mask from (" + _strat_sql("label") + ")"))
def split_datasail(spark, sf):
    return splits.build_split("datasail", _ctx(spark, sf))


@query(
    _group_sql(
        f"""select h.src node_id, coalesce(min(c.coarse), min(s.dst)) grp from edges h join (select src, min(dst) dst from (select x.src, y.dst from edges x join edges y on y.src = x.dst where x.edge_type = 'example_has_ligand' and y.edge_type = 'ligand_scaffold') group by 1) s on s.src = h.src
 left join (select node_id, md5({_GEN.format("coalesce(label, '')")}) coarse from nodes where node_type = 'Scaffold') c on c.node_id = s.dst where h.edge_type = 'example_has_ligand' group by 1""",
        0,
    )
)
def split_scaffold_generic(spark, sf):
    n = kg.nodes(spark, sf).where("node_type = 'Scaffold'")
    return splits.build_split("scaffold_generic", _ctx(spark, sf), coarse=n.select(F.col("node_id").alias("grp"), F.md5(chem.generic_scaffold(F.coalesce("label", F.lit("")))).alias("coarse")))


@query(
    "select n_train, n_val, n_test, n_test_active, n_test_decoy, pct_active_train, pct_active_test, n_unique_targets_test, n_test >= 500 and n_test_active >= 10 and n_test_decoy >= 10 as feasible, l.* exclude(one) from ("
    + kg.sql(
        _EX
        + ", s as (select b.node_id, ex.label, b.fold from ("
        + _strat_sql("label")
        + """) b join ex using (node_id))
select count(*) filter (fold = 'train') n_train, count(*) filter (fold = 'val') n_val, count(*) filter (fold = 'test') n_test, count(*) filter (fold = 'test' and label = 1) n_test_active,
count(*) filter (fold = 'test' and label = 0) n_test_decoy, avg(case when fold = 'train' then label end) * 100 pct_active_train, avg(case when fold = 'test' then label end) * 100 pct_active_test,
(select count(distinct dst) from edges where edge_type = 'example_has_protein' and src in (select node_id from s where fold = 'test')) n_unique_targets_test from s) a,
("""
    )
    + kg.sql(
        _EX
        + ", s as (select b.node_id, ex.label, b.fold from ("
        + _strat_sql("label")
        + ") b join ex using (node_id))"
        + "".join(kg.sql_bfs(f"x{i}_", "select node_id from s where fold = 'train'", kg.sql_types(ts), 2) for i, ts in enumerate(vocab.AXES.values()))
        + " select 1 as one, "
        + ", ".join(f"(select count(*) from s where fold = 'test' and node_id in (select node_id from x{i}_ where hop > 0)) * 100 / (select count(*) from s where fold = 'test')::double as pct_leak_{a}" for i, a in enumerate(vocab.AXES))
    )
    + ") l"
)
def split_audit(spark, sf):
    ctx = _ctx(spark, sf)
    return splits.audit_split(splits.build_split("random", ctx), ctx.examples, ctx.edges)


# -- audits ----------------------------------------------------------------------------------------------------------
def _shared_sql(kind: str, name: str) -> str:
    return f""", {name}r as (select distinct src, dst from edges where edge_type = '{kind}'), {name}n as (select dst, count(*) n from {name}r where src in (select example_id from pred where fold = 'train') group by 1),
{name} as (select src example_id, sum(n) n from {name}r join {name}n using (dst) group by 1)"""


_TAGS = (
    _shared_sql("example_from_publication", "pu")
    + _shared_sql("example_from_assay", "asy")
    + """, tags as (select p.example_id, source, label, fold, score, coalesce(pu.n, 0)::bigint n_pub, coalesce(asy.n, 0)::bigint n_assay, coalesce(pu.n, 0) > 0 share_pub, coalesce(asy.n, 0) > 0 share_assay
 from pred p left join pu using (example_id) left join asy using (example_id) where fold = 'test')"""
)


def _tags(spark, sf):
    return audits.shared_provenance_tags(kg.predictions(spark, sf), kg.edges(spark, sf))


@query(kg.sql(_TAGS + " select * from tags"))
def shared_provenance_tags(spark, sf):
    return _tags(spark, sf)


@query(
    kg.sql(
        _TAGS
        + f""", a as (select * from {kg.sql_auroc('tags', 'source, share_pub')}) select x.source, x.auroc - y.auroc as delta from a x join a y on x.source = y.source and x.share_pub and not y.share_pub"""
    )
)
def delta_auroc(spark, sf):
    a = stats.auroc(_tags(spark, sf), ["source", "share_pub"])
    on, off = a.where("share_pub").select("source", F.col("auroc").alias("x")), a.where("not share_pub").select("source", F.col("auroc").alias("y"))
    return on.join(off, "source").select("source", (F.col("x") - F.col("y")).alias("delta"))


def _delta_test(spark, sf, reps: int = stats.DELTA_REPS):
    d = audits.provenance_delta(_tags(spark, sf), reps)
    return d.withColumns({c: F.round(c, 9) for c in ("delta", "lower", "upper", "p")})


@query()
def delta_auroc_test(spark, sf):
    return _delta_test(spark, sf, 50)


@query()
def delta_auroc_test_full(spark, sf):
    return _delta_test(spark, sf)


_CROSS = f""", cb as (select src, dst from edges where {_LIGAND} union select dst, src from edges where {_LIGAND}), c0 as (select node_id, source tag, 0 hop from examples where source is not null),
c1 as (select * from c0 union all (select dst, tag, 1 from cb join c0 on src = node_id where not exists (select 1 from c0 z where z.node_id = dst and z.tag = c0.tag) group by dst, tag)),
c2 as (select * from c1 union all (select dst, tag, 2 from cb join c1 on src = node_id and hop = 1 where not exists (select 1 from c1 z where z.node_id = dst and z.tag = c1.tag) group by dst, tag)),
sz as (select source, count(*) n_test from examples where source is not null group by 1),
mx as (select a.source train_source, b.source test_source, k, b.n_test, (select count(*) from c2 join examples e using (node_id) where c2.tag = a.source and e.source = b.source and hop <= k) n_reached
 from sz a join sz b on a.source <> b.source, (values (1), (2)) v(k))"""


def _cross(spark, sf, max_hop: int = 2):
    return audits.cross_corpus_matrix(kg.examples(spark, sf), _axis(spark, sf), max_hop)


@query(kg.sql(_CROSS + " select * from mx"))
def cross_corpus_matrix(spark, sf):
    return _cross(spark, sf)


@query(kg.sql(_CROSS + " select train_source, " + ", ".join(f"max(case when test_source = '{s}' then round(n_reached * 100 / n_test, 6) end) as {s}" for s in ("chembl", "bindingdb", "dude")) + " from mx where k = 2 group by 1"))
def cross_corpus_pivot(spark, sf):
    return audits.cross_corpus_pivot(_cross(spark, sf), 2, ["chembl", "bindingdb", "dude"])


@query()
def cross_corpus_matrix_full(spark, sf):
    return _cross(spark, sf, 3)


@query()
def cross_corpus_pivot_full(spark, sf):
    return audits.cross_corpus_pivots(_cross(spark, sf, 3))


def _horizon_sql() -> str:
    views, rows = "", []
    for i, (a, ts) in enumerate(vocab.HORIZON_AXES.items()):
        views += kg.sql_bfs(f"h{i}_", "select example_id node_id from pred where fold = 'train'", kg.sql_types(ts), 3)
        views += f", t{i}_ as (select p.*, coalesce(h.hop, 99) hop from pred p left join h{i}_ h on h.node_id = p.example_id where fold = 'test')"
        rows.append(f"select '{a}' as axis, source, hop, n_pos + n_neg as n, auroc from {kg.sql_auroc(f't{i}_', 'source, hop')} where n_pos + n_neg >= 5")
    return kg.sql(views + " " + " union all ".join(rows))


def _horizon(spark, sf, max_hop: int):
    e = kg.edges(spark, sf)
    return audits.horizon_curve(kg.predictions(spark, sf), {a: graph.edges_of_types(e, ts) for a, ts in vocab.HORIZON_AXES.items()}, max_hop)


@query(_horizon_sql())
def horizon_curve(spark, sf):
    return _horizon(spark, sf, 3)


@query()
def horizon_curve_full(spark, sf):
    return _horizon(spark, sf, 5)


_HUB = ["example_has_protein", "example_from_publication", "example_from_assay"]


@query(
    kg.sql(
        _DEG
        + kg.sql_bfs("r", "select node_id from deg where d > 50 and node_id in (select node_id from nodes)", kg.sql_types(_HUB), 1)
        + f", t as (select *, example_id in (select node_id from r) near_hub from pred where fold = 'test') select source, near_hub, n_pos + n_neg as n, auroc from {kg.sql_auroc('t', 'source, near_hub')}"
    )
)
def hub_partition(spark, sf):
    n, e = kg.nodes(spark, sf), kg.edges(spark, sf)
    return audits.hub_partition(kg.predictions(spark, sf), graph.flag_hubs(n, e, 50), graph.edges_of_types(e, _HUB), 1)


@query()
def hub_partition_full(spark, sf):
    n, e = kg.nodes(spark, sf), kg.edges(spark, sf)
    return audits.hub_partition(kg.predictions(spark, sf), graph.flag_hubs(n, e, vocab.HUB_DEGREE), graph.edges_of_types(e, _HUB), 2)


def _labelled(spark, sf):
    e = kg.edges(spark, sf)
    lig = e.where("edge_type = 'example_has_ligand'").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("lig"))
    prot = e.where("edge_type = 'example_has_protein'").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("prot"))
    x = kg.examples(spark, sf).where("label in (0, 1)").join(lig, "node_id").join(prot, "node_id")
    return x.select(F.col("node_id").alias("example_id"), "source", "lig", F.col("prot").alias("target"), "label")


_LAB = """, lb as (select x.node_id example_id, source, label, (select min(dst) from edges where src = x.node_id and edge_type = 'example_has_ligand') lig,
 (select min(dst) from edges where src = x.node_id and edge_type = 'example_has_protein') target from examples x where label in (0, 1)),
lab as (select * from lb where lig is not null and target is not null),
dr as (select n.example_id, n.source, n.lig, n.target, count(distinct p.target) n_other, list_sort(list(distinct p.target))[1:3] other_sample from lab n join lab p on p.lig = n.lig and p.target <> n.target
 where n.label = 0 and p.label = 1 group by 1, 2, 3, 4)"""


@query(kg.sql(_LAB + " select * from dr"))
def decoy_quality_rows(spark, sf):
    return audits.dirty_negatives(_labelled(spark, sf))


@query(kg.sql(_LAB + " select source, count(distinct example_id) as n_negatives, count(distinct case when example_id in (select example_id from dr) then example_id end) as n_dirty, round(count(distinct case when example_id in (select example_id from dr) then example_id end) * 100 / count(distinct example_id), 2) as pct_dirty from lab where label = 0 group by 1"))
def decoy_quality_summary(spark, sf):
    x = _labelled(spark, sf)
    return audits.dirty_negative_summary(x, audits.dirty_negatives(x))


@query(
    kg.sql(
        kg.sql_bfs("r", "select example_id node_id from pred where fold = 'train'", _LIGAND, 2)
        + f""", t0 as (select *, case when example_id in (select node_id from r) then 'leak' else 'clean' end part from pred where fold = 'test'), t as (select * from t0 union all select * replace ('all' as part) from t0)
select source, part, n_pos + n_neg as n, auroc from {kg.sql_auroc('t', 'source, part')} where n_pos + n_neg >= 5"""
    )
)
def retro_decomposition(spark, sf):
    return audits.retrospective(kg.predictions(spark, sf), _axis(spark, sf))


@query(kg.sql(f" select source, fold, auroc, n_pos, n_neg from {kg.sql_auroc('pred', 'source, fold')}"))
def auroc_by_group(spark, sf):
    return stats.auroc(kg.predictions(spark, sf), ["source", "fold"])


def _pw(seed: int = 42) -> str:
    h = kg.sql_hash(f"'{seed}|' || rep || '|' || example_id")
    return "case " + " ".join(f"when {h} < {s} then {k}" for k, s in enumerate(stats.POISSON_STEPS)) + f" else {len(stats.POISSON_STEPS)} end"


def _boot_sql(name: str, source: str, keys: str, reps: int, seed: int = 42, where: str = "fold = 'test'") -> str:
    """View {name}: keys, rep, a."""
    return f""", {name}w as (select *, {_pw(seed)} w from {source}, range(1, {reps + 1}) g(rep) where {where}),
{name}s as (select {keys}, rep, score, sum(case when label = 1 then w else 0 end) p, sum(case when label = 0 then w else 0 end) n from {name}w where w > 0 group by {keys}, rep, score),
{name}c as (select *, coalesce(sum(n) over (partition by {keys}, rep order by score rows between unbounded preceding and 1 preceding), 0) below from {name}s),
{name} as (select {keys}, rep, sum(p * (2 * below + n))::double / (2 * sum(p) * sum(n)) a from {name}c group by {keys}, rep having sum(p) > 0 and sum(n) > 0)"""


def _interval(spark, sf, reps: int = stats.INTERVAL_REPS):
    b = stats.bootstrap_interval(kg.predictions(spark, sf).where("fold = 'test'"), ["source"], "example_id", reps)
    return b.withColumns({"lower": F.round("lower", 9), "upper": F.round("upper", 9)})


def _baselines(spark, sf, reps: int = stats.INTERVAL_REPS):
    p = kg.predictions(spark, sf)
    m = p.withColumn("model", F.lit("blend")).unionByName(p.withColumn("score", F.round(stats.unit_hash(F.col("example_id")) % 1000 / 1000.0, 6)).withColumn("model", F.lit("noise")))
    return audits.compare_models(m, reps).withColumns({"lower": F.round("lower", 9), "upper": F.round("upper", 9)})


@query(
    kg.sql(
        _boot_sql("bb", "pred", "source", 40)
        + f""", qq as (select source, quantile_cont(a, 0.025) lower, quantile_cont(a, 0.975) upper from bb group by 1)
select p.source, p.auroc as point, round(lower, 9) as lower, round(upper, 9) as upper, n_pos, n_neg from {kg.sql_auroc("pred", "source", "fold = 'test'")} p left join qq using (source)"""
    )
)
def bootstrap_ci(spark, sf):
    return _interval(spark, sf, 40)


@query()
def bootstrap_ci_full(spark, sf):
    return _interval(spark, sf)


@query(
    kg.sql(
        f""", bm as (select *, 'blend' model from pred union all select * replace (round({kg.sql_hash('example_id')} % 1000 / 1000.0, 6) as score), 'noise' from pred)"""
        + _boot_sql("bb", "bm", "model, source", 20)
        + f""", qq as (select model, source, quantile_cont(a, 0.025) lower, quantile_cont(a, 0.975) upper from bb group by 1, 2)
select model, p.source, p.auroc as point, round(lower, 9) as lower, round(upper, 9) as upper, n_pos, n_neg from {kg.sql_auroc("bm", "model, source", "fold = 'test'")} p left join qq using (model, source)"""
    )
)
def baseline_compare(spark, sf):
    return _baselines(spark, sf, 20)


@query()
def baseline_compare_full(spark, sf):
    return _baselines(spark, sf)


ORACLE["delta_auroc_test"] = kg.sql(
    _TAGS
    + _boot_sql("b1", "tags", "source", 50, 42, "share_pub")
    + _boot_sql("b0", "tags", "source", 50, 43, "not share_pub")
    + f""", dd as (select b1.source, b1.a - b0.a d from b1 join b0 using (source, rep)),
qq as (select source, quantile_cont(d, 0.025) lower, quantile_cont(d, 0.975) upper, least(avg((d <= 0)::integer), avg((d >= 0)::integer)) tail from dd group by 1),
aa as (select * from {kg.sql_auroc('tags', 'source, share_pub')})
select x.source, round(x.auroc - y.auroc, 9) as delta, round(lower, 9) as lower, round(upper, 9) as upper, round(least(1.0, 2 * tail), 9) as p from aa x join aa y on y.source = x.source and x.share_pub and not y.share_pub left join qq on qq.source = x.source"""
)


def _cnn_inputs(spark, sf):
    return kg.examples(spark, sf).where("label in (0, 1)").join(kg.folds(spark, sf), "node_id").select("node_id", "label", "fold")


@query(
    kg.sql(
        f""", x as (select e.node_id, e.label, f.fold from examples e join folds f using (node_id) where e.label in (0, 1)), eb as (select src, dst from edges where {_LIGAND} union select dst, src from edges where {_LIGAND}),
o as (select n, avg(l) s from (select distinct r.node_id n, t.label l from x r join eb on eb.src = r.node_id join x t on t.node_id = eb.dst where r.fold <> 'train' and t.fold = 'train') group by 1),
md as (select dst mid, label from eb join x on x.node_id = src where fold = 'train' group by 1, 2),
w as (select n, sum(label)::double / count(*) s from (select distinct r.node_id n, eb.dst mid from x r join eb on eb.src = r.node_id where r.fold <> 'train') join md using (mid) group by 1)
select node_id, label, fold, case when fold = 'train' then label::double else coalesce(o.s, w.s, 0.5) end as score from x left join o on o.n = node_id left join w on w.n = node_id"""
    )
)
def cnn_score(spark, sf):
    return audits.nearest_label_scores(_cnn_inputs(spark, sf), _axis(spark, sf))


def _texts(spark, sf):
    s = table(spark, sf, "side_table")
    t = s.select(F.concat(F.lit("ex:"), clean_id(s["example_id"])).alias("node_id"), strip(s["smiles_canonical"]).alias("text")).groupBy("node_id").agg(F.min("text").alias("text"))
    return _cnn_inputs(spark, sf).join(t, "node_id")


@query()
def rf_score(spark, sf):
    return models.score(_texts(spark, sf), "rf", cap=15_000)


@query()
def lr_score(spark, sf):
    return models.score(_texts(spark, sf), "lr", cap=50_000)


# -- similarity ------------------------------------------------------------------------------------------------------
def _fingerprints(spark, sf):
    n = kg.nodes(spark, sf).where("node_type = 'Ligand' and label is not null")
    return n.select(F.col("node_id").alias("key"), similarity.shingle_bits(F.col("label"), 6, 1 << 20).alias("bits"))


_FP = """, fp as (select node_id k, list_sort(list_distinct(list_transform(range(1, length(label) - 4), lambda i: (cast('0x' || substr(md5(substr(label, i, 6)), 1, 8) as bigint) % 1048576)::integer))) b from nodes
 where node_type = 'Ligand' and length(label) >= 6), cl as (select b, min(k) k from fp group by 1), u as (select k, len(b) n, unnest(b) g from cl),
pr as (select x.k a, y.k b, count(*) shared, any_value(x.n + y.n) - count(*) joint from u x join u y on x.g = y.g and x.k < y.k group by 1, 2)"""


@query(kg.sql(_FP + " select a, b, shared::integer as shared, joint::integer as joint from pr where shared * 10 >= joint * 7"))
def similar_pairs(spark, sf):
    return similarity.fingerprint_pairs(_fingerprints(spark, sf), "key", "bits", 0.7)


@query(kg.sql(_FP + " select fp.k as key, cl.k as class_key from fp join cl using (b)"))
def fingerprint_exact_classes(spark, sf):
    return similarity.fingerprint_classes(_fingerprints(spark, sf), "key", "bits")


@query(kg.sql(_FP + " select t::double as threshold, count(*) filter (shared * 100 >= joint * round(t * 100)) as n_pairs from pr, (values (0.7), (0.8), (0.9)) v(t) group by t"))
def pair_counts_ge_t(spark, sf):
    return similarity.pair_counts(similarity.fingerprint_pairs(_fingerprints(spark, sf), "key", "bits", 0.7), [0.7, 0.8, 0.9])


@query(kg.sql(_FP + " select edge_type, count(*) as n from (select case when shared = joint then 'ligand_fingerprint_exact' else 'ligand_similar' end edge_type from pr where shared * 20 >= joint * 17) group by 1"))
def similarity_edge_counts(spark, sf):
    p = similarity.fingerprint_pairs(_fingerprints(spark, sf), "key", "bits", 0.85)
    return similarity.similarity_edges(p, 0.85).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


_EMB = "(select vec_id k, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0) b from embeddings)"


@query(f"""with e as {_EMB}, q as (select * from e where k % 20 = 0), u as (select k, len(b) n, unnest(b) g from e), s as (select x.k a, y.k c, count(*) / (any_value(x.n + y.n) - count(*))::double j
 from u x join u y on x.g = y.g and x.k <> y.k where x.k % 20 = 0 group by 1, 2) select q.k as key, case when len(q.b) = 0 then -1.0 else coalesce(max(j), 0.0) end as best from q left join s on s.a = q.k group by q.k, q.b""")
def max_similarity_to_set(spark, sf):
    """The queries are the vectors whose id is divisible by 20; each is measured against all others."""
    e = table(spark, sf, "embeddings")
    bits = F.filter(F.transform("embedding", lambda v, i: F.when(v > 0, i)), lambda x: x.isNotNull())
    x = e.select(F.col("vec_id").alias("key"), bits.alias("bits"))
    return similarity.max_similarity(x.where("key % 20 = 0"), x, others_only=True)


# -- side table, trainsets, hydration --------------------------------------------------------------------------------
@query(f"select {kg.sql_id('example_id')} as example_id, min(trim(source, {kg.BLANKS})) as source, count(*) as n_rows from side_table where {kg.sql_id('example_id')} is not null group by 1")
def side_table_rows(spark, sf):
    s = table(spark, sf, "side_table")
    return s.select(clean_id(s["example_id"]).alias("example_id"), strip(s["source"]).alias("source")).where("example_id is not null").groupBy("example_id").agg(F.min("source").alias("source"), F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""select 'repeated example_id' as problem, count(*) as n from (select example_id from side_table where example_id is not null group by 1 having count(*) > 1) union all
select 'null example_id', count(*) from side_table where example_id is null union all
select 'unknown source', count(*) from side_table where coalesce(lower(trim(source, {kg.BLANKS})) not in ({', '.join(f"'{s}'" for s in vocab.SIDE_SOURCES)}), true)"""
)
def side_table_validation(spark, sf):
    s = table(spark, sf, "side_table")
    return build.validate_side_table(s)


@query(f"select distinct {kg.sql_id('example_id')} as key from trainset_manifest where {kg.sql_id('example_id')} is not null and {kg.sql_id('example_id')} not in (select {kg.sql_id('example_id')} from side_table where {kg.sql_id('example_id')} is not null)")
def hydrate_missing(spark, sf):
    return build.hydrate(table(spark, sf, "trainset_manifest"), table(spark, sf, "side_table"))[1]


@query(
    f"""with w as (select distinct {kg.sql_id('example_id')} k from trainset_manifest where {kg.sql_id('example_id')} is not null), h as (select distinct {kg.sql_id('example_id')} k from side_table)
select count(h.k) as n_found, count(*) - count(h.k) as n_missing, count(h.k)::double / count(*) as coverage from w left join h using (k)"""
)
def hydrate_coverage(spark, sf):
    return build.coverage(*build.hydrate(table(spark, sf, "trainset_manifest"), table(spark, sf, "side_table")))


_TS = f", tm as (select distinct model, 'ex:' || {kg.sql_id('example_id')} node_id from trainset_manifest)"


@query(kg.sql(_TS + " select node_id as src, 'trainset:' || model as dst, 'example_in_trainset' as edge_type from tm where node_id in (select node_id from examples)"))
def trainset_ingest(spark, sf):
    return build.trainset(table(spark, sf, "trainset_manifest"), kg.examples(spark, sf))[1]


@query(kg.sql(_TS + " select model, node_id from tm where node_id is null or node_id not in (select node_id from examples)"))
def trainset_unresolved(spark, sf):
    return build.trainset(table(spark, sf, "trainset_manifest"), kg.examples(spark, sf))[2]


@query(kg.sql(_TS + " select edge_type, count(*) as n from (select src, dst, edge_type from edges union select node_id, 'trainset:' || model, 'example_in_trainset' from tm where node_id in (select node_id from examples)) group by 1"))
def trainset_merge(spark, sf):
    n, e = kg.nodes(spark, sf), kg.edges(spark, sf)
    tn, te, _ = build.trainset(table(spark, sf, "trainset_manifest"), kg.examples(spark, sf))
    once = build.merge_trainset(n, e, tn, te)
    return build.merge_trainset(*once, tn, te)[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1")
def upsert_latest(spark, sf):
    return build.upsert_latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), l_orderkey, l_linenumber limit 100")
def sample_n(spark, sf):
    li = table(spark, sf, "lineitem")
    ident = F.concat_ws("|", F.lit("7"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.orderBy(F.md5(ident), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("select l_orderkey, min(l_partkey) as first_part, min(l_suppkey) as first_supp from lineitem group by 1")
def bounded_first(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"), F.min("l_suppkey").alias("first_supp"))


@query(f"select state, count(*) as n from (select case when {kg.sql_id('example_id')} is null then 'no_id' when {kg.sql_id('example_id')} in (select {kg.sql_id('example_id')} from side_table where {kg.sql_id('example_id')} is not null) then 'found' else 'missing' end state from trainset_manifest) group by 1")
def stream_request_states(spark, sf):
    import uuid

    got = tagger.run_once(spark, f"{sf}/trainset_manifest.parquet", table(spark, sf, "side_table"), uuid.uuid4().hex)
    return got.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_ACC_SQL = r"nullif(regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace(uniprot, '\s+', '', 'g')), '^[A-Z]+\|([^|]*)(\|.*)?$', '\1'), '^[A-Z][A-Z0-9_.]*:', ''), '[-.]\d+$', ''), '')"


@query(f"select {_ACC_SQL} as accession, count(*) as n from side_table where {_ACC_SQL} is not null group by 1")
def key_collection(spark, sf):
    s = table(spark, sf, "side_table")
    return s.select(accession(s["uniprot"]).alias("accession")).where("accession is not null").groupBy("accession").agg(F.count(F.lit(1)).alias("n"))


# -- further sources, joins and audits -------------------------------------------------------------------------------
_TABLES = ["canonical_nodes", "canonical_edges", "side_table", "split_result", "trainset_manifest", "activities", "documents", "eval_items"]


@query(" union all ".join(f"select '{t}' as table_name, (select count(*) from information_schema.columns where table_name = '{t}') as n_columns, (select count(*) from {t}) as n_rows" for t in _TABLES))
def catalog_counts(spark, sf):
    out = None
    for t in _TABLES:
        df = table(spark, sf, t)
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "n_rows")
        out = part if out is None else out.union(part)
    return out


@query("select distinct activity_id, molregno, standard_type, standard_value from activities where molregno in (select molregno from activities group by 1 having count(distinct assay_id) >= 2)")
def activities_for_keys(spark, sf):
    a = table(spark, sf, "activities")
    ids = a.groupBy("molregno").agg(F.countDistinct("assay_id").alias("n")).where("n >= 2")
    return readers.for_keys(a, ids, "molregno").select("activity_id", "molregno", "standard_type", "standard_value").distinct()


@query(
    kg.sql(
        f""", s as (select {_ACC_SQL} acc, min(target_sequence) seq from side_table where {_ACC_SQL} is not null and target_sequence is not null group by 1)
select p.node_id, c.dst as cluster, length(seq) as n_residues from nodes p join edges c on c.src = p.node_id and c.edge_type = 'protein_in_cluster' join s on p.node_id = 'protein:' || lower(acc) where p.node_type = 'Protein'"""
    )
)
def target_sequences(spark, sf):
    s = table(spark, sf, "side_table")
    seq = s.select(F.concat(F.lit("protein:"), F.lower(accession(s["uniprot"]))).alias("node_id"), "target_sequence").where("node_id is not null and target_sequence is not null").groupBy("node_id").agg(F.min("target_sequence").alias("seq"))
    c = kg.edges(spark, sf).where("edge_type = 'protein_in_cluster'").select(F.col("src").alias("node_id"), F.col("dst").alias("cluster"))
    return kg.nodes(spark, sf).where("node_type = 'Protein'").select("node_id").join(c, "node_id").join(seq, "node_id").select("node_id", "cluster", F.length("seq").alias("n_residues"))


@query("select assay_id, count(*) as n, max(standard_value) as top from (select distinct * from activities) group by 1 order by n desc, assay_id limit 20")
def top_assays(spark, sf):
    a = table(spark, sf, "activities").distinct()
    return a.groupBy("assay_id").agg(F.count(F.lit(1)).alias("n"), F.max("standard_value").alias("top")).orderBy(F.desc("n"), "assay_id").limit(20)


@query(
    rf"""with s as (select distinct trim(smiles_canonical, {kg.BLANKS}) t from side_table where trim(smiles_canonical, {kg.BLANKS}) <> ''),
p as (select t, string_split(t, '.') x from s), l as (select t, (list_sort(list_filter(x, lambda p: length(p) = list_max(list_transform(x, lambda q: length(q))))))[1] m from p)
select t as smiles, md5(t) as own_key, md5(regexp_replace(regexp_replace(m, '[@/\\]', '', 'g'), '\[\d*([A-Z][a-z]?|[a-z])(?:H\d*)?(?:[+-]\d*)?\]', '\1', 'g')) as parent_key from l"""
)
def parent_keys(spark, sf):
    s = _side(spark, sf).where("smi <> ''").select("smi").distinct()
    p = chem.TextFeatures()
    return s.select(F.col("smi").alias("smiles"), p.key(F.col("smi")).alias("own_key"), p.parent_key(F.col("smi")).alias("parent_key"))


@query(
    kg.sql(
        """, l as (select dst lig, list_sort(list(distinct source)) s from edges join examples on node_id = src where edge_type = 'example_has_ligand' and source is not null group by 1)
select lig, len(s) as n_sources, s[1] as first_source, s[1:2] as head, list_sort(list_filter(s, lambda x: x <> 'chembl')) as others from l"""
    )
)
def source_lists(spark, sf):
    e = kg.edges(spark, sf).where("edge_type = 'example_has_ligand'").select(F.col("src").alias("node_id"), F.col("dst").alias("lig"))
    l = e.join(kg.examples(spark, sf).where("source is not null"), "node_id").groupBy("lig").agg(F.sort_array(F.collect_set("source")).alias("s"))
    return l.select("lig", F.size("s").alias("n_sources"), F.element_at("s", 1).alias("first_source"), F.slice("s", 1, 2).alias("head"), F.array_except("s", F.array(F.lit("chembl"))).alias("others"))


@query(
    kg.sql(
        """, fl as (select src node_id, min(dst) lig from edges where edge_type = 'example_has_ligand' group by 1)
select f.node_id, f.fold, n.label as text from folds f join fl using (node_id) join nodes n on n.node_id = fl.lig where n.label is not null and trim(n.label) <> ''"""
    )
)
def split_hydration(spark, sf):
    first = kg.edges(spark, sf).where("edge_type = 'example_has_ligand'").groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("lig"))
    text = kg.nodes(spark, sf).select(F.col("node_id").alias("lig"), F.col("label").alias("text")).where("text is not null and trim(text) <> ''")
    return kg.folds(spark, sf).join(first, "node_id").join(text, "lig").select("node_id", "fold", "text")


@query(
    kg.sql(
        kg.sql_bfs("r", "select node_id from examples where source = 'chembl'", _LIGAND, 2)
        + f""", t0 as (select *, case when example_id in (select node_id from r) then 'leak' else 'clean' end part from pred where fold = 'test'), t as (select * from t0 union all select * replace ('all' as part) from t0)
select source, part, n_pos + n_neg as n, auroc from {kg.sql_auroc('t', 'source, part')} where n_pos + n_neg >= 5"""
    )
)
def retro_anchor_corpus(spark, sf):
    anchor = kg.examples(spark, sf).where("source = 'chembl'").select("node_id")
    return audits.retrospective(kg.predictions(spark, sf), _axis(spark, sf), 2, anchor)


_BOTH = ["protein_cluster", "random"]


def _all_folds(spark, sf):
    out = None
    for p in _BOTH:
        part = kg.folds(spark, sf, p).withColumn("protocol", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


_FOLDS2 = f", f2 as (select protocol, {kg.sql_id('node_id')} node_id, min({kg.sql_fold()}) fold from split_result where {kg.sql_fold()} is not null and {kg.sql_id('node_id')} is not null group by 1, 2)"


def _head_sql() -> str:
    views, rows = _FOLDS2, []
    for i, p in enumerate(_BOTH):
        for j, (a, ts) in enumerate(vocab.AXES.items()):
            views += kg.sql_bfs(f"z{i}{j}_", f"select node_id from f2 where protocol = '{p}' and fold = 'train'", kg.sql_types(ts), 2)
            rows.append(f"select '{p}' as protocol, '{a}' as axis, (select count(*) from f2 where protocol = '{p}' and fold = 'test') as n_test, (select count(*) from f2 where protocol = '{p}' and fold = 'test' and node_id in (select node_id from z{i}{j}_ where hop > 0)) as n_leak")
    return kg.sql(views + " select *, n_leak * 100 / n_test::double as pct_leak from (" + " union all ".join(rows) + ")")


@query(_head_sql())
def split_head_to_head(spark, sf):
    return audits.split_head_to_head(_all_folds(spark, sf), kg.edges(spark, sf), vocab.AXES)


def _scored_folds(spark, sf):
    e = kg.examples(spark, sf).where("label in (0, 1) and source is not null").join(_all_folds(spark, sf), "node_id")
    score = F.round((stats.unit_hash(F.col("node_id")) % 1000 + 400 * F.col("label")) / 1400.0, 6)
    return e.select(F.col("node_id").alias("example_id"), "source", "label", "fold", "protocol", score.alias("score"))


_TEST = "fold = 'test'"
_PRED2 = _FOLDS2 + f", p2 as (select e.node_id example_id, source, label, fold, protocol, round(({kg.sql_hash('e.node_id')} % 1000 + 400 * label) / 1400.0, 6) score from examples e join f2 using (node_id) where label in (0, 1) and source is not null), ra as (select * from {kg.sql_auroc('p2', 'protocol, source', _TEST)})"


@query(kg.sql(_PRED2 + " select a.protocol, a.source, a.auroc, a.n_pos, a.n_neg, a.auroc - b.auroc as delta from ra a left join ra b on b.source = a.source and b.protocol = 'random'"))
def auroc_all_splits(spark, sf):
    return audits.auroc_all_splits(_scored_folds(spark, sf))


@query(kg.sql(_PRED2 + " select source, protocol, auroc from (select *, row_number() over (partition by source order by auroc desc, protocol) rn from ra where not isnan(auroc)) where rn = 1"))
def split_winners(spark, sf):
    return audits.winners(audits.auroc_all_splits(_scored_folds(spark, sf)))


@query(kg.sql("select 'nodes.' || node_type as metric, count(*) as value from nodes group by 1 union all select 'edges.' || edge_type, count(*) from edges group by 1"))
def stats_table(spark, sf):
    return sinks.stats_table(kg.nodes(spark, sf), kg.edges(spark, sf))


@query(
    kg.sql(
        """, acc as (select node_id, case when regexp_matches(upper(regexp_extract(node_id, '^(?:tgt:.*|protein):([^:]+)$', 1)), '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$')
 then 'protein:' || lower(regexp_extract(node_id, '^(?:tgt:.*|protein):([^:]+)$', 1)) else node_id end nid from (select src node_id from edges union select dst from edges))
select s.nid as src, d.nid as dst, edge_type from edges e join acc s on s.node_id = e.src join acc d on d.node_id = e.dst where edge_type in ('example_has_protein', 'protein_in_cluster')"""
    )
)
def protein_edge_rewrite(spark, sf):
    e = kg.edges(spark, sf).where("edge_type in ('example_has_protein', 'protein_in_cluster')")
    return graph.rewrite_ids(kg.nodes(spark, sf), e, build.protein_node)[1].select("src", "dst", "edge_type")
