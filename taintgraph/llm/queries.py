"""Queries over the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph.functions.text import accession, clean_id, example_node, fold_name, inchi_block, reduced_smiles, strip
from taintgraph.llm import encoding, group_splits, groups, leakage, residue, set_similarity, split_overlap
from taintgraph.session import cut, table
from taintgraph.vocab import LIGAND_IDENTITY


def _p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """record: the id as it compares; name: its spelling in side_table, of several the smallest."""
    side = table(spark, sf, "side_table")
    lig = side.select(
        example_node(side["example_id"]).alias("record"), strip(side["source"]).alias("source"), inchi_block(side["inchikey"]).alias("ik"), reduced_smiles(side["smiles_canonical"]).alias("red")
    ).where("record is not null and (ik is not null or red is not null)")
    names = side.groupBy(example_node(side["example_id"]).alias("record")).agg(F.min(F.concat(F.lit("ex:"), strip(side["example_id"]))).alias("name")).where("record is not null")
    folds = _folds(spark, sf, "random").withColumn("side", F.when(F.col("fold") == "train", "train").otherwise("eval"))
    return lig.join(folds.join(names, "record"), "record").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    r = cut(_p2_records(spark, sf).select("record", "name", "side", "ik", "red").distinct(), "records")
    return split_overlap.record_pairs(r, split_overlap.overlaps(r))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = cut(_p2_records(spark, sf), "records")
    return split_overlap.overlap_counts(r, split_overlap.overlaps(r))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    side = table(spark, sf, "side_table")
    got = set_similarity.similar_pairs(side.select(strip(side["smiles_canonical"]).alias("s")), "s", 0.7, 6)
    a, b = F.concat(F.lit("lig:"), F.md5("ta")), F.concat(F.lit("lig:"), F.md5("tb"))
    return got.select(F.least(a, b).alias("node_id_a"), F.greatest(a, b).alias("node_id_b"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "canonical_edges").where(F.col("edge_type").isin(LIGAND_IDENTITY))
    return groups.group_pairs(e.select(clean_id(e["src"]).alias("a"), clean_id(e["dst"]).alias("b")))


def _p7_members(spark: SparkSession, sf: str) -> DataFrame:
    side, edges = table(spark, sf, "side_table"), table(spark, sf, "canonical_edges")
    prot = side.select(example_node(side["example_id"]).alias("record"), F.concat(F.lit("protein:"), accession(side["uniprot"])).alias("entity"))
    pub = edges.where("edge_type = 'example_from_publication'").select(clean_id(edges["src"]).alias("record"), clean_id(edges["dst"]).alias("entity"))
    return prot.union(pub)


def _folds(spark: SparkSession, sf: str, protocol: str) -> DataFrame:
    s = table(spark, sf, "split_result").where(F.col("protocol") == protocol)
    return s.select(clean_id(s["node_id"]).alias("record"), fold_name(s["fold"]).alias("fold")).where("record is not null and fold is not null").distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_splits.torn_entities(_p7_members(spark, sf), _folds(spark, sf, "protein_cluster"))


def p7_assignment(spark: SparkSession, sf: str) -> DataFrame:
    side = table(spark, sf, "side_table")
    records = side.select(example_node(side["example_id"]).alias("record"))
    return group_splits.grouped_split(_p7_members(spark, sf), records, {"train": 0.70, "val": 0.15, "test": 0.15})


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(table(spark, sf, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    ids = encoding.encode(docs, "doc_id", "text").withColumn("n", F.size("ids"))
    return ids.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum((F.col("n") == 0).cast("int")).alias("n_empty"), F.max("n").alias("longest"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per item: documents that leak it, by suite and split."""
    items = table(spark, sf, "eval_items")
    got = p9_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "suite", "split").join(got, "item_id", "left").select("item_id", "suite", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _p10(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return residue.residue(d.select("doc_id", strip(d["source"]).alias("host"), "text"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p10(spark, sf).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = _p10(spark, sf)
    return k.groupBy("slot", "filler", "error", "scripts").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p5_found, p7_found, p7_assignment, p8_ids, p8_counts, p9_found, p9_items, p10_found, p10_kinds)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_ID = f"nullif(lower(trim({{0}}, {_BLANKS})), '')"
_ACC = (
    r"nullif(regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace({0}, '\s+', '', 'g')), '^[A-Z]+\|([^|]*)(\|.*)?$', '\1'), '^[A-Z][A-Z0-9_.]*:', ''), '[-.]\d+$', ''), '')"
)

_RED = (
    rf"nullif(regexp_replace(regexp_replace((list_sort(list_filter(string_split(trim(smiles_canonical, {_BLANKS}), '.'), lambda p: length(p) = "
    rf"list_max(list_transform(string_split(trim(smiles_canonical, {_BLANKS}), '.'), lambda q: length(q))))))[1], '[@/\\\\]', '', 'g'), "
    r"'\[\d*([A-Z][a-z]?|[a-z])(?:H\d*)?(?:[+-]\d*)?\]', '\1', 'g'), '')"
)
_IK = r"substr(regexp_replace(upper(regexp_replace(inchikey, '\s+', '', 'g')), '^INCHIKEY=', ''), 1, 14)"

_P2 = f"""
with names as (select 'ex:' || {_ID.format('example_id')} r, min('ex:' || trim(example_id, {_BLANKS})) nm from side_table where {_ID.format('example_id')} is not null group by 1),
lig as (select distinct 'ex:' || {_ID.format('example_id')} r, trim(source, {_BLANKS}) source, case when length({_IK}) = 14 then {_IK} end ik, {_RED} red from side_table),
f as (select distinct {_ID.format('node_id')} r, case when lower(trim(fold, {_BLANKS})) like 'train%' then 'train' when lower(trim(fold, {_BLANKS})) like 'val%' then 'val'
  when lower(trim(fold, {_BLANKS})) like 'test%' then 'test' end fold from split_result where protocol = 'random'),
x as (select * from lig join f using (r) where fold is not null),
p as (select distinct t.r tr, e.r er, e.fold, e.source from x t join x e on t.fold = 'train' and e.fold <> 'train' and t.r <> e.r
  and (t.ik = e.ik or t.red = e.red or ((t.ik is null or e.ik is null) and abs(length(t.red) - length(e.red)) <= 2 and levenshtein(t.red, e.red) <= 2)))"""

_P9 = r"""
with w as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') l from documents where text is not null),
v as (select item_id, regexp_extract_all(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g')), '[\p{L}\p{N}]+') l from eval_items),
wd as (select doc_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i : i + 11], ' '))) g from w where len(l) >= 12),
wi as (select item_id, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i : i + 11], ' '))) g from v where len(l) >= 12),
hit as (select distinct doc_id, item_id from wd join wi using (g))"""

#: components by recursive union, then the same placement: heavy ones one by one, the others by cumulative weight
_P7_ASSIGNMENT = f"""
with recursive m as (
  select distinct * from (select 'ex:' || {_ID.format('example_id')} r, 'protein:' || {_ACC.format('uniprot')} e from side_table
  union all select {_ID.format('src')}, {_ID.format('dst')} from canonical_edges where edge_type = 'example_from_publication') where r is not null and e is not null),
p as (select distinct a.e a, b.e b from m a join m b on a.r = b.r),
reach as (select a v, a root from p union select p.b, reach.root from reach join p on p.a = reach.v where reach.root < p.b),
comp as (select v e, min(root) root from reach group by 1),
rec as (select distinct 'ex:' || {_ID.format('example_id')} r from side_table where {_ID.format('example_id')} is not null),
placed as (select rec.r, coalesce(min(c.root), 'record:' || rec.r) root from rec left join m on m.r = rec.r left join comp c on c.e = m.e group by rec.r),
w as (select root, count(*) weight from placed group by 1), t as (select sum(weight)::double total from w),
heavy as (select root, weight, row_number() over (order by weight desc, root) k from w, t where weight >= 0.001 * total),
greedy as (select 0::bigint k, null::varchar root, null::varchar fold, 0.7 * total a, 0.15 * total b, 0.15 * total c from t
  union all select h.k, h.root, case when a >= b and a >= c then 'train' when b >= c then 'val' else 'test' end,
   case when a >= b and a >= c then a - h.weight else a end, case when not (a >= b and a >= c) and b >= c then b - h.weight else b end,
   case when not (a >= b and a >= c) and b < c then c - h.weight else c end from greedy g join heavy h on h.k = g.k + 1),
need as (select greatest(a, 0) a, greatest(b, 0) b, greatest(a, 0) + greatest(b, 0) + greatest(c, 0) room from greedy order by k desc limit 1),
rest as (select total - coalesce((select sum(weight) from heavy), 0) rest from t),
upto as (select root, sum(weight) over (order by md5(root), root rows unbounded preceding) u from w where root not in (select root from heavy)),
fold as (select root, fold from greedy where root is not null
  union all select root, case when u <= a / room * rest + 0.5 then 'train' when u <= a / room * rest + b / room * rest + 0.5 then 'val' else 'test' end from upto, need, rest)
select placed.r as record, root, fold from placed join fold using (root)"""

ORACLE = {
    "p7_assignment": _P7_ASSIGNMENT,
    "p9_found": _P9 + " select doc_id, item_id from hit",
    "p9_items": _P9 + """ select i.item_id, i.suite, i.split, count(h.doc_id) as n_docs from eval_items i left join hit h on h.item_id = i.item_id group by 1, 2, 3""",
    "p2_found": _P2 + " select distinct least(a.nm, b.nm) as node_id_a, greatest(a.nm, b.nm) as node_id_b from p join names a on a.r = tr join names b on b.r = er",
    "p2_counts": _P2
    + """ select fold, source, count(distinct r) as n_records, count(distinct case when r in (select er from p) then r end) as n_overlapping
from x where fold <> 'train' and (ik is not null or red is not null) group by 1, 2""",
    "p5_found": f"""
with s as (select distinct trim(smiles_canonical, {_BLANKS}) s from side_table where length(trim(smiles_canonical, {_BLANKS})) >= 6),
t as (select s, list_distinct(list_transform(range(1, length(s) - 4), lambda i: substr(s, i, 6))) l from s),
u as (select s, len(l) n, unnest(l) g from t),
c as (select a.s sa, b.s sb, count(*) k, any_value(a.n + b.n) m from u a join u b on a.g = b.g and a.s < b.s group by 1, 2)
select least('lig:' || md5(sa), 'lig:' || md5(sb)) as node_id_a, greatest('lig:' || md5(sa), 'lig:' || md5(sb)) as node_id_b from c where k * 10 >= (m - k) * 7""",
    "p3_found": f"""
with recursive e as (
  select {_ID.format('src')} a, {_ID.format('dst')} b from canonical_edges
  where edge_type in ({', '.join(f"'{t}'" for t in LIGAND_IDENTITY)})),
p as (select a, b from e where a is not null and b is not null union select b, a from e where a is not null and b is not null),
r as (select a v, a root from p union select p.b, r.root from r join p on p.a = r.v where r.root < p.b)
select v as node_id, min(root) as group_id from r group by 1""",
    "p7_found": f"""
with m as (
  select 'ex:' || {_ID.format('example_id')} r, 'protein:' || {_ACC.format('uniprot')} e from side_table
  union select {_ID.format('src')}, {_ID.format('dst')} from canonical_edges where edge_type = 'example_from_publication'),
f as (select {_ID.format('node_id')} r, case when lower(trim(fold, {_BLANKS})) like 'train%' then 'train' when lower(trim(fold, {_BLANKS})) like 'val%' then 'val'
  when lower(trim(fold, {_BLANKS})) like 'test%' then 'test' end fold from split_result where protocol = 'protein_cluster')
select e as entity from m join f using (r) where e is not null group by 1 having count(distinct fold) > 1""",
}
