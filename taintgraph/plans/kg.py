"""The canonical graph as the queries read it: cleaned ids, one row per node, canonical edge types, one row per edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph.functions.stats import unit_hash
from taintgraph.functions.text import clean_id, fold_name
from taintgraph.operators.build import map_edge_types
from taintgraph.session import table


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge row whose two ends are ids: edge_id, src, dst, edge_type (as written)."""
    e = table(spark, sf, "canonical_edges")
    x = e.select("edge_id", clean_id(e["src"]).alias("src"), clean_id(e["dst"]).alias("dst"), "edge_type")
    return x.where("src is not null and dst is not null")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return map_edge_types(raw_edges(spark, sf)).select("src", "dst", "edge_type").distinct()


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "canonical_nodes").withColumn("node_id", clean_id(F.col("node_id"))).where("node_id is not null")
    return n.groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"), F.min("props").alias("props"))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).where("node_type = 'Example'")
    js = lambda k: F.get_json_object("props", f"$.{k}")
    return n.select("node_id", js("source").alias("source"), js("label").try_cast("bigint").alias("label"), js("target").alias("target"))


def folds(spark: SparkSession, sf: str, protocol: str = "random") -> DataFrame:
    s = table(spark, sf, "split_result").where(F.col("protocol") == protocol)
    x = s.select(clean_id(s["node_id"]).alias("node_id"), fold_name(s["fold"]).alias("fold"))
    return x.where("node_id is not null and fold is not null").groupBy("node_id").agg(F.min("fold").alias("fold"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic stand-in for a model: a hash of the id blended with the label."""
    e = examples(spark, sf).where("label in (0, 1) and source is not null").join(folds(spark, sf), "node_id")
    score = F.round((unit_hash(F.col("node_id")) % 1000 + 400 * F.col("label")) / 1400.0, 6)
    return e.select(F.col("node_id").alias("example_id"), "source", "label", "fold", score.alias("score"))


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def sql_id(col: str) -> str:
    return f"nullif(lower(trim({col}, {BLANKS})), '')"


def sql_fold(col: str = "fold") -> str:
    f = f"lower(trim({col}, {BLANKS}))"
    return f"case when {f} like 'train%' then 'train' when {f} like 'val%' then 'val' when {f} like 'test%' then 'test' end"


def sql_hash(expr: str) -> str:
    return f"cast('0x' || substr(md5({expr}), 1, 8) as bigint)"


def sql_edge_type() -> str:
    from taintgraph.vocab import EDGE_TYPE

    return "case edge_type " + " ".join(f"when '{k}' then '{v}'" for k, v in EDGE_TYPE.items()) + " else edge_type end"


SQL = f"""
with raw_edges as (select edge_id, {sql_id('src')} src, {sql_id('dst')} dst, edge_type from canonical_edges where {sql_id('src')} is not null and {sql_id('dst')} is not null),
edges as (select distinct src, dst, {sql_edge_type()} edge_type from raw_edges),
nodes as (select {sql_id('node_id')} node_id, min(node_type) node_type, min(label) label, min(props) props from canonical_nodes where {sql_id('node_id')} is not null group by 1),
examples as (select node_id, case when json_valid(props) then json_extract_string(props, '$.source') end source,
  try_cast(case when json_valid(props) then json_extract_string(props, '$.label') end as bigint) as label,
  case when json_valid(props) then json_extract_string(props, '$.target') end target from nodes where node_type = 'Example'),
folds as (select {sql_id('node_id')} node_id, min({sql_fold()}) fold from split_result where protocol = 'random' and {sql_fold()} is not null and {sql_id('node_id')} is not null group by 1),
pred as (select e.node_id example_id, source, label, fold, round(({sql_hash('e.node_id')} % 1000 + 400 * label) / 1400.0, 6) score from examples e join folds f on f.node_id = e.node_id where label in (0, 1) and source is not null)
"""


def sql(body: str) -> str:
    """``body`` over the views above; further views may come first, as ``, name as (...)``."""
    return SQL + body


def sql_bfs(name: str, seeds: str, edge_where: str, hops: int) -> str:
    """Views {name}b (both directions) and {name} (node_id, hop), unrolled."""
    out = f""", {name}b as (select src, dst from edges where {edge_where} union select dst, src from edges where {edge_where}),
{name}0 as (select distinct node_id, 0 hop from ({seeds}))"""
    for k in range(1, hops + 1):
        out += f""", {name}{k} as (select * from {name}{k - 1} union all
  (select dst, {k} from {name}b where src in (select node_id from {name}{k - 1} where hop = {k - 1}) and dst not in (select node_id from {name}{k - 1}) group by dst))"""
    return out + f", {name} as (select * from {name}{hops})"


def sql_types(types: list[str]) -> str:
    return "edge_type in (" + ", ".join(f"'{t}'" for t in types) + ")"


def sql_auroc(source: str, keys: str, where: str = "true") -> str:
    """Query for (keys, auroc, n_pos, n_neg) with mid-ranks."""
    return f"""(with s as (select {keys}, score, sum(label) p, sum(1 - label) n from {source} where {where} group by {keys}, score),
c as (select *, coalesce(sum(n) over (partition by {keys} order by score rows between unbounded preceding and 1 preceding), 0) below from s)
select {keys}, case when sum(p) = 0 or sum(n) = 0 then 'nan'::double else sum(p * (2 * below + n))::double / (2 * sum(p) * sum(n)) end auroc, sum(p)::bigint n_pos, sum(n)::bigint n_neg from c group by {keys})"""
