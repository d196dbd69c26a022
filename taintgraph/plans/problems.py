"""Queries over the core's own problems: references (1), hot keys (4), units (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph.functions.text import clean_id
from taintgraph.operators import hot_keys, references, units
from taintgraph.session import table


def _p1(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = table(spark, sf, "canonical_nodes"), table(spark, sf, "canonical_edges")
    side, wanted = table(spark, sf, "side_table"), table(spark, sf, "trainset_manifest")
    refs = references.references(edges, "canonical_edges", "node", "edge_id", ["src", "dst"], "loaded_at").union(
        references.references(wanted, "trainset_manifest", "example", "manifest_id", ["example_id"], "requested_at")
    )
    par = references.parents(nodes, "node", "node_id", "loaded_at", "retired_at").union(references.parents(side, "example", "example_id"))
    return refs, par


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans(*_p1(spark, sf)).select("tab", "row_id", "field").distinct()


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    refs, par = _p1(spark, sf)
    return references.counts_by_month(references.classify(references.orphans(refs, par), par))


def _p4_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "canonical_edges")
    return e.select(clean_id(e["src"]).alias("src"), clean_id(e["dst"]).alias("dst"), "edge_type")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    per_dst = hot_keys.tree_count(_p4_edges(spark, sf), ["dst"], "n_edges")
    return hot_keys.heavy_keys(per_dst, "n_edges", 0.01).select("dst")


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    return hot_keys.tree_count_distinct(_p4_edges(spark, sf), ["dst", "edge_type"], "src", "n_edges", "n_src")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    got = units.potencies(table(spark, sf, "activities"))
    return got.where("value_pm is not null and not is_plain_nm").select("activity_id", "value_pm").distinct()


def p6_origins(spark: SparkSession, sf: str) -> DataFrame:
    got = units.potencies(table(spark, sf, "activities")).distinct()
    return got.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("value_pm").alias("n_with_value"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p4_found, p4_counts, p6_found, p6_origins)}

_ID = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"

_P1 = f"""
with refs as (
  select 'canonical_edges' tab, cast(edge_id as varchar) row_id, 'src' field, {_ID.format('src')} k, loaded_at ts from canonical_edges
  union all select 'canonical_edges', cast(edge_id as varchar), 'dst', {_ID.format('dst')}, loaded_at from canonical_edges
), n as (select {_ID.format('node_id')} k, loaded_at f, retired_at t from canonical_nodes),
orphan as (
  select tab, row_id, field, k, ts, 'node' sp from refs r where k is not null and not exists
    (select 1 from n where n.k = r.k and n.f <= r.ts and (n.t is null or n.t > r.ts))
  union all
  select 'trainset_manifest', cast(manifest_id as varchar), 'example_id', {_ID.format('example_id')} k, requested_at, 'ex' from trainset_manifest m
  where {_ID.format('example_id')} is not null and {_ID.format('example_id')} not in
    (select {_ID.format('example_id')} from side_table where {_ID.format('example_id')} is not null)
)"""

ORACLE = {
    "p1_found": _P1 + " select distinct tab, row_id, field from orphan",
    "p1_counts": _P1
    + """, first as (select k, min(f) ff from n group by k)
select tab, field, kind, strftime(ts, '%Y-%m') as month, count(*) as n_orphans from (
  select o.*, case when sp = 'ex' or ff is null then 'missing' when ff <= ts then 'deleted' else 'late' end kind
  from orphan o left join first on first.k = o.k and o.sp = 'node') group by 1, 2, 3, 4""",
    "p4_found": f"""with e as (select {_ID.format('dst')} dst from canonical_edges), d as (select dst, count(*) n from e where dst is not null group by 1)
select dst from d where n * 100 >= (select sum(n) from d)""",
    "p4_counts": f"""select {_ID.format('dst')} as dst, edge_type, count(*) as n_edges, count(distinct {_ID.format('src')}) as n_src
from canonical_edges where {_ID.format('dst')} is not null group by 1, 2""",
}


def _p6_sql() -> str:
    """The same rules in DuckDB, with missing units by the nearest power of a thousand instead of a mixture."""
    blanks = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
    typ = r"(?i)^\s*(p|(?:-\s*)?log\s*(?:10)?\s*)?[(\[]?\s*(IC50|EC50|Ki|Kd)\s*[)\]]?\s*(.*)$"
    molar = r"(?:M|mol/L)"

    def norm(c: str) -> str:
        u = f"translate(trim(coalesce({c}, ''), {blanks}), 'µμ−–', 'uu--')"
        u = rf"regexp_replace({u}, '[\s.·*()\[\]^]+', '', 'g')"
        return rf"regexp_replace(regexp_replace({u}, '(mol|g)/?([mud]?)[lL](?:-1)?$', '\1/\2L'), 'mol/?dm-?3$', 'mol/L')"

    def prefix(c: str) -> str:
        return f"case {c} when '' then 0 when 'k' then 3 when 'd' then -1 when 'm' then -3 when 'u' then -6 when 'n' then -9 when 'p' then -12 when 'f' then -15 end"

    def code(c: str) -> str:
        none = ", ".join(f"'{x.replace(' ', '').replace('.', '')}'" for x in units.NO_UNIT)
        return rf"""case when lower({c}) in ({none}) then 2000
 when regexp_matches({c}, '^[kdmunpf]?{molar}$') then {prefix(f"regexp_extract({c}, '^([kdmunpf]?){molar}$', 1)")}
 when regexp_matches(lower({c}), '^(milli|micro|nano|pico|femto)?molar$') then case regexp_extract(lower({c}), '^(milli|micro|nano|pico|femto)?molar$', 1) when 'milli' then -3 when 'micro' then -6 when 'nano' then -9 when 'pico' then -12 when 'femto' then -15 else 0 end
 when regexp_matches({c}, '^[kdmunpf]?g/[dmu]?L$') then 1000 + {prefix(f"regexp_extract({c}, '^([kdmunpf]?)g/', 1)")} - ({prefix(f"regexp_extract({c}, '/([dmu]?)L$', 1)")})
 when lower({c}) in ('logunits', 'logunit') then 5000 when regexp_matches(lower({c}), '^-log(10)?(m|molar|mol/l)?$') then 3000 when regexp_matches(lower({c}), '^log(10)?(m|molar|mol/l)?$') then 4000
 when regexp_matches({c}, '^(?:1x)?10[+-]?[0-9]+{molar}$') then cast(regexp_extract({c}, '^(?:1x)?10([+-]?[0-9]+){molar}$', 1) as integer) end"""

    num = r"((?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
    unit = r"([pnumfµμ]?M\b|(?:pico|nano|micro|milli|femto)?molar\b|[pnumfµμ]?mol/[lL]\b|[pnumkµμ]?g/[mudµμ]?[lL]\b)"
    named = rf"(?:^|[^A-Za-z0-9])(?:IC50|EC50|Ki|Kd)\s*(?:=|:|~|of|is|was|approx\.?|<|>)?\s*{num}\s*{unit}"
    conc = "case when abs({u}) < 500 then {v} * pow(10.0, {u}) when abs({u} - 1000) < 500 then {v} * pow(10.0, {u} - 1000) / mw end"
    return rf"""
with a as (select distinct activity_id, trim(standard_type, {blanks}) t, standard_value v, standard_units, pchembl_value p, case when mol_weight > 0 then mol_weight end mw, activity_comment c from activities),
b as (select *, lower(regexp_extract(t, '{typ}', 2)) kind, regexp_replace(lower(regexp_extract(t, '{typ}', 1)), '\s', '', 'g') pre, {norm(rf"regexp_replace(regexp_extract(t, '{typ}', 3), '^[ _,;:(\[]+|[ )\]]+$', '', 'g')")} tn, {norm('standard_units')} un from a),
x as (select *, {code('tn')} tu, {code('un')} su from b where kind <> ''),
y as (select *, case when tu = 2000 then su else tu end unit, regexp_extract(c, '^\s*{num}\s*{unit}\s*$', 1) wv, regexp_extract(c, '^\s*{num}\s*{unit}\s*$', 2) wu,
 list_distinct(regexp_extract_all(c, '{named}', 1)) nv, list_distinct(regexp_extract_all(c, '{named}', 2)) nu from x where tu is not null),
z as (select *, case when pre like '-log%' or pre = 'p' then -1 when pre like 'log%' then 1 when unit = 3000 then -1 when unit = 4000 then 1 else 0 end sign,
 case when wv <> '' then wv when len(nv) = 1 and len(nu) = 1 then nv[1] end cv, {norm("case when wv <> '' then wu when len(nv) = 1 and len(nu) = 1 then nu[1] end")} cn from y),
w as (select *, case when regexp_matches(cv, '^[0-9]+(,[0-9]{{3}})+(\.[0-9]+)?$') then cast(replace(cv, ',', '') as double) else cast(replace(cv, ',', '.') as double) end cnum, {code('cn')} cu,
 case when v > 0 then round((log10(v) + p) / 3) end k from z),
m as (select *, case when v is null then coalesce(case when cnum > 0 then {conc.format(u='cu', v='cnum')} end, pow(10.0, -p))
 when sign <> 0 then case when unit in (2000, 3000, 4000, 5000, 0) then pow(10.0, v * sign) end
 when unit = 2000 then case when k between 0 and 4 and abs(log10(v) + p - 3 * k) < 0.3 then v * pow(10.0, -3 * k) end
 when v > 0 then {conc.format(u='unit', v='v')} end value_m from w)
select distinct activity_id, cast(floor(value_m * 1e12 * (1 + 1e-14) + 0.5) as bigint) as value_pm from m
where value_m > 0 and not (coalesce(trim(standard_units, {blanks}) = 'nM', false) and v is not null and sign = 0 and tu = 2000)"""


ORACLE["p6_found"] = _p6_sql()
