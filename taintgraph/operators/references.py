"""References to records that do not exist.

References and parents are shuffled once by key, sorted, and read as two sorted streams by a sort-merge anti join
whose residual condition is the parents' validity interval. A hot key is split by AQE on the reference side
(left anti and left outer joins may be split there), so no task holds one key's references whole.

Defined cases: a null or blank key is no reference; a reference whose time is null has no valid parent unless the
parent is timeless; parents with a null key or start never validate; repeated parents are merged before the join;
repeated references come out once; empty inputs give empty results; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgraph.functions.text import clean_id

def _far() -> Column:
    return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")



def _ever() -> Column:
    return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")


def references(df: DataFrame, tab: str, space: str, row_id: str, fields: list[str], at: str) -> DataFrame:
    """One row per (row, field) holding an id: tab, row_id, field, space, key, at."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), clean_id(df[f]).alias("key")) for f in fields])
    out = df.select(df[row_id].cast("string").alias("row_id"), df[at].cast("timestamp_ntz").alias("at"), F.explode(pairs).alias("x"))
    return out.where("x.key is not null").select(
        F.lit(tab).alias("tab"), "row_id", F.col("x.field").alias("field"), F.lit(space).alias("space"), F.col("x.key").alias("key"), "at"
    )


def parents(df: DataFrame, space: str, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Validity intervals of parent rows: space, key, valid_from, valid_to (exclusive). Without ``start`` they hold for ever."""
    return df.select(
        F.lit(space).alias("space"),
        clean_id(df[key]).alias("key"),
        (df[start].cast("timestamp_ntz") if start else _ever()).alias("valid_from"),
        (F.coalesce(df[end].cast("timestamp_ntz"), _far()) if end else _far()).alias("valid_to"),
    ).where("key is not null")


def orphans(refs: DataFrame, par: DataFrame) -> DataFrame:
    """References without a parent that is valid at their time."""
    # one row per (key, start): the longest interval covers the others; the partial aggregate runs before the shuffle
    ivals = par.groupBy("space", "key", "valid_from").agg(F.max("valid_to").alias("valid_to"))
    r, p = refs.alias("r"), ivals.hint("merge").alias("p")
    timeless = F.col("p.valid_from") == _ever()
    valid = ((F.col("p.valid_from") <= F.col("r.at")) & (F.col("p.valid_to") > F.col("r.at"))) | timeless
    return r.join(p, (F.col("r.space") == F.col("p.space")) & (F.col("r.key") == F.col("p.key")) & valid, "left_anti")


def classify(found: DataFrame, par: DataFrame) -> DataFrame:
    """Adds kind: ``missing`` (no such parent ever), ``late`` (loaded only afterwards), ``deleted`` (retired before)."""
    first = par.groupBy("space", "key").agg(F.min("valid_from").alias("first_from"))
    joined = found.join(first.hint("merge"), ["space", "key"], "left")
    kind = (
        F.when(F.col("first_from").isNull(), "missing")
        .when(F.col("first_from") <= F.col("at"), "deleted")
        .otherwise("late")
    )
    return joined.select("tab", "row_id", "field", "key", "at", kind.alias("kind"))


def counts_by_month(classified: DataFrame) -> DataFrame:
    """Orphans per table, field, kind and calendar month of the reference (null month for a reference without time)."""
    month: Column = F.date_format("at", "yyyy-MM")
    return classified.groupBy("tab", "field", "kind", month.alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
