"""Rank statistics as aggregates: AUROC with mid-ranks, bootstrap intervals, tests of a difference.

Scores are first summed per distinct score. Ranks come from bucket sums and positions within a bucket, so that no
window spans a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_bucket(s: Column, per_octave: int = 1024) -> Column:
    """A number that never falls as ``s`` grows: ``per_octave`` buckets between a power of two and the next, on either side
    of zero, so that scores of any scale spread over many buckets. NaN comes last."""
    size = F.least(F.greatest(F.abs(s), F.lit(1e-300)), F.lit(1e300))
    octave = F.floor(F.log2(size))
    place = (octave + 1100) * per_octave + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    return F.when(F.isnan(s), F.lit(1 << 40)).when(s == 0, 0).when(s > 0, place).otherwise(-place).cast("long")


def auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """keys + (auroc, n_pos, n_neg); Mann-Whitney with ties at half. NaN when a class is missing.

    Scores may be of any scale. Rows with a null score or a label other than 0 and 1 are left out. ``weight``: column of integer row weights."""
    w = F.col(weight) if weight else F.lit(1)
    d = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    per = d.groupBy(*keys, F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("n")
    )
    per = per.withColumn("b", score_bucket(F.col("s").cast("double")))
    sums = per.groupBy(*keys, "b").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("bn").over(before), F.lit(0))).drop("bn")
    within = Window.partitionBy(*keys, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = per.join(sums, [*keys, "b"]).withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    # twice the statistic stays an integer
    out = x.groupBy(*keys).agg(F.sum(F.col("p") * (2 * F.col("below") + F.col("n"))).alias("u2"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    value = F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(float("nan"))).otherwise(F.col("u2") / (2 * F.col("n_pos") * F.col("n_neg")))
    return out.select(*keys, value.alias("auroc"), "n_pos", "n_neg")


def unit_hash(*parts: Column) -> Column:
    """A reproducible draw from 0..2^32-1: the first eight hex digits of the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


#: cumulative probabilities of a Poisson variable of mean 1 on the scale 0..2^32-1 (fixed values)
POISSON_STEPS = [1580030169, 3160060338, 3950075422, 4213413783, 4279248374, 4292415292]


def poisson_weight(h: Column) -> Column:
    w = F.lit(len(POISSON_STEPS))
    for k in range(len(POISSON_STEPS) - 1, -1, -1):
        w = F.when(h < POISSON_STEPS[k], k).otherwise(w)
    return w


#: replicates of a test of a difference and of an interval (fixed values)
DELTA_REPS, INTERVAL_REPS = 1000, 500


def bootstrap(df: DataFrame, keys: list[str], row_id: str, reps: int, seed: int = 42, score: str = "score", label: str = "label") -> DataFrame:
    """keys + (rep, auroc): every replicate weighs every row by a Poisson draw of its id, which is the bootstrap that
    needs no row to know how many others there are. Replicates that lost a class are left out."""
    r = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    r = r.withColumn("w", poisson_weight(unit_hash(F.lit(str(seed)), F.col("rep").cast("string"), F.col(row_id)))).where("w > 0")
    return auroc(r, [*keys, "rep"], score, label, "w").where(~F.isnan("auroc")).select(*keys, "rep", "auroc")


def bootstrap_interval(df: DataFrame, keys: list[str], row_id: str, reps: int = INTERVAL_REPS, seed: int = 42) -> DataFrame:
    """keys + (point, lower, upper, n_pos, n_neg): percentile interval of 95 %."""
    b = bootstrap(df, keys, row_id, reps, seed).groupBy(*keys).agg(F.percentile("auroc", [0.025, 0.975]).alias("ci"))
    point = auroc(df, keys)
    return point.join(b, keys, "left").select(*keys, F.col("auroc").alias("point"), F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper"), "n_pos", "n_neg")


def delta_test(df: DataFrame, keys: list[str], flag: str, row_id: str, reps: int = DELTA_REPS, seed: int = 42) -> DataFrame:
    """keys + (delta, lower, upper, p): AUROC of flagged rows less that of the others, two independent bootstraps.

    p is twice the smaller share of differences on one side of zero, at most 1."""
    parts = {v: df.where(F.col(flag) == v) for v in (True, False)}
    point = auroc(parts[True], keys).select(*keys, F.col("auroc").alias("a1")).join(auroc(parts[False], keys).select(*keys, F.col("auroc").alias("a0")), keys)
    reps_of = {v: bootstrap(parts[v], keys, row_id, reps, seed + (not v)) for v in parts}
    d = reps_of[True].withColumnRenamed("auroc", "x").join(reps_of[False].withColumnRenamed("auroc", "y"), [*keys, "rep"]).withColumn("d", F.col("x") - F.col("y"))
    side = lambda c: F.avg(c.cast("double"))
    s = d.groupBy(*keys).agg(F.percentile("d", [0.025, 0.975]).alias("ci"), F.least(side(F.col("d") <= 0), side(F.col("d") >= 0)).alias("tail"))
    return point.join(s, keys, "left").select(
        *keys, (F.col("a1") - F.col("a0")).alias("delta"), F.col("ci")[0].alias("lower"), F.col("ci")[1].alias("upper"), F.least(F.lit(1.0), 2 * F.col("tail")).alias("p")
    )


def hash_rank(df: DataFrame, strata: list[str], row_id: str, seed: int, buckets: int = 4096) -> DataFrame:
    """Adds rank (1-based) and size of each row's stratum, in the order of ``md5(seed|id)``.

    The rank is exact: rows of earlier hash buckets are counted per stratum, then positions within the bucket."""
    h = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id))))
    h = h.withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    n = h.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("__n").over(by))
    x = h.alias("h").join(n.alias("n"), [F.col(f"h.{s}").eqNullSafe(F.col(f"n.{s}")) for s in strata] + [F.col("h.__b") == F.col("n.__b")])
    within = Window.partitionBy(*[F.col(f"h.{s}") for s in strata], F.col("h.__b")).orderBy(F.col("h.__h"), F.col(f"h.{row_id}"))
    return x.select(*[F.col(f"h.{c}") for c in df.columns], (F.col("n.__before") + F.row_number().over(within)).alias("rank"), F.col("n.size").alias("size"))
