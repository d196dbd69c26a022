"""Set-overlap join on fingerprints (arrays of distinct set bits), exact, as equi-joins.

Rows are grouped by fingerprint first, so copies never meet each other in the join. Only the rarest
``n - ceil(t * n) + 1`` bits of a fingerprint are indexed (two sets at the threshold must share one of those), the size
window is the residual condition, and survivors are verified on whole fingerprints. A frequent bit is never among the
rarest of many rows, which keeps its posting list short; AQE splits what remains of it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgraph.session import cut


def shingle_bits(text: Column, q: int = 4, bits: int = 2048) -> Column:
    """A hashed fingerprint: the distinct bit numbers of all substrings of q characters; empty for shorter texts."""
    n = F.length(text) - q + 1
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q)))
    return F.when(n >= 1, F.array_sort(F.array_distinct(F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % bits).cast("int"))))).otherwise(F.array().cast("array<int>"))


def tanimoto(a: Column, b: Column) -> Column:
    """Null when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared, F.size(a) + F.size(b) - shared)


def _parity(bits: str) -> dict[str, Column]:
    """Two words of 64 bits: whether an odd number of elements falls on each of 128 places."""

    def word(low: int) -> Column:
        bit = lambda b: F.when((b % 128 >= low) & (b % 128 < low + 64), F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseXOR(bit(b)))

    return {"s1": word(0), "s2": word(64)}


def fingerprint_pairs(rows: DataFrame, key: str, bits: str, threshold: float) -> DataFrame:
    """(a, b, shared, joint), a < b, over distinct fingerprints: a and b are the smallest keys of theirs.

    Rows of one fingerprint are one class; see :func:`fingerprint_classes` for the membership."""
    t = Fraction(str(threshold))
    classes = cut(rows.where(F.size(bits) > 0).groupBy(F.col(bits).alias("fp")).agg(F.min(key).alias("k")).withColumns({"n": F.size("fp"), **_parity("fp")}), "classes")
    posts = classes.select("k", "n", "s1", "s2", F.explode("fp").alias("bit"))
    df = posts.groupBy("bit").agg(F.count(F.lit(1)).alias("df"))
    ranked = posts.join(df, "bit").withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("df", "bit")))
    ceil = lambda n, p, q: F.ceil(n * p / q)
    prefix = cut(ranked.where(F.col("rn") <= F.col("n") - ceil(F.col("n"), t.numerator, t.denominator) + 1).select("k", "n", "s1", "s2", "rn", "bit"), "prefix")
    # the larger set of a pair probes with its whole prefix; the smaller one needs only the shorter index prefix
    l, r = prefix.alias("l"), prefix.where(F.col("rn") <= F.col("n") - ceil(F.col("n"), 2 * t.numerator, t.numerator + t.denominator) + 1).alias("r")
    larger = (F.col("l.n") > F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.k") > F.col("r.k")))
    window = F.col("r.n") * t.denominator >= F.col("l.n") * t.numerator
    # at the first shared bit, what is left on either side bounds the overlap
    reach = 1 + F.least(F.col("l.n") - F.col("l.rn"), F.col("r.n") - F.col("r.rn"))
    enough = reach * (t.numerator + t.denominator) >= (F.col("l.n") + F.col("r.n")) * t.numerator
    # parity sketches differ in at most as many bits as the sets differ in elements
    apart = F.bit_count(F.col("l.s1").bitwiseXOR(F.col("r.s1"))) + F.bit_count(F.col("l.s2").bitwiseXOR(F.col("r.s2")))
    total = F.col("l.n") + F.col("r.n")
    near = apart <= total - 2 * ceil(total, t.numerator, t.numerator + t.denominator)
    cand = l.join(r, (F.col("l.bit") == F.col("r.bit")) & larger & window & enough & near).select(F.least("l.k", "r.k").alias("a"), F.greatest("l.k", "r.k").alias("b")).distinct()
    fa, fb = classes.select(F.col("k").alias("a"), F.col("fp").alias("fa")), classes.select(F.col("k").alias("b"), F.col("fp").alias("fb"))
    x = cand.join(fa, "a").join(fb, "b").withColumn("shared", F.size(F.array_intersect("fa", "fb")))
    x = x.withColumn("joint", F.size("fa") + F.size("fb") - F.col("shared"))
    return x.where(F.col("shared") * t.denominator >= F.col("joint") * t.numerator).select("a", "b", "shared", "joint")


def fingerprint_classes(rows: DataFrame, key: str, bits: str) -> DataFrame:
    """(key, class_key): every row with the smallest key of its fingerprint (rows of equal fingerprints share it)."""
    low = rows.where(F.size(bits) > 0).groupBy(bits).agg(F.min(key).alias("class_key"))
    return rows.join(low, bits).select(key, "class_key")


def max_similarity(queries: DataFrame, refs: DataFrame, others_only: bool = False, ladder: tuple[float, ...] = (0.8, 0.6, 0.4, 0.2, 0.0)) -> DataFrame:
    """(key, best): the highest Tanimoto of each query to any reference, -1.0 for a query without bits; both frames
    are (key, bits). A query that shares no bit with any has 0.0. ``others_only``: a query's own row is no reference.

    Thresholds go down a ladder. At a step two sets meet only on the bits by which sets at that threshold must meet (the
    rarest of either) and within the sizes it allows; a query whose best reaches the threshold is done, as no pair above
    it was left out. What few queries remain at the end meet every set they share a bit with."""
    classes = cut(refs.where("size(bits) > 0").groupBy("bits").agg(F.min("key").alias("rk"), F.count(F.lit(1)).alias("copies")), "classes")
    posts = classes.select("rk", "copies", F.size("bits").alias("m"), F.explode("bits").alias("bit"))
    df = cut(posts.groupBy("bit").agg(F.count(F.lit(1)).alias("df")), "bits")
    by_rarity = lambda k: F.row_number().over(Window.partitionBy(k).orderBy("df", "bit"))
    r = cut(posts.join(df, "bit").withColumn("rn", by_rarity("rk")).drop("df"), "posts")
    q = queries.where("size(bits) > 0").select("key", F.size("bits").alias("n"), F.explode("bits").alias("bit"))
    q = cut(q.join(df, "bit", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("qn", by_rarity("key")).drop("df"), "asked")
    done, left = None, q
    for step in ladder:
        t = Fraction(str(step))
        met = left.where(F.col("qn") <= F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator) + 1).join(
            r.where(F.col("rn") <= F.col("m") - F.ceil(F.col("m") * t.numerator / t.denominator) + 1), "bit"
        )
        met = met.where((F.least("n", "m") * t.denominator >= F.greatest("n", "m") * t.numerator))
        if others_only:
            met = met.where("key <> rk or copies > 1")
        pairs = met.select("key", "rk").distinct()
        x = pairs.join(queries.select("key", F.col("bits").alias("qb")), "key").join(classes.select("rk", F.col("bits").alias("rb")), "rk")
        best = cut(x.groupBy("key").agg(F.max(tanimoto(F.col("qb"), F.col("rb"))).alias("best")).where(F.col("best") >= step), "best")
        done = best if done is None else done.union(best)
        left = cut(left.join(best.select("key"), "key", "left_anti"), "asked")
        if not left.limit(1).count():
            break
    return queries.select("key", "bits").join(done, "key", "left").select("key", F.when(F.size("bits") == 0, -1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("best"))


def pair_counts(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_pairs) of verified pairs."""
    ts = [Fraction(str(t)) for t in thresholds]
    one = pairs.agg(*[F.coalesce(F.sum((F.col("shared") * t.denominator >= F.col("joint") * t.numerator).cast("long")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(ts)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_pairs")) for i, t in enumerate(ts)]))
    return one.select(rows.alias("x")).select("x.*")


def similarity_edges(pairs: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs as edges: identical fingerprints under their own type, the others as similar with rounded similarity."""
    sim = F.round(F.col("shared") / F.col("joint"), 4)
    kind = F.when(F.col("shared") == F.col("joint"), "ligand_fingerprint_exact").otherwise("ligand_similar")
    props = F.to_json(F.struct(sim.alias("tanimoto"), F.lit("shingle").alias("fp_type"), F.lit("prefix_join").alias("method")))
    return pairs.where(F.col("shared") / F.col("joint") >= min_similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("edge_type"), props.alias("props"))
