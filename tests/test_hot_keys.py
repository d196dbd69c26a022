import collections

import pytest

from taintgraph.operators.hot_keys import chunks, heavy_keys, rounds, tree_count, tree_count_distinct


def test_counts_equal_plain_ones_under_skew(spark):
    rows = [("hot", "t", f"s{i % 700}") for i in range(3000)] + [(f"k{i % 50}", "t", None if i % 7 == 0 else f"s{i}") for i in range(500)] + [(None, "t", "x"), ("k1", None, "x")]
    df = spark.createDataFrame(rows, "dst string, edge_type string, src string").repartition(7)
    got = {(r["dst"], r["edge_type"]): (r["n"], r["d"]) for r in tree_count_distinct(df, ["dst", "edge_type"], "src", "n", "d", fan_in=3).collect()}
    want = collections.defaultdict(lambda: [0, set()])
    for d, t, s in rows:
        if d is not None and t is not None:
            want[d, t][0] += 1
            want[d, t][1].add(s)
    assert got == {k: (n, len(v - {None})) for k, (n, v) in want.items()}
    n = {r["dst"]: r["n"] for r in tree_count(df, ["dst"], "n", fan_in=2).collect()}
    assert n["hot"] == 3000 and sum(n.values()) == 3501


def test_heavy_keys_edges(spark):
    df = spark.createDataFrame([("a", 1)] * 99 + [("b", 1)], "dst string, dst_ string")
    c = tree_count(df, ["dst"], "n")
    assert {r["dst"] for r in heavy_keys(c, "n", 0.01).collect()} == {"a", "b"}  # exactly one per cent counts
    assert heavy_keys(tree_count(df.limit(0), ["dst"], "n"), "n", 0.01).collect() == []


def test_rounds_are_logarithmic_and_bound_the_fan_in():
    assert rounds(1, 16) == [] and rounds(16, 16) == [1] and rounds(17, 16) == [2, 1]
    for n in (255, 4097, 800_000):
        left = rounds(n, 16)
        assert left[-1] == 1 and all(a <= 16 * b for a, b in zip([n, *left], left)) and 16 ** len(left) >= n > 16 ** (len(left) - 1)
    with pytest.raises(ValueError):
        rounds(5, 1)


def test_every_chunk_has_a_lane_of_its_own(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id % 3 as string) as dst").repartition(9).write.parquet(f"{tmp_path}/t")
    df = spark.read.option("maxSplitBytes", 1).parquet(f"{tmp_path}/t")
    assert chunks(df) == df.rdd.getNumPartitions()
    assert {r["dst"]: r["n"] for r in tree_count(df, ["dst"], "n", fan_in=2).collect()} == {"0": 334, "1": 333, "2": 333}
