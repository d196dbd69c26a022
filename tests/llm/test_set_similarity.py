import random

import numpy as np
import pyarrow as pa

from taintgraph.llm.set_similarity import _DIVERTED, _LARGE, BRANCHES, Diversion, _first_paths, n_trees, shingle_keys, similar_pairs


def brute(texts, q, num, den):
    s = {t: {t[i : i + q] for i in range(len(t) - q + 1)} for t in texts if t and len(t) >= q}
    keys = sorted(s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) * den >= len(s[a] | s[b]) * num}


def run(spark, texts, **kw):
    df = spark.createDataFrame([(t, 1, "x") for t in texts], "t string, s long, h string")
    return {tuple(sorted((r["ta"], r["tb"]))) for r in similar_pairs(df, "t", **kw).collect()}


def families(seed, n, odd=""):
    rnd = random.Random(seed)
    alpha = "CNOcn()=1" + odd
    out = []
    for _ in range(n):
        base = "".join(rnd.choice(alpha) for _ in range(rnd.randint(20, 70)))
        out.append(base)
        for _ in range(3):
            x = list(base)
            for _ in range(rnd.randint(0, 4)):
                x[rnd.randrange(len(x))] = rnd.choice(alpha)
            out.append("".join(x) + rnd.choice(["", "Cl", "CC"]))
    return out


def test_against_brute_force(spark):
    t = families(1, 80)
    assert run(spark, t) == brute(set(t), 6, 7, 10)


def test_any_characters_short_long_null_and_repeated(spark):
    t = families(2, 20, "µ試😀") + [None, "", "   ", "abcde", "abcdef", "abcdef", "x" * 5000, "x" * 5001, "ab" * 3000 + "c", "ab" * 3000 + "d"]
    assert run(spark, t) == brute({x for x in t if x}, 6, 7, 10)


def test_empty(spark):
    assert run(spark, []) == set()


def test_large_nodes_are_split_and_lose_nothing(spark):
    rnd = random.Random(3)
    core = "".join(rnd.choice("CNOcn") for _ in range(60))
    t = [core + "".join(rnd.choice("CNOcn") for _ in range(10)) for _ in range(150)]  # all alike: every node is too large
    assert run(spark, t, node_limit=20, max_splits=3) == brute(set(t), 6, 7, 10)


def test_keys_of_rows_do_not_mix():
    keys, exact = shingle_keys(["abcdefg", "", "abc", "abcdefg"], 6)
    assert exact and sorted((k >> 42) for k in keys.tolist()) == [0, 0, 3, 3]


def test_tokens_do_not_depend_on_the_texts_beside():
    t = "CCOc1ccccc1N"
    for q in (6, 7):
        alone = shingle_keys([t], q)[0].tolist()
        beside = [k for k in shingle_keys([t, "CCOµ試😀ccN"], q)[0].tolist() if not k >> 42]
        assert beside == alone
    paths = lambda *texts: {r["path"] for b in _first_paths(6, 5, 3)(iter([pa.record_batch({"s": list(texts), "h": list(range(len(texts)))})])) for r in b.to_pylist() if r["h"] == 0}
    assert paths(t) == paths(t, "CCOµ試😀ccN")


def test_partners_in_different_slices(spark):
    t = [x for x in families(4, 40) if x] + [x + "µ" for x in families(5, 10)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert run(spark, t) == brute(set(t), 6, 7, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_token_sets_are_one_class_and_every_pair_comes_out(spark):
    a = "ABCDEFG"
    t = [a * k for k in range(2, 40)] + [a * 3 + "x", a * 5 + "y"] + families(6, 20)
    assert run(spark, t) == brute(set(t), 6, 7, 10)


def test_nearly_equal_sets_end_in_blocks(spark):
    """Splits do not part sets that differ in a few of very many tokens: they are compared block by block, exactly."""
    rnd = random.Random(7)
    core = "".join(rnd.choice("CNOcn()=123") for _ in range(300))
    t = [core[:k] + "F" + core[k:] for k in range(0, 300, 2)] + families(8, 20)
    assert run(spark, t, node_limit=10, max_splits=6) == brute(set(t), 6, 7, 10)
    assert run(spark, t, node_limit=10, max_splits=0) == brute(set(t), 6, 7, 10)


def test_trees_count_the_splits():
    assert n_trees(0.7, 0.9995, 3, 0) == 19
    for splits in (0, 4, 8, 16):
        n = n_trees(0.7, 0.9995, 3, splits)
        assert (1 - 0.7**3 * (1 - 0.3**BRANCHES) ** splits) ** n <= 0.0005


def test_rows_of_a_hot_path_travel_apart():
    d = Diversion(3)
    path = np.array([7 << 50] * 5 + [9 << 50] * 2, np.uint64)
    row = lambda p: d(p, np.arange(len(p)), np.full(len(p), 20), np.ones(len(p), np.uint64), np.ones(len(p), np.uint64), np.full(len(p), 5))
    p, h, n, s1, _ = row(path)
    away = n <= _DIVERTED
    assert (_DIVERTED - n[away]).tolist() == [5] * 5 and (n == _LARGE).sum() == 1 and p[n == _LARGE].tolist() == [7 << 50] and len(set(p[away].tolist())) == 5
    assert set(s1[away].tolist()) == {7 << 50} and p[(n > 0)].tolist() == [9 << 50] * 2
    p, h, n, *_ = row(path[:2])
    assert (n <= _DIVERTED).all()  # the marker is sent once


def test_a_hot_family_loses_no_pair(spark):
    rnd = random.Random(9)
    core = "".join(rnd.choice("CNOcn()=") for _ in range(50))
    t = [core + "".join(rnd.choice("CNOcn") for _ in range(8)) for _ in range(200)] + families(10, 100)
    for slices in (1, 6):
        df = spark.createDataFrame([(x,) for x in t], "t string").repartition(slices)
        got = {tuple(sorted((r["ta"], r["tb"]))) for r in similar_pairs(df, "t", node_limit=12).collect()}
        assert got == brute(set(t), 6, 7, 10)
