import random

import pytest

from taintgraph.llm import group_splits, groups


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def grouped(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string, node_id string, v long") if pairs and len(pairs[0]) == 4 else spark.createDataFrame(pairs, "a string, b string")
    return {r["node_id"]: r["group_id"] for r in groups.group_pairs(df).collect()}


def test_groups_dirty_rows_and_empty(spark):
    rows = [("b", "a", "x", 1), ("a", "b", "x", 1), ("b", "c", None, 2), ("s", "s", "x", 3), (None, "z", "x", 4), ("", "z", "x", 5), ("c", "c", "x", 6)]
    assert grouped(spark, rows) == {"a": "a", "b": "a", "c": "a", "s": "s"}
    assert grouped(spark, []) == {}
    assert grouped(spark, [("q", "q")]) == {"q": "q"}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "giant"])
def test_groups_against_union_find(spark, kind):
    rnd = random.Random(kind)
    if kind == "chain":  # far longer than the frontier search goes
        pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(150)]
        rnd.shuffle(pairs)
    elif kind == "star":
        pairs = [("zz", f"n{i}") for i in range(200)] + [("m", "k"), ("k", "l")]
    elif kind == "random":
        pairs = [(f"n{rnd.randint(0, 300)}", f"n{rnd.randint(0, 300)}") for _ in range(140)]
    else:
        pairs = [(f"n{rnd.randint(0, 300)}", f"n{rnd.randint(0, 300)}") for _ in range(400)] + [("x", "y"), ("y", "z")]
    assert grouped(spark, pairs) == union_find(pairs)


def members(spark, rows):
    return spark.createDataFrame(rows, "record string, entity string")


def test_contraction_against_union_find(spark):
    rnd = random.Random(5)
    rows = [(f"r{i}", f"e{rnd.randint(0, 200)}") for i in range(150) for _ in range(rnd.randint(1, 3))] + [(f"hot{i}", "e0") for i in range(80)]
    m = members(spark, rows)
    got = {r["entity"]: r["root"] for r in group_splits.components(m).collect()}
    want = union_find([("R" + r, e) for r, e in rows])
    same = {}
    for e, root in got.items():
        same.setdefault(root, set()).add(e)
    other = {}
    for x, root in want.items():
        if x.startswith("e"):
            other.setdefault(root, set()).add(x)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, other.values()))


def test_split_keeps_groups_and_shares(spark):
    rows = [(f"r{i}", f"e{i // 4}") for i in range(2000)]
    m = members(spark, rows)
    records = spark.createDataFrame([(f"r{i}",) for i in range(2000)] + [(f"lone{i}",) for i in range(400)] + [("r1",), (None,)], "record string")
    out = group_splits.grouped_split(m, records, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert len(out) == 2400
    fold = {r["record"]: r["fold"] for r in out}
    assert all(len({fold[f"r{i}"] for i in range(4 * k, 4 * k + 4)}) == 1 for k in range(500))
    share = {f: sum(v == f for v in fold.values()) / 2400 for f in ("train", "val", "test")}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["val"] - 0.15) < 0.02 and abs(share["test"] - 0.15) < 0.02


def test_split_with_a_giant_and_empty(spark):
    m = members(spark, [(f"r{i}", "hub") for i in range(60)] + [(f"s{i}", f"e{i}") for i in range(40)])
    records = m.select("record")
    out = group_splits.grouped_split(m, records, {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert {r["fold"] for r in out if r["record"].startswith("r")} == {"train"}
    n = {f: sum(r["fold"] == f for r in out) for f in ("train", "val", "test")}
    assert 65 <= n["train"] <= 75 and 12 <= n["val"] <= 18
    assert group_splits.grouped_split(m.limit(0), records.limit(0), {"train": 1.0}).count() == 0


def test_torn_entities(spark):
    m = members(spark, [("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("d", "z"), ("e", "w"), ("f", "w")])
    f = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test"), ("d", "val"), ("d", "val"), ("e", None), ("f", "train")], "record string, fold string")
    assert {r["entity"] for r in group_splits.torn_entities(m, f).collect()} == {"x"}
    wide = spark.createDataFrame([("a", "x", 1, "q", "q", None), ("b", "x", 1, "q", "q", "z"), ("b", None, 1, "q", "q", None), (None, "x", 1, "q", "q", None)], "record string, entity string, a int, fold string, root string, top string")
    assert {r["entity"] for r in group_splits.torn_entities(wide, f.selectExpr("record", "fold", "1 as entity")).collect()} == {"x"}
    split = group_splits.grouped_split(wide, wide, {"train": 0.5, "test": 0.5}).collect()
    assert {r["record"] for r in split} == {"a", "b"} and len({r["fold"] for r in split}) == 1
    assert group_splits.torn_entities(m, f.limit(0)).count() == 0
