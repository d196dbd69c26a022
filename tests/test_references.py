from datetime import datetime as dt

from taintgraph.operators import references as R

T = lambda m: dt(2023, m, 1)


def tables(spark, edges, nodes):
    e = spark.createDataFrame(edges, "edge_id long, src string, dst string, loaded_at timestamp_ntz, kind string, key string")
    n = spark.createDataFrame(nodes, "node_id string, loaded_at timestamp_ntz, retired_at timestamp_ntz, key string")
    return R.references(e, "e", "node", "edge_id", ["src", "dst"], "loaded_at"), R.parents(n, "node", "node_id", "loaded_at", "retired_at")


def found(spark, edges, nodes):
    refs, par = tables(spark, edges, nodes)
    return {(r["row_id"], r["field"]): r["kind"] for r in R.classify(R.orphans(refs, par), par).collect()}


def test_kinds_intervals_and_dirty_ids(spark):
    nodes = [("A", T(1), None, "x"), (" b ", T(1), T(3), None), ("b", T(6), None, None), ("c", T(5), None, None), ("c", T(5), None, None), (None, T(1), None, None), ("d", T(1), T(2), None), ("d", T(1), None, None)]
    edges = [
        (1, " a", "B", T(2), None, "k"),  # both valid
        (2, "b", "c", T(4), None, None),  # b retired, c loaded later
        (3, "b", "z", T(7), None, None),  # b came back, z is unknown
        (4, None, "  ", T(7), None, None),  # no ids
        (5, "d", "d", T(4), None, None),  # of two rows from one day the longer one counts
        (6, "b", "a", T(3), None, None),  # retired on the day: no longer valid
        (7, "a", "a", None, None, None),  # no time: no parent can be valid
    ]
    assert found(spark, edges, nodes) == {("2", "src"): "deleted", ("2", "dst"): "late", ("3", "dst"): "missing", ("6", "src"): "deleted", ("7", "src"): "late", ("7", "dst"): "late"}


def test_empty_and_repeated(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a", None, T(1), None, None)] * 3, []) == {("1", "src"): "missing"}
    refs, par = tables(spark, [(1, "a", "b", T(1), None, None)] * 3, [])
    c = R.counts_by_month(R.classify(R.orphans(refs, par).distinct(), par)).collect()
    assert sorted((r["field"], r["month"], r["n_orphans"]) for r in c) == [("dst", "2023-01", 1), ("src", "2023-01", 1)]


def test_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    nodes, edges = [], []
    for _ in range(300):
        a = rnd.randint(1, 10)
        nodes.append((f"n{rnd.randint(0, 40)}", T(a), rnd.choice([None, T(a + rnd.randint(0, 2))]), None))
    for i in range(500):
        edges.append((i, f"n{rnd.randint(0, 50)}", f"N{rnd.randint(0, 3)} ", T(rnd.randint(1, 12)), None, None))
    want = set()
    for i, s, d, t, *_ in edges:
        for f, k in (("src", s), ("dst", d)):
            k = k.strip().lower()
            if not any(n[0] == k and n[1] <= t and (n[2] is None or n[2] > t) for n in nodes):
                want.add((str(i), f))
    assert set(found(spark, edges, nodes)) == want
