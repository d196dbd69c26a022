import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taintgraph.llm import split_overlap as S


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abc試𝒳", "CNO1()=c"])
def test_index_locates_every_occurrence(letters):
    rnd = random.Random(len(letters))
    texts = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(200)}) + ["", letters[0] * 300, letters[0] * 299]
    ix = S.FullTextIndex(texts)
    asked = ["".join(rnd.choice(letters + "z") for _ in range(rnd.randint(1, 5))) for _ in range(100)] + texts[:50] + [letters[0] * 298]
    flat, start, lens = S.code_points(asked)
    lo, hi = ix.search(ix.symbols(flat), start, lens)
    for a, x, y in zip(asked, lo.tolist(), hi.tolist()):
        want = sorted((k, i) for k, t in enumerate(texts) for i in range(len(t) - len(a) + 1) if t[i : i + len(a)] == a) if a else []
        t, o = ix.locate(np.arange(x, y))
        assert sorted(zip(t.tolist(), o.tolist())) == want


def test_matches_against_brute_force():
    rnd = random.Random(8)
    base = ["".join(rnd.choice("CNO1()=c") for _ in range(rnd.randint(1, 24))) for _ in range(40)]

    def near(t):
        x = list(t)
        for _ in range(rnd.randint(0, 3)):
            x[rnd.randrange(len(x))] = rnd.choice("CNO")
            if rnd.random() < 0.3:
                x.insert(rnd.randrange(len(x)), "F")
        return "".join(x)

    entries, asked = sorted({near(rnd.choice(base)) for _ in range(150)}), sorted({near(rnd.choice(base)) for _ in range(150)})
    ix = S.FullTextIndex(entries)
    for k in (0, 1, 2):
        got = {(int(q), int(e)): (int(s), int(c)) for part in S.matches(ix, asked, k, most=50) for q, e, s, c in zip(*part)}
        assert set(got) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(entries) if lev(a, b) <= k}
        for (q, e), (spans, chars) in got.items():
            n = len(asked[q])
            assert (spans, chars) == (1, n) if asked[q] == entries[e] else chars <= n and spans <= k + 1


def test_shards_of_pieces_as_in_plain_words(spark):
    rows = [(t, m) for t in ("", "a", "abcd", "abcdefghijk", "abcdefghijklm") for m in range(max(1, len(t) - 2), len(t) + 3)]
    x = spark.createDataFrame(rows, "text string, m int")
    n, k, subs = F.length("text"), F.lit(2), F.lit(1 << 30)
    got = x.select("text", "m", S._piece_hashes("text", n, F.col("m"), k, subs, True).alias("p"), S._piece_hashes("text", n, n, k, subs, False).alias("e")).collect()
    hashed = {}
    for r in got:
        hashed[r["text"], r["m"]] = (len(r["p"]), len(r["e"]))
        want = {(i, r["text"][s : s + z]) for o, i, s, z in S.probes(len(r["text"]), 2) if o == r["m"]}
        assert len(r["p"]) == len(want) and len(r["e"]) == len({(i, r["text"][s : s + z]) for i, (s, z) in enumerate(S.pieces(len(r["text"]), 2))})


def test_banded_alignment():
    rnd = random.Random(2)
    a = ["".join(rnd.choice("ab試") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    b = [x if rnd.random() < 0.2 else "".join(rnd.choice("ab試") for _ in range(rnd.randint(0, 12))) for x in a]
    for k in (0, 1, 2):
        assert S.within_edits(a, b, k).tolist() == [lev(x, y) <= k for x, y in zip(a, b)]
    assert S.within_edits([], [], 2).tolist() == []


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_pieces_and_probes_miss_nothing(edits):
    rnd = random.Random(edits)
    for _ in range(300):
        y = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
        x = list(y)
        for _ in range(rnd.randint(0, edits)):
            k = rnd.randrange(len(x) + 1)
            op = rnd.random()
            if op < 0.4 and x:
                del x[min(k, len(x) - 1)]
            elif op < 0.7:
                x.insert(k, rnd.choice("abc"))
            elif x:
                x[min(k, len(x) - 1)] = rnd.choice("abc")
        x = "".join(x)
        cut = [y[s : s + n] for s, n in S.pieces(len(y), edits)]
        assert any(o == len(y) and x[s : s + n] == cut[i] for o, i, s, n in S.probes(len(x), edits))


def overlapping(spark, rows, **kw):
    r = spark.createDataFrame(rows, "record string, side string, ik string, red string, fold string, source string, e string").withColumn("name", F.col("record"))
    return {(x["node_id_a"], x["node_id_b"]) for x in S.record_pairs(r, S.overlaps(r, **kw)).collect()}


def row(i, side, ik, red):
    return (i, side, ik, red, "train" if side == "train" else "test", "s", None)


def test_rules_nulls_and_repeats(spark):
    A, B = "A" * 14, "B" * 14
    long = "CCOc1ccccc1" * 300
    rows = [
        row("t1", "train", A, "CCCCCCCC"), row("t2", "train", None, "NNNNNNNNNN"), row("t3", "train", B, None), row("t4", "train", None, long), row("t5", "train", B, "OOOOOOOOOO"),
        row("e1", "eval", A, "XXXXXXXX"), row("e2", "eval", B, "NNNNNNNNCN"), row("e3", "eval", None, "CCCCCCCC"), row("e4", "eval", None, long[1:-1]), row("e5", "eval", A, "OOOOOOOOCC"), row("e6", "eval", None, None),
        row("t1", "eval", A, "CCCCCCCC"), row("e1", "eval", A, "XXXXXXXX"),
    ]
    got = overlapping(spark, rows)
    #: e5 is near t5, but both have keys; t1 is no pair with itself
    assert got == {("e1", "t1"), ("e2", "t3"), ("e2", "t5"), ("e2", "t2"), ("e3", "t1"), ("e4", "t4"), ("e5", "t1")}
    assert overlapping(spark, rows[:5]) == set() and overlapping(spark, []) == set()


def test_against_brute_force_and_counts(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(160):
        base = "".join(random.Random(rnd.randint(0, 40)).choice("CNO1()") for _ in range(25))
        red = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            red[rnd.randrange(len(red))] = rnd.choice("CNO")
        side = rnd.choice(["train", "eval"])
        rows.append(row(f"r{i:03}", side, rnd.choice([None, None, chr(65 + rnd.randint(0, 9)) * 14]), rnd.choice([None, "".join(red), "".join(red), "".join(red)])))
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] == "eval":
                if (a[2] and a[2] == b[2]) or (a[3] and b[3] and (a[3] == b[3] or (not (a[2] and b[2]) and lev(a[3], b[3]) <= 2))):
                    want.add(tuple(sorted((a[0], b[0]))))
    assert overlapping(spark, rows) == want
    assert overlapping(spark, rows, block_chars=200) == want
    assert overlapping(spark, rows, block_chars=60, stream_chars=300) == want
    r = spark.createDataFrame(rows, "record string, side string, ik string, red string, fold string, source string, e string")
    c = S.overlap_counts(r, S.overlaps(r)).collect()
    hit = {x for p in want for x in p if next(q for q in rows if q[0] == x)[1] == "eval"}
    assert sum(x["n_overlapping"] for x in c) == len(hit) and sum(x["n_records"] for x in c) == sum(q[1] == "eval" for q in rows)


def test_a_hot_piece_is_split_over_tasks(spark):
    """Most structures begin alike, so that one shard holds them all: its cells and lanes lose no pair."""
    rnd = random.Random(5)
    rows = [row(f"r{i:04}", "train" if i % 2 else "eval", None, ("C" * 12 if i % 3 else "") + "".join(rnd.choice("CNO1()=c") for _ in range(24 if i % 3 else 36))) for i in range(900)]
    r = spark.createDataFrame(rows, "record string, side string, ik string, red string, fold string, source string, e string").withColumn("name", F.col("record"))
    got = S.overlaps(r, block_chars=2_000, stream_chars=5_000)
    want = {(a[3], b[3]) for a in rows if a[1] == "eval" for b in rows if b[1] == "train" and abs(len(a[3]) - len(b[3])) <= 2 and lev(a[3], b[3]) <= 2}
    assert {(x["eval_text"], x["train_text"]) for x in got.collect()} == want


def test_spelling_of_ids(spark, tmp_path):
    """Ids compare without case and blanks, and come out as the side table spells them; pairs are ordered by that."""
    from taintgraph.llm import queries

    side = spark.createDataFrame([("src:B", "s", None, "CCCCCC"), (" src:a ", "s", None, "CCCCCC"), ("SRC:b", "s", None, "CCCCCC")], "example_id string, source string, inchikey string, smiles_canonical string")
    side.write.parquet(f"{tmp_path}/side_table.parquet")
    spark.createDataFrame([("ex:SRC:A", "Train", "random"), ("EX:src:b", "test", "random")], "node_id string, fold string, protocol string").write.parquet(f"{tmp_path}/split_result.parquet")
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [("ex:SRC:b", "ex:src:a")]


def test_very_long_texts(spark):
    rnd = random.Random(6)
    t = "".join(rnd.choice("CNO1()=c") for _ in range(60_000))
    rows = [row("t1", "train", None, t), row("e1", "eval", None, t[:40_000] + "F" + t[40_001:]), row("e2", "eval", None, t[:30_000] + t[30_003:]), row("e3", "eval", None, "CC")]
    assert overlapping(spark, rows) == {("e1", "t1")}
