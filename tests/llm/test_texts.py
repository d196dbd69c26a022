import random

import numpy as np
import pytest

from taintgraph.llm import encoding, leakage, residue

TOK = pytest.importorskip("tokenizers")
ODD = [
    None, "", " ", "a", "Hello world", "  two  blanks \n\n tab\t", "don't we'll I'VE they're", "<|endoftext|> is text", "naïve Å-scale étude", "試験用データ 9 件", "😀🧪🧬 👩‍🔬", "‮abc‬", "x" * 3000, "a" * 7 + " " * 9 + "b",
    "0123456789 " * 50, "ﬁne ½ ⅔ 9٫9", "\r\n\r\n", "aaaa bbbb aaaa", "\x00\x01", "é", " x", "𝛼𝛽𝛾",
]


@pytest.fixture(scope="module")
def reference_tokenizer():
    import os

    if not os.path.exists(encoding.TOKENIZER):
        pytest.skip("no tokenizer files here")
    t = TOK.Tokenizer.from_file(encoding.TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_tokenizers(spark, reference_tokenizer):
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD)] + [(3, "a", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, path string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encoding.encode(df, "doc_id", "text").collect())
    want = sorted((i, reference_tokenizer.encode(t, add_special_tokens=False).ids if t else []) for i, t, *_ in rows)
    assert got == want
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0


def test_replay_forgets_and_repeats(reference_tokenizer):
    replay = encoding.MergeReplay(*encoding.load_merges(), keep=10)
    rnd = random.Random(1)
    for _ in range(20):
        texts = [" ".join(rnd.choice(["alpha", "beta", "gam ma", "δελτα", "x" * rnd.randint(1, 40), str(rnd.random())]) for _ in range(rnd.randint(0, 30))) for _ in range(5)]
        offsets, ids = replay.encode(texts)
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids


def leaked(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], "doc_id long, text string, item_id string, n long")
    i = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i, **kw).collect()}


def brute(docs, items, m):
    runs = lambda t: {tuple(w[k : k + m]) for w in [leakage.words(t)] for k in range(len(w) - m + 1)}
    return {(d, i) for d, t in docs for i, u in items if runs(t) & runs(u)}


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["a", "I", "it", "über", "protein", "IC50", "9", "scaffold", "x1", "試験"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "a b c"), (93, "a " * 30), (94, "a " * 30)]
    docs = []
    for d in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 200))]
        if d % 2:
            w = (items[rnd.randrange(30)][1]).split()
            k = rnd.randint(9, 15)
            s = rnd.randrange(max(1, len(w) - k))
            at = rnd.randrange(len(t) + 1)
            sep = rnd.choice(["  ", ", ", "\n", "-", " «"])
            t[at:at] = [sep.join(x.upper() if rnd.random() < 0.3 else x[:1] + "­​" + x[1:] for x in w[s : s + k])]
        docs.append((d, " ".join(t)))
    docs += [(900, None), (901, ""), (902, "A, " * 12), (903, docs[1][1]), (903, docs[1][1]), (904, "q " * 100_000 + items[0][1])]
    assert leaked(spark, docs, items) == brute(docs, items, 12)
    assert leaked(spark, docs, items, block_chars=300) == brute(docs, items, 12)
    assert leaked(spark, [], items) == set() and leaked(spark, docs, []) == set()


def test_leaks_within_edits(spark):
    item = "the passage claims that a noisy parent key narrows the random split within one publication yet the table lists nothing"
    near = item.replace("noisy", "noisi").upper()
    docs = [(1, "before " + near + " after"), (2, "nothing of the kind here at all, only other words that go on and on for a while"), (3, item)]
    assert leaked(spark, docs, [(7, item)], edits=2, q=8, min_chars=60) == {(1, 7), (3, 7)}


def test_alignment_on_one_diagonal_counts_whole_words():
    at = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    rnd = random.Random(11)
    for _ in range(400):
        a, b = (" ".join(rnd.choice(["a", "ab", "abc", "b", "試"]) for _ in range(rnd.randint(1, 9))) for _ in range(2))
        wa, wb = a.split(" "), b.split(" ")
        runs = {tuple(wa[i:j]) for i in range(len(wa)) for j in range(i + 1, len(wa) + 1)} & {tuple(wb[i:j]) for i in range(len(wb)) for j in range(i + 1, len(wb) + 1)}
        got = max(leakage.shared_words(at(a), at(b), d) for d in range(-len(a), len(b) + 1))
        assert got == max(map(len, runs), default=0), (a, b)


def test_windows_within_edits_against_brute_force():
    at = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    rnd = random.Random(12)
    for _ in range(150):
        item, doc = ("".join(rnd.choice("ab") for _ in range(rnd.randint(4, 9))) for _ in range(2))
        k, size = rnd.choice([1, 2]), 4
        want = any(lev(item[i : i + size], doc[s:e]) <= k for i in range(len(item) - size + 1) for s in range(len(doc) + 1) for e in range(s, len(doc) + 1))
        assert leakage.window_within(at(item), at(doc), -len(item), len(doc), size, k) == want, (item, doc, k)


EVIDENCE = [
    "TODO: write this section", "Sample text goes here.", "Your introduction here. Two or three sentences.", "Texte à compléter par l'auteur.", "Escriba aquí la descripción del ensayo.", "[Abstract goes here]",
    "Lorem ipsum amet sit nostrud eiusmod tempor.", "text text text text text", "xxx xxx xxx xxx", "404 Not Found", "Plates were read. Oops! Plates again.", "Traceback (most recent call last):\n  File \"a.py\", line 3", "Access denied.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "You need to enable JavaScript to run this app.", "Seite nicht gefunden (Fehler 404).", "Ki was {{ value }} nM.", "Ki was ${ki} nM.", "Ki was __KI__ nM.", "Ki was @@KI@@ nM.", "Ki was [INSERT KI HERE] nM.",
    "Ki was NaN nM.", "Ki was {ki} nM.", "Ki was <your value> nM.", "Ki was «value» nM.", "Ki was %(ki)s nM.", "Ki was [[KI]] nM.", "Ki was #REF! nM.", "Ki was [object Object] nM.", "{\"error\": {\"code\": 500}}", "このページを表示するには JavaScript を有効にしてください。",
    "asdf asdf jkl asdf", "Ki was $COMPOUND_NAME$ nM.", "We hit a snag Unexpected token in response at position 7.",
]
CLEAN = [
    None, "", " \n", "The SMARTS [#6]~[#7] and the props {\"tanimoto\": 0.9} were checked by hand.", "The report generator fills {{ target_name }} from the accession table and escapes it before output.", "A 404 Not Found from the mirror was retried three times.",
    "Users were told “please enable JavaScript” by the former portal; the new one is static.", "Lorem ipsum stood in the first layout and was replaced by the authors.", "Set notation such as {A, B} and $\\mathrm{IC}_{50}$ is used.", "NaN is returned by the metric when a fold holds one class only, as intended.",
    "c1c(CC)[nH]c(NC)c1 has no slot.", "<b>bold</b> and <br> are markup.", "Errors of the fit stayed below 5 %.", "x < y and y > z for all of them", "Prices rose from $40 to $50 and $A$ is a set.",
]


def test_residue_cases(spark):
    rows = [(i, "h" if i % 3 else None, t, "x") for i, t in enumerate(EVIDENCE + CLEAN)] + [(0, None, EVIDENCE[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string, line string")
    got = [r["doc_id"] for r in residue.residue(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set(range(len(EVIDENCE))), [(EVIDENCE + CLEAN)[i] for i in set(got) ^ set(range(len(EVIDENCE)))]
    assert residue.residue(df.limit(0)).count() == 0


def test_evidence_next_to_talk_and_in_long_texts(spark):
    talk = "Users were told “please enable JavaScript” by the former portal; the new one is static."
    rows = [(1, "h", f"{talk} Access denied. {talk}"), (2, "h", f"Re-ran with NaN replicates (all gone :) {talk}"), (3, "h", "Plain words. " * 20_000 + "Ki was {{ ki }} nM."), (4, "h", talk * 50)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == {1, 3} | {2}


def test_boilerplate_of_a_host_is_subtracted(spark):
    rows = [(i, "site", f"<noscript>Please enable scripts</noscript>\nRecord {i} was measured.") for i in range(40)] + [(100, "site", "<noscript>Please enable scripts</noscript>\nAccess denied."), (101, "other", "<noscript>Please enable scripts</noscript>\nRecord.")]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == {100, 101}


def test_small_hosts_and_plain_lines(spark):
    """The share is judged by the lower end of its interval, at every size of a host alike."""
    banner = "Turn JavaScript on to use the menu"
    rows = [(i, "small", f"Home | Search\n{banner}\nRecord {i} was measured.") for i in range(3)]  # 3 of 3
    rows += [(10 + i, "split", (f"{banner}\n" if i == 0 else "") + f"Record {i} was measured.") for i in range(3)]  # 1 of 3
    rows += [(100 + i, "large", (f"{banner}\n" if i % 2 else "") + f"Plate {'abcdefghij'[i % 10] * (i // 10 + 1)} was read.") for i in range(200)]  # half
    rows += [(400, "small", f"Home | Search\n{banner}"), (401, "large", f"{banner}\nAccess denied.")]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == {10, 400, 401}
    assert {r["doc_id"] for r in residue.residue(df, subtract=False).collect()} == {0, 1, 2, 10, 400, 401} | {100 + i for i in range(1, 200, 2)}
    assert residue.host_boilerplate(df).count() == 3  # the two lines of the small host, the banner of the large one


def test_recurring_evidence_is_not_boilerplate(spark):
    h = "<noscript>Please enable scripts</noscript>"
    rows = [(i, "copies", "404 Not Found") for i in range(20)] + [(100 + i, "copies", f"Record {i} was measured.") for i in range(20)]
    rows += [(200 + i, "ids", f"404 Not Found\nRequest {i}") for i in range(20)] + [(300 + i, "slots", f"Record {i} was measured.\nKi was {{{{ ki }}}} nM.") for i in range(20)]
    rows += [(400 + i, "shells", h) for i in range(20)] + [(500 + i, "shells", f"{h}\nRecord {i} was measured.") for i in range(40)]
    rows += [(600 + i, "spans", f"<noscript>\nPlease enable scripts\n</noscript>\nRecord {i} was measured.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == {k + i for k in (0, 200, 300, 400) for i in range(20)}
