import pyarrow as pa

from taintgraph.llm.batches import parts


def test_parts_cover_all_rows_in_order():
    texts = ["a" * n for n in (3, 0, 5, 50, 1, 1, 1)] + [None, "試" * 4]
    b = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    got = list(parts(b, ["t"], 3, 8))
    assert [x for p in got for x in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 8) for p in got)
    assert list(parts(b.slice(0, 0), ["t"], 3, 8)) == []
