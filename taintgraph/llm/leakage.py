"""Evaluation texts leaking into training text, by q-gram counting in diagonal bands.

Texts are reduced to their words, joined by one blank. A window of ``w`` characters that occurs in a document within
``edits`` edits shares at least ``w - q + 1 - q * edits`` of its q-grams with it inside one band of ``edits + 1``
diagonals (the q-gram lemma). Documents stream past the q-grams of the items; hits are counted per (document, item,
band), bands overlapping by half so that a region never falls between two. Regions that reach the bound are verified by
banded alignment of the item against the document around the region's diagonals. Without edits the band is one
diagonal: the alignment gives the stretches in which both agree, and a stretch counts if it holds a run of whole words.

The items are a stated query set. Blocks of them, of at most ``block_chars`` characters, are indexed on the executors and
stored in the shared folder; every block meets every document, in a scan of its own. Documents are not shuffled.

Defined cases: null and blank texts and items have no words and leak nothing; repeated documents come out each under
its id; repeated items each under theirs; ties are all reported; texts of any length are read whole; empty tables give
empty results; extra columns are never read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgraph.llm.batches import parts
from taintgraph.session import cut

#: soft hyphen and zero-width characters, dropped before words are read (fixed values)
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_INVISIBLE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
_WORD = re.compile(r"[^\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii() and _INVISIBLE.search(text):
        text = text.translate(INVISIBLE)
    return _WORD.findall(text.lower())


def _grams(stream: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams of a character stream, by doubling."""
    total, h, width, base = None, stream.astype(np.uint64) + np.uint64(1), 1, _B
    done = 0
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                n = len(stream) - (done + width) + 1
                if n <= 0:
                    return np.empty(0, np.uint64)
                total = h[:n].copy() if total is None else total[:n] * base + h[done : done + n]
                done += width
            if done == q:
                break
            n = len(h) - width
            h = h[:n] * base + h[width : width + n]
            base = base * base
            width *= 2
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(29))


class ItemIndex:
    """q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], q: int, min_words: int):
        self.ids, self.q, self.min_words = ids, q, min_words
        self.words = [words(t) for t in texts]
        self.joined = [" ".join(w) for w in self.words]
        hashes, item, pos = [], [], []
        for k, t in enumerate(self.joined):
            g = _grams(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), q)
            hashes.append(g)
            item.append(np.full(len(g), k, np.int32))
            pos.append(np.arange(len(g), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.empty(0, np.int32)
        self.pos = np.concatenate(pos)[order] if pos else np.empty(0, np.int32)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.keys >> np.uint64(64 - self.bits)] = True
        # characters of the shortest run of min_words words of each item: no leak of the item is shorter
        self.shortest = np.array([min((len(" ".join(w[i : i + min_words])) for i in range(len(w) - min_words + 1)), default=1 << 30) for w in self.words], np.int64)
        self.points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in self.joined]


_BLANK = 32


def shared_words(item: np.ndarray, doc: np.ndarray, diagonal: int) -> int:
    """Most whole words in a stretch in which item[k] = doc[k + diagonal]: the alignment in a band of one diagonal."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if lo >= hi:
        return 0
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    most = 0
    for s, e in zip((edge[::2] + lo).tolist(), (edge[1::2] + lo).tolist()):
        if e - s <= most:
            continue
        blanks = np.flatnonzero(item[s:e] == _BLANK)
        n = len(blanks) + 1  # parts between blanks; the outer two are words only if both texts end them there
        if item[s] == _BLANK or (s and item[s - 1] != _BLANK) or (s + diagonal and doc[s + diagonal - 1] != _BLANK):
            n -= 1
        if len(blanks) or n:
            if item[e - 1] == _BLANK or (e < len(item) and item[e] != _BLANK) or (e + diagonal < len(doc) and doc[e + diagonal] != _BLANK):
                n -= 1
        most = max(most, n)
    return most


def window_within(item: np.ndarray, doc: np.ndarray, low: int, high: int, size: int, edits: int) -> bool:
    """Whether a window of ``size`` characters of the item occurs in the document within ``edits`` edits, beginning and
    ending on the diagonals from ``low`` to ``high``. All windows are aligned side by side."""
    size = min(size, len(item))
    n, band = len(item) - size + 1, high - low + 1
    start = np.arange(n)[:, None] + np.arange(low, high + 1)[None, :]  # document position at which each band column begins
    cost = np.where((start >= 0) & (start <= len(doc)), 0, edits + 1).astype(np.int16)
    padded = np.concatenate((doc, np.zeros(1, np.uint32)))
    for t in range(size):
        at = start + t
        other = np.where((at >= 0) & (at < len(doc)), padded[np.clip(at, 0, len(doc))], 0)
        new = cost + (item[t : t + n][:, None] != other)
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a character of the item that the document lacks
        for k in range(1, band):
            new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)  # one that only the document has
        cost = np.minimum(new, edits + 1)
        if cost.min() > edits:
            return False
    return bool((cost <= edits).any())


def _regions(index: ItemIndex, texts: list[str], need: np.ndarray, edits: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first and last diagonal) of bands with at least ``need[item]`` hits."""
    q = index.q
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    stream = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    g = _grams(stream, q)
    if not len(g) or not len(index.keys):
        return
    at = np.flatnonzero(index.maybe[g >> np.uint64(64 - index.bits)])
    k = np.minimum(np.searchsorted(index.keys, g[at]), len(index.keys) - 1)
    same = index.keys[k] == g[at]
    at, k = at[same], k[same]
    if not len(at):
        return
    doc = np.searchsorted(starts, at, side="right") - 1
    inside = at + q <= starts[doc] + lens[doc]
    at, k, doc = at[inside], k[inside], doc[inside]
    n = index.count[k]
    rep = np.repeat(np.arange(len(at)), n)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
    entry = index.first[k][rep] + nth
    local = (at - starts[doc])[rep]
    doc, item = doc[rep], index.item[entry].astype(np.int64)
    diag = local - index.pos[entry] + (1 << 20)
    width = edits + 1
    for shift in ((0,) if edits == 0 else (0, width)):
        band = (diag + shift) // (width if edits == 0 else 2 * width)
        # bands that cannot reach the bound leave before the sort: a bucket counts at least what each band in it does
        bucket = (((doc * len(index.ids) + item) * np.int64(0x9E3779B1) + band) * np.int64(0x9E3779B1) >> 7) & 0xFFFFF
        keep = np.flatnonzero(np.bincount(bucket, minlength=1 << 20)[bucket] >= need[item])
        if not len(keep):
            continue
        order = keep[np.lexsort((band[keep], item[keep], doc[keep]))]
        d, i, b = doc[order], item[order], band[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(d)))
        enough = size >= need[i[first]]
        wide = width if edits == 0 else 2 * width
        for f in first[enough].tolist():
            begin = int(b[f]) * wide - shift - (1 << 20)
            yield int(d[f]), int(i[f]), begin, begin + wide - 1


def _search(index: ItemIndex, min_chars: int, edits: int):
    shortest = np.maximum(index.shortest, min_chars) if not edits else np.full(len(index.ids), min_chars)
    need = shortest - index.q + 1 - index.q * edits
    if len(need) and need.min() < 1:
        raise ValueError("q is too long for this edit budget")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column(0).to_pylist()
            texts = part.column(1).to_pylist()
            got, points = set(), {}
            for d, i, low, high in _regions(index, texts, need, edits):
                if (d, i) in got:
                    continue
                if d not in points:
                    points[d] = np.frombuffer(texts[d].encode("utf-32-le", "surrogatepass"), np.uint32)
                if edits:
                    hit = window_within(index.points[i], points[d], low - edits, high + edits, min_chars, edits)
                else:
                    hit = shared_words(index.points[i], points[d], low) >= index.min_words
                if hit:
                    got.add((d, i))
            if got:
                rows = [(ids[d], index.ids[i]) for d, i in sorted(got)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id"])

    return run


def _blocks(q: int, min_words: int):
    """One group of items to a row: the block's index, pickled."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        index = ItemIndex(table.column("item_id").to_pylist(), table.column("text").to_pylist(), q, min_words)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": [pickle.dumps(vars(index))]})

    return run


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, edits: int = 0, q: int = 16, min_chars: int | None = None, block_chars: int = 4_000_000, rows_at_once: int = 256, chars_at_once: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id) of documents and items that share a run of ``min_words`` words (``edits`` = 0), or a window of
    ``min_chars`` characters within ``edits`` edits. A run of m words has at least 2 m - 1 characters."""
    spark = docs.sparkSession
    min_chars = min_chars or 2 * min_words - 1
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    keyed = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    blocks = cut(keyed.groupBy("block").applyInArrow(_blocks(q, min_words), "block int, data binary"), "items")
    out = None
    for k in range(n):
        # a block is one broadcast, of bounded size; a task holds one
        shared = spark.sparkContext.broadcast([r["data"] for r in blocks.where(F.col("block") == k).select("data").collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searches = []
            for data in shared.value:
                index = ItemIndex.__new__(ItemIndex)
                vars(index).update(pickle.loads(data))
                searches.append(_search(index, min_chars, edits))
            for b in batches:
                for part in parts(b, ["text"], rows_at_once, chars_at_once):
                    plain = pa.array([" ".join(words(t)) for t in part.column(1).to_pylist()], pa.string())
                    for search in searches:
                        yield from search(iter([pa.RecordBatch.from_arrays([part.column(0), plain], names=["doc_id", "text"])]))

        part = source.mapInArrow(run, "doc_id long, item_id long")
        out = part if out is None else out.union(part)
    return out.distinct()
