"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Records of equal token sets are one class with a membership table. Every tree sends a class down a path of tokens of its
own set: at each node it follows the token with the smallest rank under a hash shared by all records at that node, so two
records stay together with the probability of their Jaccard similarity. After ``depth`` tokens the records of a node are
compared by brute force if there are at most ``node_limit``. A larger node is split again, now into ``BRANCHES`` branches
per record, which a pair at the threshold t survives with probability ``1 - (1 - t) ** BRANCHES``; that is part of the number of trees, so the
declared recall holds for pairs that go through ``max_splits`` splits too. A node whose branches are no smaller than half of
it holds nearly equal sets, which further splits would only copy: its records are compared exactly, in pairs of blocks of
``node_limit`` records, one bounded task run each. So are nodes that are still too large after ``max_splits`` splits.

Trees are repeated until a pair at the threshold is met with probability ``recall``. Candidates are screened by a bound
that loses nothing (the parity sketches of two sets differ in at most as many bits as the sets differ in tokens) and then
verified exactly on the whole texts.

A path that a large part of all records takes is not gathered in one task: once a task has seen more than ``node_limit`` rows of it, the others
travel apart and meet only in the splits.

What moves between executors is 40 bytes per record and tree. A record's own paths need no other record, so the only
shuffles are one by path, one for distinct candidates and the sort-merge joins that fetch the texts of the candidates.

Defined cases: null and blank values and values shorter than one token are no records; equal texts are one record;
texts of equal token sets are a pair of similarity 1; any characters are allowed; a pair comes out once, the smaller
text id first; empty input gives no pairs; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgraph.llm.batches import parts
from taintgraph.session import cut

_M1, _M2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_ROWS, _CHARS = 8192, 1_000_000
#: branches of a record where a node is split again
BRANCHES = 4


def _mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser, in place."""
    x ^= x >> np.uint32(16)
    x *= _M1
    x ^= x >> np.uint32(13)
    x *= _M2
    x ^= x >> np.uint32(16)
    return x


def shingle_keys(texts: list[str], q: int) -> tuple[np.ndarray, bool]:
    """Sorted distinct keys ``row << 42 | token`` of all substrings of q characters, and whether tokens are exact.

    A token of plain ASCII with q <= 6 is packed into 42 bits; any other is hashed into them. At most 2^21 texts."""
    joined = "".join(texts)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    exact = joined.isascii() and q <= 6
    if not len(joined):
        return np.empty(0, np.uint64), exact
    if joined.isascii():
        chars = np.frombuffer(joined.encode("ascii"), np.uint8).astype(np.uint64)
    else:
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64), exact
    # how a token is coded depends on its characters alone, whatever texts stand beside it
    code, packed = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if q <= 6:
        for k in range(q):
            packed = (packed << np.uint64(7)) | chars[k : k + n]
    if not exact:
        for k in range(q):
            code = (code ^ chars[k : k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code >>= np.uint64(22)
    if q <= 6:
        odd = np.concatenate(([0], np.cumsum(chars > 127)))
        code = packed if exact else np.where(odd[q:] == odd[:-q], packed, code)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lens)[:n]
    inside = np.arange(n) + q <= ends[row.astype(np.int64)]
    key = (row[inside] << np.uint64(42)) | code[inside]
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key, exact


def _signatures(texts: list[str], q: int) -> tuple[np.ndarray, ...]:
    """(rows that have tokens, token hashes, start of each row's tokens, set size, parity sketch low, high)."""
    key, _ = shingle_keys(texts, q)
    row = (key >> np.uint64(42)).astype(np.int64)
    rows, start, size = np.unique(row, return_index=True, return_counts=True)
    tok = key & np.uint64((1 << 42) - 1)
    tok = _mix((tok ^ (tok >> np.uint64(21)) * np.uint64(0x9E3779B1)).astype(np.uint32))
    if not len(rows):
        e = np.empty(0, np.uint64)
        return rows, tok, start, size, e, e
    bit = tok >> np.uint32(25)
    one = np.left_shift(np.uint64(1), (bit & np.uint32(63)).astype(np.uint64))
    high = bit >= 64
    return rows, tok, start, size, np.bitwise_xor.reduceat(np.where(high, np.uint64(0), one), start), np.bitwise_xor.reduceat(np.where(high, one, np.uint64(0)), start)


def _step(tok: np.ndarray, start: np.ndarray, size: np.ndarray, path: np.ndarray, branch: int) -> np.ndarray:
    """The next node of each row: its path so far joined with the token of smallest rank there. ``path``: 64 bits."""
    seed = _mix((path ^ (path >> np.uint64(32))).astype(np.uint32) + np.uint32(0x9E3779B9 * (branch + 1) & 0xFFFFFFFF))
    rank = _mix(tok ^ np.repeat(seed, size))
    low = np.minimum.reduceat(rank, start)
    nxt = (path ^ (low.astype(np.uint64) + np.uint64(branch))) * np.uint64(0x9E3779B97F4A7C15)
    return nxt ^ (nxt >> np.uint64(31))


#: ``n`` holds the set size and, from bit ``UP`` on, the binary logarithm of the size of the node above
_PATHS = pa.schema([("path", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
_PATHS_DDL = "path long, h long, n long, s1 long, s2 long"
UP = 40


def _set_keys(q: int):
    """Adds 128 bits that depend on the token set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "s"):
            key, _ = shingle_keys(b.column("s").to_pylist(), q)
            rows, start = np.unique((key >> np.uint64(42)).astype(np.int64), return_index=True)
            tok, out = key & np.uint64((1 << 42) - 1), []
            for m in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
                x = (tok + np.uint64(1)) * m
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
                full = np.zeros(b.num_rows, np.uint64)
                if len(rows):
                    full[rows] = np.add.reduceat(x, start)
                out.append(pa.array(full.view(np.int64)))
            yield b.append_column("k1", out[0]).append_column("k2", out[1])

    return run


def _slices(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from parts(b, list(texts), _ROWS, _CHARS)


#: what stands in ``n`` of a row that says that its node is large, and, less the logarithm of the node above, of one that
#: belongs to a large node, whose path stands in place of the sketch
_LARGE, _DIVERTED = -1, -2


class Diversion:
    """Keeps large nodes from gathering in one task. Rows per path are tallied in a fixed table of counters, so that no
    path is underrated. Once a path has more than ``limit`` rows in this task, further rows of it go by a path of their own, to be
    passed on for splitting wherever they land, and a marker tells the node's task that the node is large."""

    BITS = 20

    def __init__(self, limit: int):
        self.limit, self.counts, self.told = limit, np.zeros(1 << self.BITS, np.int64), set()

    def __call__(self, path, h, size, s1, s2, up) -> tuple[np.ndarray, ...]:
        n = size | up << UP
        slot = (path >> np.uint64(64 - self.BITS)).astype(np.int64)
        name, inverse, rows = np.unique(slot, return_inverse=True, return_counts=True)
        self.counts[name] += rows
        over = (self.counts[name] > self.limit)[inverse]
        if not over.any():
            return path, h, n, s1, s2
        new = [x for x in np.unique(path[over]).tolist() if x not in self.told]
        self.told.update(new)
        own = (path ^ h.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mark = np.array(new, np.uint64)
        zero = np.zeros(len(new), np.uint64)
        return (
            np.concatenate((np.where(over, own ^ (own >> np.uint64(32)), path), mark)),
            np.concatenate((h, zero.view(np.int64))),
            np.concatenate((np.where(over, _DIVERTED - up, n), np.full(len(new), _LARGE))),
            np.concatenate((np.where(over, path, s1), zero)),
            np.concatenate((s2, zero)),
        )


def _emit(path, h, n, s1, s2) -> pa.RecordBatch:
    cols = [path.view(np.int64), h, n, s1.view(np.int64), s2.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_PATHS)


def _first_paths(q: int, trees: int, depth: int, limit: int = 1 << 62):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divert = Diversion(limit)
        for b in _slices(batches, "s"):
            rows, tok, start, size, s1, s2 = _signatures(b.column("s").to_pylist(), q)
            if not len(rows):
                continue
            h, up = b.column("h").to_numpy()[rows], np.zeros(len(rows), np.int64)
            for t in range(trees):
                path = np.full(len(rows), (t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
                for _ in range(depth):
                    path = _step(tok, start, size, path, 0)
                yield _emit(*divert(path, h, size, s1, s2, up))

    return run


def _next_paths(q: int, branches: int, limit: int = 1 << 62):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divert = Diversion(limit)
        for b in _slices(batches, "s"):
            rows, tok, start, size, s1, s2 = _signatures(b.column("s").to_pylist(), q)
            if not len(rows):
                continue
            h, at, up = b.column("h").to_numpy()[rows], b.column("path").to_numpy()[rows].view(np.uint64), b.column("up").to_numpy()[rows].astype(np.int64)
            if not branches:  # as they are, to be compared
                yield _emit(at, h, size | up << UP, s1, s2)
            for k in range(branches):
                yield _emit(*divert(_step(tok, start, size, at, k + 1), h, size, s1, s2, up))

    return run


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path", pa.int64()), ("up", pa.int32())])


def _compare(path, h, n, s1, s2, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Screened pairs within runs of equal path; ``path`` is sorted."""
    idx = np.arange(len(path))
    k = 0
    while len(idx):
        k += 1
        idx = idx[idx + k < len(path)]
        idx = idx[path[idx] == path[idx + k]]
        j = idx + k
        na, nb = n[idx], n[j]
        total = na + nb
        # sets of J >= num/den share at least total * num / (num + den) tokens, and so differ in at most the others
        most = total - 2 * (-(-total * num // (num + den)))
        ok = (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (h[idx] != h[j])
        ok[ok] = (np.bitwise_count(s1[idx[ok]] ^ s1[j[ok]]).astype(np.int64) + np.bitwise_count(s2[idx[ok]] ^ s2[j[ok]])) <= most[ok]
        if ok.any():
            a, b = h[idx[ok]], h[j[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], schema=_OUT)


def _nodes(num: int, den: int, limit: int | None):
    """Reads rows sorted by path; yields candidate pairs of small nodes, and the rows (a = record) of larger nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        passed = lambda h, path, up: pa.RecordBatch.from_arrays([pa.array(h), pa.nulls(len(h), pa.int64()), pa.array(path), pa.array(up.astype(np.int32))], schema=_OUT)
        passing = None  # path of a node known to be too large: its rows go through without being held

        def flush(cols):
            path = cols[0]
            cuts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
            runs = np.diff(np.append(cuts, len(path)))
            marker = cols[2] == _LARGE
            big = np.repeat((runs > limit) | np.logical_or.reduceat(marker, cuts), runs) if limit else np.zeros(len(path), bool)
            if big.any():
                cols, path, big, runs = [c[~marker] for c in cols], path[~marker], big[~marker], runs - np.add.reduceat(marker, cuts)
                yield passed(cols[1][big], path[big], cols[2][big] >> UP)
                cols = [c[~big] for c in cols]
            pairable = np.repeat(runs > 1, runs)[~big]
            cols = [c[pairable] for c in cols]
            yield from _compare(cols[0], cols[1], cols[2] & ((1 << UP) - 1), cols[3].view(np.uint64), cols[4].view(np.uint64), num, den)

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("path", "h", "n", "s1", "s2")]
            away = cols[2] <= _DIVERTED
            if away.any():
                yield passed(cols[1][away], cols[3][away], _DIVERTED - cols[2][away])
                cols = [c[~away] for c in cols]
                if not len(cols[0]):
                    continue
            if passing is not None:
                same = cols[0] == passing
                cols = [c[~(same & (cols[2] == _LARGE))] for c in cols]
                same = cols[0] == passing
                if same.any():
                    yield passed(cols[1][same], cols[0][same], cols[2][same] >> UP)
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    continue
                passing = None
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # start of the run that may go on
            if last:
                yield from flush([c[:last] for c in cols])
            held = [c[last:] for c in cols]
            if limit and len(held[0]) > limit:
                passing = held[0][0]
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    return run


def _verify(q: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "ta", "tb"):
            ta, tb = b.column("ta").to_pylist(), b.column("tb").to_pylist()
            ka, exact = shingle_keys(ta, q)
            kb, exact_b = shingle_keys(tb, q)
            if exact and exact_b:
                both = np.concatenate((ka, kb))
                both.sort()
                shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(42)).astype(np.int64), minlength=len(ta))
                size = np.bincount((both >> np.uint64(42)).astype(np.int64), minlength=len(ta))
            else:
                sa = [{t[i : i + q] for i in range(len(t) - q + 1)} for t in ta]
                sb = [{t[i : i + q] for i in range(len(t) - q + 1)} for t in tb]
                shared = np.array([len(x & y) for x, y in zip(sa, sb)])
                size = np.array([len(x) + len(y) for x, y in zip(sa, sb)])
            ok = (shared * den >= (size - shared) * num) & (shared > 0)
            yield b.filter(pa.array(ok)).append_column("shared", pa.array(shared[ok])).append_column("joint", pa.array((size - shared)[ok]))

    return run


def n_trees(threshold: float, recall: float, depth: int, max_splits: int) -> int:
    """Trees so that a pair at the threshold meets with probability ``recall``, through ``max_splits`` splits too."""
    together = threshold**depth * (1 - (1 - threshold) ** BRANCHES) ** max_splits
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def _blocks(big: DataFrame, node_limit: int) -> DataFrame:
    """Rows (path, h, up) of large nodes, once for every pair of blocks that holds their own; a pair of blocks is a node."""
    n = big.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / node_limit).cast("int").alias("blocks"))
    x = big.join(n, "path").withColumn("mine", F.pmod(F.xxhash64("h", "path"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return x.select(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), "h", "up")


def _candidates(lig: DataFrame, num: int, den: int, q: int, trees: int, depth: int, node_limit: int, max_splits: int) -> DataFrame:
    """(a, b) distinct candidates among the records (h, s)."""

    def compared(paths: DataFrame, limit: int | None) -> DataFrame:
        return cut(paths.repartition("path").sortWithinPartitions("path").mapInArrow(_nodes(num, den, limit), "a long, b long, path long, up int"), "nodes")

    paths, found = lig.select("h", "s").mapInArrow(_first_paths(q, trees, depth, node_limit), _PATHS_DDL), None
    for k in range(max_splits + 1):
        out = compared(paths, node_limit)
        pairs = out.where("b is not null").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        big = out.where("b is null").select("path", F.col("a").alias("h"), "up")
        if not big.limit(1).count():
            break
        size = big.groupBy("path").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("now"))
        big = big.join(size, "path")
        stuck = (F.col("up") > 0) & (F.col("now") >= F.col("up")) if k < max_splits else F.lit(True)
        cells = _blocks(big.where(stuck).select("path", "h", "up"), node_limit)
        found = found.union(compared(cells.join(lig.hint("merge"), "h").select("path", "h", "s", "up").mapInArrow(_next_paths(q, 0), _PATHS_DDL), None).select("a", "b"))
        if k < max_splits:
            paths = big.where(~stuck).select("path", "h", F.col("now").alias("up")).join(lig.hint("merge"), "h").select("path", "h", "s", "up").mapInArrow(_next_paths(q, BRANCHES, node_limit), _PATHS_DDL)
    return found.distinct()


def similar_pairs(
    records: DataFrame, text: str, threshold: float = 0.7, q: int = 6, recall: float = 0.9995, depth: int = 3, node_limit: int = 2000, max_splits: int = 8
) -> DataFrame:
    """(ta, tb, shared, joint): pairs of different texts whose sets of q-character substrings have a Jaccard
    similarity of at least ``threshold``. Pairs of one class, and of members of two similar classes, come out each."""
    ratio = Fraction(str(threshold))
    num, den = ratio.numerator, ratio.denominator
    texts = records.select(F.col(text).alias("s")).where(f"length(s) >= {q}").distinct().select("s", F.xxhash64("s").alias("h"))
    lig = cut(texts.mapInArrow(_set_keys(q), "s string, h long, k1 long, k2 long"), "records")
    classes = lig.groupBy("k1", "k2").agg(F.min("h").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # (rep, h) of the records that another one stands for
    members = cut(lig.join(classes, ["k1", "k2"]).where("h <> rep").select("rep", "h"), "members")
    reps = lig.join(members.select("h"), "h", "left_anti").select("h", "s")
    cand = _candidates(reps, num, den, q, n_trees(threshold, recall, depth, max_splits), depth, node_limit, max_splits)
    if members.limit(1).count():
        cand = cut(cand, "candidates")
        for end, other in (("a", "b"), ("b", "a")):
            cand = cand.union(cand.join(members.select(F.col("rep").alias(end), F.col("h").alias("to")), end).select(*[(F.col("to") if c == end else F.col(other)).alias(c) for c in ("a", "b")]))
        own, again = members.select("rep", F.col("h").alias("x")), members.select("rep", F.col("h").alias("y"))
        inside = own.select(F.col("rep").alias("a"), F.col("x").alias("b")).union(own.join(again, "rep").where("x < y").select("x", "y"))
        cand = cand.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda i: lig.select(F.col("h").alias(i), F.col("s").alias(f"t{i}")).hint("merge")
    return cand.join(side("a"), "a").join(side("b"), "b").select("ta", "tb").mapInArrow(_verify(q, num, den), "ta string, tb string, shared long, joint long")
