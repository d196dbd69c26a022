"""Same or nearly the same records across splits, by a compressed full-text index of the evaluation side.

The distinct keys and structures of the evaluation side are laid out in shards. A shard indexes its whole texts: their
Burrows-Wheeler text as a wavelet matrix, with a sampled suffix array. Training texts stream through a shard by backward
search: a text is read in ``edits + 1`` pieces, of which, by the pigeonhole principle, one stands unchanged and nearly at
its place in every text within ``edits`` changes. Each occurrence found is carried on to a maximal match, the matches of a pair of texts are
merged into spans and counted, and pairs that a bound on their pairs of neighbouring characters does not rule out are
verified by banded alignment.

A shard holds texts of one length. Where the texts of a length exceed ``block_chars``, they are spread over shards by the
hash of their pieces, and a training text visits only the shards of the substrings that can equal such a piece; so a text
has a bounded number of shards however many there are. A shard that a common piece still fills beyond that is split
into cells, and one that too many training texts visit is copied into lanes: a task holds at most ``block_chars``
characters of index and reads about ``stream_chars`` of training text.

Defined cases: missing or blank keys and structures never agree; equal structures are one text; any characters and any
length are allowed; repeated records and folds count once; a record is no pair with itself; an empty side gives no
matches; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgraph.session import cut, discard


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, start of each, length of each)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return flat, np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64), lens


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1])).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.upto[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FullTextIndex:
    """A compressed full-text index over texts: wavelet matrix of the Burrows-Wheeler text, every ``sample``-th position
    of each text kept for locating. Each text ends in a mark of its own, so no match runs over its end."""

    def __init__(self, texts: list[str], sample: int = 4):
        flat, start, lens = code_points(texts)
        self.texts, self.lens, self.flat, self.start = texts, lens, flat, start
        self.alphabet, sym = np.unique(flat, return_inverse=True)
        n = len(flat) + len(texts)
        self.n = n
        at = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lens)  # a mark follows each text
        seq = np.zeros(n, np.int64)  # 0 is the mark
        seq[at] = sym + 1
        self.first_at = start + np.arange(len(texts))
        sa = self._suffix_array(seq, len(self.alphabet) + 1, int(lens.max(initial=0)))
        bwt = seq[sa - 1]  # before the first text stands the last mark
        count = np.bincount(seq, minlength=len(self.alphabet) + 1)
        self.first = np.concatenate(([0], np.cumsum(count)[:-1]))
        self.count = count
        offset = np.zeros(n, np.int64)
        offset[at] = np.arange(len(flat)) - np.repeat(start, lens)
        kept = (seq[sa] > 0) & (offset[sa] % sample == 0)
        self.kept, self.position = Bits(kept), sa[kept].astype(np.int32)
        self.levels, self.zeros = [], []
        cur = bwt
        for b in range(max(1, int(len(self.alphabet)).bit_length()) - 1, -1, -1):
            bit = (cur >> b) & 1
            self.levels.append((b, Bits(bit)))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        self.base = self._descend(np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, np.int64))

    @staticmethod
    def _suffix_array(seq: np.ndarray, sigma: int, longest: int) -> np.ndarray:
        """By doubling; a text's mark sorts before everything, and equal ends of texts by the order of the texts."""
        n = len(seq)
        width = max(1, int(sigma).bit_length())
        k = max(1, min(62 // width, longest + 1))
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):
            here = np.zeros(n, np.int64)
            here[: n - i if i < n else 0] = seq[i:]
            key = (key << width) | np.where(open_, here, 0)
            open_ &= here > 0
        sa = np.argsort(key, kind="stable")
        sorted_key, ended = key[sa], ~open_[sa]
        fresh = np.concatenate(([True], (sorted_key[1:] != sorted_key[:-1]) | ended[1:]))
        rank = np.empty(n, np.int64)
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[sa] = group
        while True:
            last = np.append(fresh[1:], True)
            tied = np.flatnonzero(~(fresh & last))
            if not len(tied):
                return sa
            mine = sa[tied]
            nxt = np.minimum(mine + k, n - 1)  # a tied suffix is longer than k
            order = np.lexsort((rank[nxt], group[tied]))
            mine = mine[order]
            second, g = rank[nxt][order], group[tied]
            sa[tied] = mine
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (second[1:] != second[:-1])))
            fresh[tied] = new
            group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
            rank[mine] = group[tied]
            k *= 2

    def _descend(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for (b, bits), zero in zip(self.levels, self.zeros):
            ones = bits.rank(pos)
            pos = np.where((sym >> b) & 1, zero + ones, pos - ones)
        return pos

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the Burrows-Wheeler text."""
        return self._descend(sym, pos) - self.base[sym]

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        """Index symbols of characters; -1 for those no text holds."""
        if not len(self.alphabet):
            return np.full(len(flat), -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == flat, at + 1, -1)

    def search(self, sym: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the substrings ``sym[start : start + size]``, by backward search side by side."""
        m = len(start)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.flatnonzero(size > 0)
        hi[size <= 0] = 0
        step = 0
        while len(live):
            s = sym[start[live] + size[live] - 1 - step]
            dead = s < 0
            if dead.any():
                hi[live[dead]] = lo[live[dead]]
                live, s = live[~dead], s[~dead]
            if step == 0:
                lo[live], hi[live] = self.first[s], self.first[s] + self.count[s]
            else:
                both = self.rank(np.concatenate((s, s)), np.concatenate((lo[live], hi[live])))
                lo[live], hi[live] = self.first[s] + both[: len(s)], self.first[s] + both[len(s) :]
            step += 1
            live = live[(lo[live] < hi[live]) & (size[live] > step)]
        return lo, hi

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, offset) of rows whose suffix begins inside a text."""
        rows, back = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.kept.get(rows))
        while len(walk):
            pos, sym = rows[walk], np.zeros(len(walk), np.int64)
            for (b, bits), zero in zip(self.levels, self.zeros):
                one, before = bits.get(pos), bits.rank(pos)
                sym |= one.astype(np.int64) << b
                pos = np.where(one, zero + before, pos - before)
            rows[walk] = self.first[sym] + pos - self.base[sym]
            back[walk] += 1
            walk = walk[~self.kept.get(rows[walk])]
        at = self.position[self.kept.rank(rows)].astype(np.int64) + back
        text = np.searchsorted(self.first_at, at, side="right") - 1
        return text, at - self.first_at[text]


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the ``edits + 1`` even pieces of a text."""
    k = edits + 1
    base, extra = divmod(length, k)
    sizes = [base] * (k - extra) + [base + 1] * extra
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(other's length, piece number, start, piece length) of the substrings of a text that can equal piece i of
    another text within ``edits`` edits: at most i edits lie left of the piece and ``edits - i`` right of it."""
    out = []
    for other in range(max(0, length - edits), length + edits + 1):
        shift = length - other
        for i, (p, n) in enumerate(pieces(other, edits)):
            lo = max(0, p - i, p + shift - (edits - i))
            hi = min(length - n, p + i, p + shift + (edits - i))
            out += [(other, i, s, n) for s in range(lo, hi + 1)]
    return out


def within_edits(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether each pair of texts is at most ``edits`` insertions, deletions or replacements apart: banded alignment
    of all pairs side by side."""
    if not a:
        return np.zeros(0, bool)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = int(max(la.max(), lb.max())) + 1

    def grid(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(t.ljust(width, "\x00") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width)

    ga, gb = grid(a), grid(b)
    far = edits + 1
    band = 2 * edits + 1  # column k of the band is position i + k - edits of b
    row = np.full((len(a), band), far, np.int16)
    for k in range(edits, band):
        row[:, k] = np.minimum(k - edits, far)
    out = np.full(len(a), far, np.int16)
    diag = lb - la + edits
    ok_diag = (diag >= 0) & (diag < band)
    done = ok_diag & (la == 0)
    out[done] = row[done, diag[done]]
    for i in range(1, int(la.max()) + 1):
        new = np.full_like(row, far)
        for k in range(band):
            j = i + k - edits
            if j < 0:
                continue
            if j == 0:
                new[:, k] = min(i, far)
                continue
            if j > width:
                continue
            best = row[:, k] + (ga[:, i - 1] != gb[:, j - 1])
            if k + 1 < band:
                best = np.minimum(best, row[:, k + 1] + 1)
            if k:
                best = np.minimum(best, new[:, k - 1] + 1)
            new[:, k] = np.minimum(best, far)
        row = new
        done = ok_diag & (la == i)
        out[done] = row[done, diag[done]]
    return out <= edits


def sketches(flat: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """128 parity bits of the pairs of neighbouring characters of each text. One edit flips four at most."""
    out = np.zeros((len(lens), 2), np.uint64)
    if len(flat) < 2:
        return out
    h = flat[:-1] * np.uint32(0x85EBCA6B) ^ flat[1:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    bit = (h * np.uint32(0x9E3779B1)) >> np.uint32(25)
    one = np.left_shift(np.uint64(1), (bit & np.uint32(63)).astype(np.uint64))
    inside = np.ones(len(h), bool)
    ends = (start + lens)[:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(h))]] = False  # this pair lies over the end of a text
    for k, mine in enumerate((bit < 64, bit >= 64)):
        word = np.concatenate((np.where(inside & mine, one, np.uint64(0)), np.zeros(1, np.uint64)))
        some = np.flatnonzero(lens > 0)
        out[some, k] = np.bitwise_xor.reduceat(word, start[some])
    return out


#: kinds of indexes: keys, all structures, structures of records without key; kinds of matches: key, equal, near
KEY, ALL, BARE = 0, 1, 2
WHOLE, NEAR = 1, 2
_MATCH = pa.schema([("kind", pa.int8()), ("eval_text", pa.string()), ("train_text", pa.string()), ("n_spans", pa.int32()), ("n_chars", pa.int32())])
_MATCH_DDL = "kind byte, eval_text string, train_text string, n_spans int, n_chars int"


def _maximal(index: FullTextIndex, flat: np.ndarray, t_at: np.ndarray, e_at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the texts agree before and from each pair of places; ``left``, ``right``: the most that can be."""

    def grow(step: int, most: np.ndarray) -> np.ndarray:
        n, live = np.zeros(len(most), np.int64), np.flatnonzero(most > 0)
        while len(live):
            k = n[live] if step > 0 else -n[live] - 1
            live = live[flat[t_at[live] + k] == index.flat[e_at[live] + k]]
            n[live] += 1
            live = live[n[live] < most[live]]
        return n

    return grow(-1, left), grow(1, right)


def matches(index: FullTextIndex, texts: list[str], edits: int, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, entry, number of merged spans, characters in them) of pairs at most ``edits`` apart."""
    flat, start, lens = code_points(texts)
    sym = index.symbols(flat)
    base, extra = np.divmod(lens, edits + 1)
    plain = edits + 1 - extra
    own = sketches(flat, start, lens)
    theirs = sketches(index.flat, index.start, index.lens)
    seeds = []
    for i in range(edits + 1):
        p, size = i * base + np.maximum(0, i - plain), base + (i >= plain)  # as in pieces()
        lo, hi = index.search(sym, start + p, size)
        none = size == 0  # a piece of no characters stands everywhere: texts of fewer characters than pieces
        for q in np.flatnonzero(none):
            e = np.arange(len(index.lens))
            seeds.append((np.full(len(e), q), e, np.zeros(len(e), np.int64), np.zeros(len(e), np.int64)))
        n = np.where(none, 0, hi - lo)
        some = np.flatnonzero(n > 0)
        upto = np.cumsum(n[some])
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
            mine = some[at:end]
            at = end
            total = int(n[mine].sum())
            for lot in range(0, total, most):  # a piece alone may occur more often than that
                which = np.arange(lot, min(lot + most, total))
                q = mine[np.searchsorted(np.cumsum(n[mine]), which, side="right")]
                row = lo[q] + which - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])[which]
                e, off = index.locate(row)
                shift = np.abs(off - p[q])
                tail = np.abs((index.lens[e] - off) - (lens[q] - p[q]))
                near = (shift <= i) & (tail <= edits - i)
                q, e, off = q[near], e[near], off[near]
                apart = np.bitwise_count(own[q, 0] ^ theirs[e, 0]).astype(np.int64) + np.bitwise_count(own[q, 1] ^ theirs[e, 1])
                ok = apart <= 4 * edits
                seeds.append((q[ok], e[ok], p[q[ok]], off[ok]))
    if not seeds:
        return
    q, e, p, off = (np.concatenate(x) for x in zip(*seeds))
    if not len(q):
        return
    pair = q * len(index.lens) + e
    names, where = np.unique(pair, return_inverse=True)
    pq, pe = names // len(index.lens), names % len(index.lens)
    good = np.zeros(len(names), bool)
    at_once = max(1, min(20_000, 4_000_000 // (int(lens.max()) + 1)))  # long texts in small lots
    for lot in range(0, len(names), at_once):
        a, b = pe[lot : lot + at_once], pq[lot : lot + at_once]
        good[lot : lot + at_once] = within_edits([index.texts[x] for x in a], [texts[x] for x in b], edits)
    keep = good[where]
    q, e, p, off, where = q[keep], e[keep], p[keep], off[keep], where[keep]
    if not len(q):
        return
    back, on = _maximal(index, flat, start[q] + p, index.start[e] + off, np.minimum(p, off), np.minimum(lens[q] - p, index.lens[e] - off))
    lo, hi = p - back, p + on
    order = np.lexsort((hi, lo, where))
    lo, hi, where = lo[order], hi[order], where[order]
    wide = int(lens.max()) + 1
    reach = np.maximum.accumulate(where * wide + hi) - where * wide  # furthest end so far within the pair
    before = np.concatenate(([-1], np.where(where[1:] == where[:-1], reach[:-1], -1)))
    spans = np.bincount(where, lo > before, minlength=len(names))
    chars = np.bincount(where, np.maximum(hi - np.maximum(lo, before), 0), minlength=len(names))
    yield pq[good], pe[good], spans[good].astype(np.int32), chars[good].astype(np.int32)


_SHARD = ["kind", "len", "sub", "cell", "lane"]


def _search(edits: int, rows_at_once: int = 4096, chars_at_once: int = 2_000_000):
    """Shards one after the other: the rows with ``query`` false build the index, the others stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, index, asked, size = None, [], None, ([], []), 0

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal index, asked, size
            if held and index is None:
                index = FullTextIndex(held)
            for near, texts in enumerate(asked):
                if texts and index is not None:
                    for q, e, spans, chars in matches(index, texts, edits if near else 0):
                        a, b = [index.texts[x] for x in e], [texts[x] for x in q]
                        kind = np.array([KEY if shard[0] == KEY else WHOLE if x == y else NEAR for x, y in zip(a, b)], np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(spans), pa.array(chars)], schema=_MATCH)
            asked, size = ([], []), 0

        for b in batches:
            ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in _SHARD])
            query, near = (b.column(c).to_numpy(zero_copy_only=False) for c in ("query", "near"))
            texts = b.column("text").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(texts)]):
                name = tuple(ids[:, lo].tolist())
                if name != shard:
                    yield from answer()
                    shard, held, index = name, [], None
                for k in range(lo, hi):
                    if not query[k]:
                        held.append(texts[k])
                        continue
                    if not held:
                        break  # no evaluation text here
                    asked[int(near[k])].append(texts[k])
                    size += len(texts[k])
                    if size >= chars_at_once or len(asked[0]) + len(asked[1]) >= rows_at_once:
                        yield from answer()
        yield from answer()

    return run


def _piece_hashes(text: str, n: Column, other: Column, edits: Column, subs: Column, moves: bool) -> Column:
    """Shard numbers of the pieces of a text of length ``other``; with ``moves``, of the substrings of a text of length
    ``n`` that can equal them. The same as :func:`pieces` and :func:`probes`, as an expression."""
    base, extra = (other / (edits + 1)).cast("int"), other % (edits + 1)
    plain = edits + 1 - extra

    def of(i: Column) -> Column:
        p, size = i * base + F.greatest(F.lit(0), i - plain), base + (i >= plain).cast("int")
        shift = n - other
        lo = F.greatest(F.lit(0), p - i, p + shift - (edits - i)) if moves else p
        hi = F.least(n - size, p + i, p + shift + (edits - i)) if moves else p
        at = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda s: F.pmod(F.xxhash64(i, F.substr(F.col(text), s + 1, size)), subs).cast("int"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), edits), of)))


def overlaps(records: DataFrame, edits: int = 2, block_chars: int = 4_000_000, stream_chars: int = 64_000_000) -> DataFrame:
    """(kind, eval_text, train_text, n_spans, n_chars): keys and structures of the evaluation side that the training side
    holds too, with the merged spans of their maximal matches.

    ``records``: side (``train`` or ``eval``), ik (key block or null), red (reduced structure or null). Near matches are
    of structures of which at least one comes without a key somewhere."""
    r = records.select((F.col("side") == "train").alias("query"), "ik", "red")
    kind = lambda k: F.lit(k).cast("int").alias("kind")
    keys = r.where("ik is not null").select("query", F.col("ik").alias("text")).distinct()
    texts = cut(r.where("red is not null").groupBy("query", F.col("red").alias("text")).agg(F.max(F.col("ik").isNull()).alias("bare")), "texts")
    entries = (
        keys.where("not query").select(kind(KEY), "text")
        .union(texts.where("not query").select(kind(ALL), "text"))
        .union(texts.where("not query and bare").select(kind(BARE), "text"))
        .select("kind", F.length("text").alias("len"), "text")
    )
    asks = (
        keys.where("query").select(kind(KEY), F.lit(False).alias("near"), "text")
        .union(texts.where("query").select(kind(ALL), F.col("bare").alias("near"), "text"))
        .union(texts.where("query and not bare").select(kind(BARE), F.lit(True).alias("near"), "text"))
    )
    # one row per kind and length
    sizes = cut(entries.groupBy("kind", "len").agg(F.ceil(F.sum(F.length("text") + 1) / block_chars).cast("int").alias("subs")), "sizes")
    apart = lambda c: F.when(F.col("kind") == KEY, 0).otherwise(c)
    n, subs, one = F.length("text"), F.col("subs"), F.array(F.lit(0))
    e = entries.join(sizes, ["kind", "len"]).select(
        "kind", "len", F.explode(F.when(subs == 1, one).otherwise(_piece_hashes("text", n, n, apart(F.lit(edits)), subs, False))).alias("sub"), "text"
    )
    reach = F.when(F.col("near"), F.sequence(F.greatest(F.lit(1), n - edits), n + edits)).otherwise(F.array(n))
    q = asks.withColumn("len", F.explode(reach)).join(sizes, ["kind", "len"])
    whole = F.slice(_piece_hashes("text", n, n, apart(F.lit(edits)), subs, False), 1, 1)  # an equal text stands in all its shards
    visit = F.when(subs == 1, one).when(~F.col("near"), whole).otherwise(_piece_hashes("text", n, F.col("len"), F.lit(edits), subs, True))
    q = q.select("kind", "len", F.explode(visit).alias("sub"), "near", "text")
    shard = ["kind", "len", "sub"]
    load = e.groupBy(*shard).agg(F.sum(n + 1).alias("e")).join(q.groupBy(*shard).agg(F.sum(n + 1).alias("q")), shard)
    grid = cut(load.select(*shard, F.ceil(F.col("e") / block_chars).cast("int").alias("cells"), F.ceil(F.col("q") / stream_chars).cast("int").alias("lanes")), "grid")
    some = lambda c: F.pmod(F.xxhash64("text"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    e = e.join(grid, shard).withColumn("cell", some("cells")).withColumn("lane", every("lanes"))
    q = q.join(grid, shard).withColumn("lane", some("lanes")).withColumn("cell", every("cells"))
    rows = e.select(*_SHARD, F.lit(False).alias("query"), F.lit(False).alias("near"), "text").union(q.select(*_SHARD, F.lit(True).alias("query"), "near", "text"))
    out = rows.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "query").mapInArrow(_search(edits), _MATCH_DDL)
    found = cut(out.distinct(), "matches")
    for t in (texts, sizes, grid):
        discard(t)
    return found


def record_pairs(records: DataFrame, found: DataFrame) -> DataFrame:
    """(node_id_a, node_id_b) of the records behind the matches, as ``name`` spells them, the smaller spelling first.

    ``records``: record (the id as it compares), name (one spelling per record), side, ik, red."""
    ev = records.where("side = 'eval'").select(F.struct("record", "name").alias("e"), F.col("ik").alias("eik"), F.col("red").alias("ered"))
    tr = records.where("side = 'train'").select(F.struct("record", "name").alias("t"), F.col("ik").alias("tik"), F.col("red").alias("tred"))
    by_key = found.where(f"kind = {KEY}").select(F.col("eval_text").alias("eik")).join(ev, "eik").join(tr, F.col("eik") == F.col("tik"))
    by_text = found.where(f"kind = {WHOLE}").select(F.col("eval_text").alias("ered")).join(ev, "ered").join(tr, F.col("ered") == F.col("tred"))
    near = found.where(f"kind = {NEAR}").select(F.col("eval_text").alias("ered"), F.col("train_text").alias("tred")).distinct()
    by_near = near.join(ev, "ered").join(tr, "tred").where("eik is null or tik is null")
    every = by_key.select("e", "t").union(by_text.select("e", "t")).union(by_near.select("e", "t")).where("e.record <> t.record")
    return every.select(F.least("e.name", "t.name").alias("node_id_a"), F.greatest("e.name", "t.name").alias("node_id_b")).distinct()


def overlap_counts(records: DataFrame, found: DataFrame) -> DataFrame:
    """Per fold and source: evaluation records, and those whose ligand a training record holds too. Needs no pairs.

    ``records``: record, fold, source, side, ik, red."""
    tr_bare = records.where("side = 'train' and ik is null").select(F.col("red").alias("train_text")).distinct()
    near = found.where(f"kind = {NEAR}")
    # a near match holds for every evaluation record of the text if a training record of the other comes without key
    near_all = near.join(tr_bare, "train_text", "left_semi").select(F.col("eval_text").alias("red"))
    near_bare = near.select(F.col("eval_text").alias("red"))
    ev = records.where("side = 'eval'").select("record", "fold", "source", "ik", "red")
    hit = (
        ev.join(found.where(f"kind = {KEY}").select(F.col("eval_text").alias("ik")).distinct(), "ik", "left_semi").select("record", "fold", "source")
        .union(ev.join(found.where(f"kind = {WHOLE}").select(F.col("eval_text").alias("red")).union(near_all).distinct(), "red", "left_semi").select("record", "fold", "source"))
        .union(ev.where("ik is null").join(near_bare.distinct(), "red", "left_semi").select("record", "fold", "source"))
    ).distinct()
    total = ev.select("record", "fold", "source").distinct().groupBy("fold", "source").agg(F.count(F.lit(1)).alias("n_records"))
    return total.join(hit.groupBy("fold", "source").agg(F.count(F.lit(1)).alias("n_overlapping")), ["fold", "source"], "left").select(
        "fold", "source", "n_records", F.coalesce("n_overlapping", F.lit(0)).alias("n_overlapping")
    )
