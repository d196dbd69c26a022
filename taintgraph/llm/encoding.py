"""Encoding of a corpus with a public byte-level tokenizer, by merge replay over an inverted index.

Texts are split into words; each word of a corpus shard is encoded once. All distinct words new to the shard lie in one
chain of symbols, with an index from each adjacent pair to its positions. The merges are replayed in rank order over
that index: a merge visits only the positions where its pair stands and updates only the neighbours it touches, so the
work follows the number of merges applied, also in a word of a million letters.

Nothing is shuffled: a shard is an input partition. The vocabulary (some 50,000 merges, whatever the corpus) is read
once by the driver and broadcast.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text; any characters,
line ends and lengths are encoded whole; repeated rows give repeated results; extra columns are never read.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from taintgraph.llm.batches import parts

#: splits text into words before merging (fixed value)
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _printable_bytes() -> dict[str, int]:
    """The public byte-level alphabet: bytes that print stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str = TOKENIZER) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, int]]]:
    """(id of each byte, pair of ids -> (rank, merged id))."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    byte_id = np.zeros(256, np.int64)
    for c, b in _printable_bytes().items():
        byte_id[b] = vocab[c]
    merges = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return byte_id, merges


class MergeReplay:
    """Encodes words; keeps what it has encoded up to ``keep`` words."""

    def __init__(self, byte_id: np.ndarray, merges: dict, keep: int = 500_000):
        self.byte_id, self.merges, self.keep = byte_id, merges, keep
        self.known: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode new words together."""
        if len(self.known) > self.keep:
            self.known.clear()
        raw = [w.encode("utf-8") for w in words]
        lens = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        ends = np.cumsum(lens + 1)
        ids = np.full(int(ends[-1]), -1, np.int64)  # -1 stands between words
        stream = np.frombuffer(b"\x00".join(raw) + b"\x00", np.uint8)
        ids[:] = self.byte_id[stream]
        ids[ends - 1] = -1
        sym = ids.tolist()
        n, merges = len(sym), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (sym[i], sym[i + 1])
            if pair in merges:
                where.setdefault(pair, []).append(i)
        queue = [(merges[p][0], p) for p in where]
        heapq.heapify(queue)
        while queue:
            _, pair = heapq.heappop(queue)
            left, right = pair
            new = merges[pair][1]
            for i in sorted(where.pop(pair)):
                j = after[i]
                if sym[i] != left or j >= n or sym[j] != right:
                    continue  # an earlier merge took one of the two
                k = after[j]
                sym[i], sym[j] = new, -2
                after[i] = k
                if k < n:
                    before[k] = i
                    fresh = (new, sym[k])
                    if fresh in merges:
                        if fresh not in where:
                            where[fresh] = []
                            heapq.heappush(queue, (merges[fresh][0], fresh))
                        where[fresh].append(i)
                h = before[i]
                if h >= 0:
                    fresh = (sym[h], new)
                    if fresh in merges:
                        if fresh not in where:
                            where[fresh] = []
                            heapq.heappush(queue, (merges[fresh][0], fresh))
                        where[fresh].append(h)
        at = 0
        for w, end in zip(words, ends.tolist()):
            self.known[w] = [s for s in sym[at : end - 1] if s != -2]
            at = end

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts."""
        split = regex.compile(WORDS).findall
        words = [split(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws if w not in self.known}
        if new or len(self.known) > self.keep:
            if len(self.known) + len(new) > self.keep:
                new = {w for ws in words for w in ws}
                self.known.clear()
            self.learn(sorted(new)) if new else None
        known, ids, offsets = self.known, [], [0]
        for ws in words:
            for w in ws:
                ids.extend(known[w])
            offsets.append(len(ids))
        return np.array(offsets, np.int32), np.array(ids, np.int32)


def encode(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, rows_at_once: int = 1 << 20, chars_at_once: int = 4_000_000) -> DataFrame:
    """(doc_id, ids) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_merges(os.fspath(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(*shared.value)
        for b in batches:
            for part in parts(b, ["text"], rows_at_once, chars_at_once):
                offsets, ids = replay.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    two = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return two.mapInArrow(run, "doc_id long, ids array<int>")
