"""Benchmark decontamination by greedy string tiling.

Seeds: runs of five words that a document shares with a benchmark item (the whole item where it has
fewer words), found by a running Karp-Rabin hash over word numbers.  For each (document, item) pair
with a seed, seeds are joined to maximal runs along their diagonals and tiled greedily: the longest match whose
words are all unmarked is marked on both sides, overlapped matches shrink to their unmarked rest,
until nothing of seed length is left.  Tiles may stand in any order, so reordered passages count.
A pair is reported when tiles cover at least 80 % of the item's words.  Items of fewer than ``LEAST_WORDS``
words say too little and match nothing.

Scale: the benchmark is the small side, but its size is measured: items are taken in blocks of at
most ``BLOCK_CHARS`` characters, each block's index is broadcast and all documents run against it
in one narrow pass (so a benchmark of n blocks is n scans); there is no shuffle of texts.  A word that is repeated on both sides gives
seeds for every pair of its places; they are found a stretch of the document at a time and kept as runs only.

Defined cases: null or empty items and documents match nothing; texts of any length are used whole; repeated documents are reported
each; repeated items likewise; of matches of one length the first in the document, then in the item, is marked first; columns other than
doc_id and text are not read, and pass through :func:`keep_clean` whatever their names; an empty table on either side gives no rows.

:func:`leaks` and :func:`keep_clean` read the benchmark when they are called.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrays import ramps
from tracewright.llm.common import byte_slices, gram_hashes, id_text, plain_words, small_batches, spec, text_slices

SEED_WORDS = 5
LEAST_WORDS = 3
#: Seed pairs that are looked at together.
PAIRS_AT_ONCE = 1 << 19
COVERAGE = 0.8
BLOCK_CHARS = 8_000_000


@dataclass
class Index:
    """Word numbers of a block of items and where each seed stands."""

    items: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    #: seed length -> (sorted seed hashes, first entry, end entry, item index, position)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: all items' words one after another, and where each item begins
    flat: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], seed_words: int = SEED_WORDS) -> Index:
        vocabulary: dict[str, int] = {}
        items, words = [], []
        for item, text in rows:
            own = plain_words(text or "")
            if len(own) >= LEAST_WORDS:
                items.append(item)
                words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in own], dtype=np.uint64))
        seeds = {}
        for length in sorted({min(seed_words, len(w)) for w in words}):
            own = [k for k, w in enumerate(words) if min(seed_words, len(w)) == length]
            grams = [gram_hashes(words[k], length) for k in own]
            h = np.concatenate(grams)
            item = np.repeat(own, [len(g) for g in grams])
            at = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            keys, first = np.unique(h, return_index=True)
            seeds[length] = (keys, first, np.r_[first[1:], len(h)], item, at)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        return cls(items, words, vocabulary, seeds, flat, np.cumsum([0, *map(len, words)])[:-1])

    def matches(self, text: str) -> list[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(item index, item words, covered words, tiles (document word, item word, length)) of every
        item that shares a seed."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in plain_words(text)], dtype=np.uint64)
        runs: dict[int, list[np.ndarray]] = {}
        lengths: dict[int, int] = {}
        for length, (keys, first, end, item, at) in self.seeds.items():
            if len(ids) < length:
                continue
            h = gram_hashes(ids, length)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hits = np.flatnonzero(keys[k] == h)
            many = (end - first)[k[hits]]
            stops = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS_AT_ONCE, prepend=0)).tolist()
            for a, b in zip([0, *stops], [*stops, len(hits)]):
                p = np.repeat(hits[a:b], many[a:b])
                e = np.repeat(first[k[hits[a:b]]], many[a:b]) + ramps(many[a:b])
                i, q = item[e], at[e]
                flat = self.starts[i] + q
                same = np.ones(len(p), dtype=bool)
                for w in range(length):
                    same &= ids[p + w] == self.flat[flat + w]
                p, i, q = p[same], i[same], q[same]
                order = np.lexsort((p, p - q, i))
                p, i, q = p[order], i[order], q[order]
                for x in np.split(np.arange(len(p)), np.flatnonzero(np.diff(i)) + 1) if len(p) else ():
                    own = int(i[x[0]])
                    runs.setdefault(own, []).append(joined(p[x], q[x], np.full(len(x), length), length))
                    lengths[own] = length
        out = []
        for i, parts in runs.items():
            p, q, n = np.concatenate(parts, axis=1)
            if len(parts) > 1:
                order = np.lexsort((p, p - q))
                p, q, n = joined(p[order], q[order], n[order], lengths[i])
            tiles = tile(list(zip(p.tolist(), q.tolist(), n.tolist())), lengths[i])
            out.append((i, len(self.words[i]), sum(n for _, _, n in tiles), tiles))
        return out


def joined(p: np.ndarray, q: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """Maximal runs (document word, item word, words) of matches sorted by diagonal and document word."""
    end = p + n
    new = np.r_[True, (np.diff(p - q) != 0) | (p[1:] > end[:-1] - least + 1)]
    at = np.flatnonzero(new)
    return np.stack([p[at], q[at], np.maximum.reduceat(end, at) - p[at]])


def tile(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from maximal matches (document word, item word, words)."""
    heap = [(-n, p, q) for p, q, n in runs]
    heapq.heapify(heap)
    base = min(p for p, _, _ in runs)
    marked_doc = np.zeros(max(p + n for p, _, n in runs) - base, dtype=bool)
    marked_item = np.zeros(max(q + n for _, q, n in runs), dtype=bool)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = marked_doc[p - base : p - base + n] | marked_item[q : q + n]
        if not taken.any():
            marked_doc[p - base : p - base + n] = marked_item[q : q + n] = True
            tiles.append((p, q, n))
            continue
        # what is left of it, in stretches
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (-(b - a), p + a, q + a))
    return tiles


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """One index for each block of the benchmark, in turn."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Index.of(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


PAIRS = "doc_id long, item_id long, item_words int, covered_words int, coverage double, n_tiles int, tiles array<array<int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each (document, item) whose item is covered to ``coverage`` at least.

    ``tiles`` holds (first document word, first item word, words) of every tile.
    """
    spark = docs.sparkSession
    out = None
    for index in indexes(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def go(batches, shared=shared):
            index = shared.value
            for ids, texts in byte_slices(batches):
                found = [
                    (doc_id, index.items[i], n, got, got / n, len(tiles), [list(t) for t in sorted(tiles)])
                    for doc_id, text in zip(ids, texts)
                    for i, n, got, tiles in index.matches(text)
                    if got >= coverage * n
                ]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.list_(pa.int32())))
                    names = [x.split(" ")[0] for x in PAIRS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

        part = id_text(docs).mapInArrow(go, PAIRS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], PAIRS) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that leak no item, columns unchanged."""
    for index in indexes(benchmark, block_chars):
        shared = small_batches(docs).sparkSession.sparkContext.broadcast(index)

        def go(batches, shared=shared):
            index = shared.value
            for batch in text_slices(batches):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                clean = [not any(got >= coverage * n for _, n, got, _ in index.matches(t or "")) for t in texts]
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(go, spec(docs, ""))
    return docs
