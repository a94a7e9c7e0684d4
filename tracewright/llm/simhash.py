"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints: each bit of 64 is set when it is set in over half the XXH64 values (seed 42) of a
text's word shingles, repeats included.

Self-join: distinct fingerprints stand in a binary trie.  Pairs of trie nodes are traversed
together, level by level, each with the number of bits in which the two paths differ so far; a pair
is dropped as soon as that exceeds the budget, and also when all of both nodes already lie in one
linked group.  To run on many machines the 64 bits are cut into ``k+1`` or more segments; two
fingerprints within ``k`` bits agree in at least ``segments - k`` of them, so each choice of
agreeing segments gives one forest of tries whose roots are the values of these segments, and the
traversal starts at (root, root).  Tries are dealt to tasks by root.  A task emits a spanning forest
of the links it finds, not every pair, which keeps components whole and the output linear.

Defined cases: null or empty text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle of them all; texts of any length are used whole; equal fingerprints (repeated rows, ties) are one class, so copies never meet in a
join; component_id is the smallest non-null doc_id of the component; columns other than doc_id and text
are not read, and pass through :func:`keep_first` whatever their names; an empty table gives no rows.

:func:`near_classes` and :func:`keep_first` run jobs when they are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import jaccard
from tracewright.llm.arrays import majority
from tracewright.llm.common import byte_slices, cut, free_prefix, id_text, tidy, words_of
from tracewright.llm.graph import components


def fingerprint(words: list[bytes], width: int) -> int:
    """The unsigned fingerprint of a sequence of words."""
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype=np.uint64)
    return int(majority(h, np.array([0, len(h)]))[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def go(batches):
        for ids, texts in byte_slices(batches):
            fps = np.array([fingerprint(words_of(t), width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(go, "doc_id long, fp long")


# --- the join of one task -----------------------------------------------------------------------


class Forest:
    """Union-find over 0..n-1 with vectorised unions; remembers the links that joined two groups."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.labels()
            ra, rb = root[a], root[b]
            live = ra != rb
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            # one link for each higher root; others of it wait for the next turn
            _, first = np.unique(high, return_index=True)
            self.parent[high[first]] = low[first]
            self.links.append((a[first], b[first]))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


LEAF = 4
FRONT = 1 << 20


def trie_links(keys: np.ndarray, roots: np.ndarray, budget: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links between ``keys`` (uint64, distinct within a root) that have equal ``roots`` and
    differ in at most ``budget`` bits, as index pairs."""
    order = np.lexsort((keys, roots))
    k, r = keys[order], roots[order]
    n = len(k)
    forest = Forest(n)
    cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], n]
    # a node pair: two ranges of the sorted keys, the depth they share, the bits that differ so far
    alive = ends - cuts > 1
    stack = [(cuts[alive], ends[alive], cuts[alive], ends[alive], 0, np.zeros(int(alive.sum()), np.int64))]
    while stack:
        a0, a1, b0, b1, depth, diff = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [(a0[half:], a1[half:], b0[half:], b1[half:], depth, diff[half:]), (a0[:half], a1[:half], b0[:half], b1[:half], depth, diff[:half])]
            continue
        # prune pairs that already lie in one group
        label = forest.labels()
        change = np.r_[0, np.cumsum(label[1:] != label[:-1])] if n else label
        one = (label[a0] == label[b0]) & (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1])
        small = ((a1 - a0) <= LEAF) & ((b1 - b0) <= LEAF) | (depth == 64)
        at = np.flatnonzero(~one & small)
        if len(at):
            _leaves(k, forest, a0[at], a1[at], b0[at], b1[at], budget)
        at = ~one & ~small
        if not at.any():
            continue
        a0, a1, b0, b1, diff = a0[at], a1[at], b0[at], b1[at], diff[at]
        bit = np.uint64(63 - depth)
        am, bm = _split(k, a0, a1, bit), _split(k, b0, b1, bit)
        same = a0 == b0
        # children 00, 11, then 01, and 10 unless the pair is a node with itself
        p = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            (am[~same], a1[~same], b0[~same], bm[~same], diff[~same] + 1),
        ]
        q = [np.concatenate(x) for x in zip(*p)]
        fine = (q[0] < q[1]) & (q[2] < q[3]) & (q[4] <= budget) & ~((q[0] == q[2]) & (q[1] - q[0] == 1))
        if fine.any():
            stack.append((*(x[fine] for x in q[:4]), depth + 1, q[4][fine]))
    return [(order[a], order[b]) for a, b in forest.links]


def _split(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index in each sorted range whose key has ``bit`` set."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        probe = np.minimum(mid, len(k) - 1)
        one = ((k[probe] >> bit) & np.uint64(1)) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _leaves(k, forest, a0, a1, b0, b1, budget) -> None:
    """All pairs of small node pairs, by offset."""
    for x in range(int((a1 - a0).max())):
        for y in range(int((b1 - b0).max())):
            i, j = a0 + x, b0 + y
            ok = (i < a1) & (j < b1) & (i != j)
            i, j = i[ok], j[ok]
            near = _popcount(k[i] ^ k[j]) <= budget
            if near.any():
                forest.union(i[near], j[near])


# --- tables --------------------------------------------------------------------------------------


def segment_masks(segments: int, agree: int) -> list[int]:
    """Bit masks of every choice of ``agree`` of the ``segments``."""
    bounds = [round(64 * s / segments) for s in range(segments + 1)]
    parts = [((1 << bounds[s + 1]) - (1 << bounds[s])) for s in range(segments)]
    return [sum(parts[s] for s in chosen) for chosen in combinations(range(segments), agree)]


def links(distinct: DataFrame, budget: int = 4, segments: int | None = None) -> DataFrame:
    """(a, b): spanning links between the distinct fingerprints in column ``fp``.

    More segments make finer tries and more copies: the number follows the table's size so that a
    trie of spread-out fingerprints holds some thousands at most; every choice finds every link.
    """
    if segments is None:
        n = distinct.count()
        segments = budget + 1
        while segments < budget + 4 and n / 2 ** (64 * (segments - budget) / segments) > 4096:
            segments += 1
    masks = segment_masks(segments, segments - budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    forest = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask", "root"))
    dealt = forest.repartition("mask", "root")

    def go(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        fp, mask, root = (np.concatenate(x) for x in zip(*rows))
        _, group = np.unique(np.stack([mask.astype(np.int64), root]), axis=1, return_inverse=True)
        found = trie_links(fp.view(np.uint64), group.ravel(), budget)
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return dealt.select("fp", "mask", "root").mapInArrow(go, "a long, b long")


def near_classes(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fp (signed), component_id for every row."""
    own = cut(fingerprints(docs, width))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(own.select("fp").distinct(), budget))
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(smallest, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fp(col):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def keep_first(docs: DataFrame, width: int = 5, budget: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, columns unchanged.

    Near-duplicates are texts whose sets of ``width``-word shingles have a Jaccard similarity of 0.8 or more, and what such
    pairs connect.  The trie self-join over the sets' fingerprints proposes its spanning links, which are
    confirmed on the sets; pairs beyond its budget come from :mod:`tracewright.llm.jaccard`, so that none is lost.

    The row kept has the group's smallest doc_id (nulls last) and, among repeated ids, the
    smallest text hash; of rows alike in id and text one stays.
    """
    p = free_prefix(docs, "_s_")
    tie, same_id, same_tie = f"{p}tie", f"{p}same_id", f"{p}same_tie"
    plain = jaccard.keyed(id_text(docs))
    rank = docs.sparkSession.sparkContext.broadcast(jaccard.frequency_ranks(plain, width))
    rows = cut(jaccard.described(plain, width, rank))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tie"))
    classes = cut(rows.groupBy("sig").agg(F.min(order).alias("best"), F.min("fp").alias("fp")))
    best = classes.select(F.col("sig").alias("of"), F.col("best.doc_id").alias("b_id"), F.col("best.tie").alias("b_tie"))
    prefixes = rows.join(best, (rows["sig"] == best["of"]) & rows["doc_id"].eqNullSafe(best["b_id"]) & (rows["tie"] == best["b_tie"]), "left_semi")
    # sets of one fingerprint are tied to one of them, and these by the tries
    named = cut(classes.groupBy("fp").agg(F.min("sig").alias("name")))
    tied = classes.join(named, "fp").where("sig <> name").select(F.col("sig").alias("a"), F.col("name").alias("b"))
    tidy(docs.sparkSession)
    found = links(named.select("fp"), budget)
    side = lambda c: named.select(F.col("fp").alias(f"f_{c}"), F.col("name").alias(c))
    tries = found.select(F.col("a").alias("f_a"), F.col("b").alias("f_b")).join(side("a"), "f_a").join(side("b"), "f_b").select("a", "b")
    hints = tied.unionByName(tries).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = components(jaccard.links(plain, classes, prefixes.select("sig", "n", "prefix"), hints, width))
    tidy(docs.sparkSession)
    grouped = classes.join(roots, classes["sig"] == roots["node"], "left").select(F.coalesce("root", "sig").alias("root"), "best")
    stay = grouped.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("k_id"), F.col("best.tie").alias("k_tie"))
    keys = rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n"))
    kept = keys.join(stay, keys["doc_id"].eqNullSafe(stay["k_id"]) & (keys["tie"] == stay["k_tie"]), "left")
    # the few that go, or stand more than once, are taken out by key; the others' texts stay where they lie
    state = cut(kept.select("doc_id", "tie", F.col("k_tie").isNotNull().alias("stays"), "n").where("not stays or n > 1"))
    marks = state.select(F.col("doc_id").alias(same_id), F.col("tie").alias(same_tie), F.col("stays").alias(f"{p}stays"))
    near = F.broadcast(marks) if marks.count() <= jaccard.KEYS else marks
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn(tie, F.xxhash64(text))
    marked = marked.join(near, marked["doc_id"].cast("long").eqNullSafe(near[same_id]) & (marked[tie] == near[same_tie]), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = marked.where(F.col(same_tie).isNull()).select(*names)
    if marks.where(f"{p}stays").isEmpty():
        return out
    # rows alike in id and text: one of them, through a key that nulls share
    again = marked.where(F.col(f"{p}stays")).withColumns({f"{p}value": F.coalesce(same_id, F.lit(0)), f"{p}null": F.col(same_id).isNull()})
    return out.unionByName(again.dropDuplicates([f"{p}value", f"{p}null", tie]).select(*names))
