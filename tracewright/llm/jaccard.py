"""Pairs of texts whose word-shingle sets have a Jaccard similarity of 0.8 or more, exactly.

What SimHash tries cannot reach (such pairs lie up to 17 of 64 bits apart) is found by a prefix-filtered
self-join: in one common order of all shingles, two sets of similarity ``t`` or more
share one of the first ``n - ceil(t n) + 1`` shingles of each.  The order is by estimated frequency,
rarest first; the estimates come from a table of counters and any estimate gives the same pairs, since
only the order follows it.  Sets that share a prefix shingle are candidates; each candidate pair, and each
pair that the tries hint at, is confirmed on the whole sets, so the pairs are exactly those of the definition (shingles and sets are
told apart by 64 bits of hash).

Large groups: hints, and neighbours under a few orders within the ``PICKS`` shared prefix shingles of each set with the smallest hashes, are confirmed first, which is
linear in the group; afterwards only pairs of different components are looked at.

Nothing of all documents comes to the driver but the counters (up to 32 MB).  Keys of candidate rows are
broadcast up to ``KEYS`` of them; beyond, the rows are joined by shuffle.

Defined cases: words and shingles as in ``simhash`` (fewer words than a shingle make one of them all);
texts of any length are used whole; texts without words are copies of each other; a null id is an id like any other; repeated rows and ties have one set;
an empty table gives no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrays import majority, opened, packed, word_values
from tracewright.llm.common import cut, gram_hashes, mixed, text_slices, tidy
from tracewright.llm.graph import components

#: Similarity as a fraction: 8 / 10.
TOP, BOTTOM = 8, 10
RANGES = 16
CHAINS = 3
PICKS = 4
SLICE = 1 << 20
#: Row keys that are broadcast at most (24 bytes each).
KEYS = 500_000


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, repeats included, and the text each belongs to."""
    h, counts = word_values([t.encode("utf-8", "replace").lower() for t in texts])
    grams = gram_hashes(h, width)
    ends = np.cumsum(counts)
    own = np.repeat(np.arange(len(texts)), counts)
    inside = np.flatnonzero(own[: len(grams)] == own[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    few = [int(gram_hashes(h[ends[d] - counts[d] : ends[d]], int(counts[d]))[0]) ^ int(counts[d]) for d in short]
    return np.concatenate([grams[inside], np.array(few, dtype=np.uint64)]), np.concatenate([own[inside], short])


def shingle_sets(texts: list[str], width: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles text by text (rarest first where ``rank`` is given), their bounds, and the sets' hashes."""
    h, own = shingles(texts, width)
    order = np.lexsort((h, own) if rank is None else (h, rank[_place(h, len(rank))], own))
    h, own = h[order], own[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
        h, own = h[new], own[new]
    sizes = np.bincount(own, minlength=len(texts))
    bounds = np.r_[0, np.cumsum(sizes)]
    total = np.zeros(len(texts), dtype=np.uint64)
    if len(h):
        some = sizes > 0
        total[some] = np.add.reduceat(mixed(h + np.uint64(0x9E3779B97F4A7C15)), bounds[:-1][some])
    return h, bounds, mixed(total + sizes.astype(np.uint64)).view(np.int64)


def _place(h: np.ndarray, n: int) -> np.ndarray:
    """Counter of each hash among ``n``, a power of two."""
    return (h & np.uint64(n - 1)).astype(np.int64)


def prefix_size(n):
    """How many of a set's first shingles must be looked at."""
    return n - (-(-TOP * n // BOTTOM)) + (n > 0)


def frequency_ranks(docs: DataFrame, width: int) -> np.ndarray:
    """About log2 of how often the shingles of each counter stand, in quarters; counters grow with the input."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 << min(25, max(16, int(total // 256).bit_length()))
    step = n // RANGES

    def count(batches):
        sums = np.zeros(n, dtype=np.uint32)
        for batch in _slices(batches):
            sums += np.bincount(_place(shingles(batch["text"].to_pylist(), width)[0], n), minlength=n).astype(np.uint32)
        for r in range(RANGES):
            part = sums[r * step : (r + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"range": r, "payload": packed(part)}], schema=schema)

    def add(batches):
        sums = {}
        for batch in batches:
            for r, raw in zip(batch["range"].to_pylist(), batch["payload"]):
                got = opened(raw.as_py(), np.uint32)
                sums[r] = sums[r] + got if r in sums else got
        for r, got in sums.items():
            yield pa.RecordBatch.from_pylist([{"range": r, "payload": packed((4 * np.log2(1.0 + got)).astype(np.uint8))}], schema=schema)

    schema = pa.schema([("range", pa.int32()), ("payload", pa.binary())])
    ddl = "range int, payload binary"
    out = np.zeros(n, dtype=np.uint8)
    for row in docs.select("text").mapInArrow(count, ddl).repartition(RANGES, "range").mapInArrow(add, ddl).collect():
        out[row["range"] * step : (row["range"] + 1) * step] = opened(bytes(row["payload"]), np.uint8)
    return out


def _arrays(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))


def keyed(docs: DataFrame, tie: str = "tie") -> DataFrame:
    """doc_id, text, and the text's hash; the two others name a row, or several that are alike."""
    return docs.withColumn(tie, F.xxhash64("text"))


def described(docs: DataFrame, width: int, rank) -> DataFrame:
    """doc_id, tie, sig (hash of the set), fp (SimHash of the set), n and the prefix of every row of ``docs`` (doc_id, tie, text)."""

    def go(batches):
        for batch in _slices(batches):
            texts = batch["text"].to_pylist()
            h, bounds, sig = shingle_sets(texts, width, rank.value)
            n = np.diff(bounds)
            p = prefix_size(n)
            first = np.arange(len(h)) - np.repeat(bounds[:-1], n) < np.repeat(p, n)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tie"], pa.array(sig), pa.array(majority(h, bounds).view(np.int64)), pa.array(n, pa.int32()), _arrays(h[first], np.r_[0, np.cumsum(p)])],
                names=["doc_id", "tie", "sig", "fp", "n", "prefix"],
            )

    return docs.select("doc_id", "tie", "text").mapInArrow(go, "doc_id long, tie long, sig long, fp long, n int, prefix array<long>")


def _slices(batches):
    return text_slices(batches, SLICE)


def _whole(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sig, whole): the sets of the rows that ``wanted`` (sig, doc_id, tie; cut) names, each once."""

    def go(batches):
        for batch in _slices(batches):
            h, bounds, _ = shingle_sets(batch["text"].to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch["sig"], _arrays(h, bounds)], names=["sig", "whole"])

    wanted = wanted.select("sig", F.col("doc_id").alias("w_id"), F.col("tie").alias("w_tie"))
    near = F.broadcast(wanted) if wanted.count() <= KEYS else wanted
    rows = docs.join(near, docs["doc_id"].eqNullSafe(near["w_id"]) & (docs["tie"] == near["w_tie"]))
    return rows.select("sig", "text").mapInArrow(go, "sig long, whole array<long>").groupBy("sig").agg(F.first("whole").alias("whole"))


# --- candidates of one task ----------------------------------------------------------------------


def _columns(batches, names):
    parts = [[b[c].to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def _shared(batches):
    """Rows whose token stands in more than one set."""
    names = ["token", "sig", "n", "pos"]
    got = _columns(batches, names)
    if got is None:
        return
    order = np.argsort(got[0], kind="stable")
    got = [x[order] for x in got]
    same = got[0][1:] == got[0][:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in got], names=names)


def possible(na, nb, i=0, j=0):
    """Whether sets of ``na`` and ``nb`` shingles whose first common one is their ``i``-th and ``j``-th can be similar enough."""
    return (TOP + BOTTOM) * np.minimum(na - i, nb - j) >= TOP * (na + nb)


_PAIR = ["a", "b"]


def _neighbours(batches):
    """Pairs that follow one another within a token under several orders."""
    got = _columns(batches, ["token", "sig", "n"])
    if got is None:
        return
    token, sig, n = got[0], got[1], got[2].astype(np.int64)
    found = []
    for seed in range(CHAINS):
        # by size first in one order: near sizes pass the filters more often
        key = sig if not seed else mixed(sig.view(np.uint64) + np.uint64(seed)).view(np.int64)
        order = np.lexsort((key, n, token)) if seed == CHAINS - 1 else np.lexsort((key, token))
        a, b = order[:-1], order[1:]
        ok = (token[a] == token[b]) & possible(n[a], n[b])
        a, b = sig[a[ok]], sig[b[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=_PAIR)


def _across(batches):
    """All pairs within a token that lie in different components, where it can be the first they have in common.

    A similar pair comes out for its first common token at least: rare ones stand first, so sets that
    differ in many shingles meet too far behind.  Where both have the same token just before, this is not the first.
    """
    got = _columns(batches, ["token", "sig", "n", "pos", "prev", "label"])
    if got is None:
        return
    order = np.argsort(got[0], kind="stable")
    token, sig, n, pos, prev, label = (x[order] for x in got)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    out, size = [], 0
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(token)]):
        if (label[lo:hi] == label[lo]).all():
            continue
        step = max(1, (1 << 20) // (hi - lo))
        for at in range(lo, hi, step):
            a = np.arange(at, min(hi, at + step))[:, None]
            b = np.arange(lo, hi)[None, :]
            i, j = np.nonzero((a < b) & (label[a] != label[b]) & (prev[a] != prev[b]) & possible(n[a], n[b], pos[a], pos[b]))
            a, b = at + i, lo + j
            out.append(np.stack([np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])]))
            size += len(a)
            if size > 500_000:
                yield _pairs(out)
                out, size = [], 0
    if size:
        yield _pairs(out)


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=_PAIR)


# --- tables --------------------------------------------------------------------------------------


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets have the similarity; only the sets of ``pairs`` (cut) are made again."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = cut(classes.select("sig", "best.doc_id", "best.tie").join(named, "sig", "left_semi"))
    whole = cut(_whole(docs, wanted, width))
    tidy(docs.sparkSession)
    a = whole.select(F.col("sig").alias("a"), F.col("whole").alias("x"))
    b = whole.select(F.col("sig").alias("b"), F.col("whole").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = both * (TOP + BOTTOM) >= (F.size("x") + F.size("y")) * TOP
    return cut(pairs.join(a, "a").join(b, "b").where(enough).select("a", "b"))


def _promising(common):
    """Whether sets of ``na`` and ``nb`` shingles with ``common`` ones in both prefixes can be similar enough.

    What they share beyond that follows the prefix of the set whose prefix ends first.
    """
    rest = F.greatest(*[F.ceil(F.col(c) * TOP / BOTTOM - F.lit(1e-9)) - 1 for c in ("na", "nb")])
    return (common + rest) * (TOP + BOTTOM) >= (F.col("na") + F.col("nb")) * TOP


def links(docs: DataFrame, classes: DataFrame, prefixes: DataFrame, hints: DataFrame, width: int) -> DataFrame:
    """(a, b): links between sets that give the components of all similar pairs.

    ``docs``: doc_id, tie, text; ``classes``: a row for each set with sig and best (doc_id, tie: a row that has it);
    ``prefixes``: sig, n, prefix of each set; ``hints``: pairs (a, b) of sets that are likely similar.
    """
    entries = prefixes.select("sig", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "sig", "n", "pos")
    shared = cut(entries.repartition("token").mapInArrow(_shared, "token long, sig long, n int, pos int"))
    held = cut(shared.groupBy("sig").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("entries")))
    # 31 bits of a token serve to bound from above how many are common
    short = held.select("sig", "n", F.transform("entries", lambda e: F.pmod(e["token"], F.lit(2**31 - 1)).cast("int")).alias("tokens"))
    side = lambda c: short.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"tokens_{c}"))
    least = F.slice(F.array_sort(F.transform("entries", lambda e: F.struct(F.xxhash64(e["token"]).alias("h"), e["token"].alias("token")))), 1, PICKS)
    picks = held.select("sig", "n", F.explode(least).alias("x")).select("x.token", "sig", "n")
    pairs = picks.repartition("token").mapInArrow(_neighbours, "a long, b long").distinct()
    # one more, should two of the common ones share their 31 bits
    common = F.size(F.array_intersect("tokens_a", "tokens_b")) + 1
    likely = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(_promising(common)).select("a", "b")
    pairs = likely(pairs)
    near = _confirmed(cut(pairs.unionByName(hints).distinct()), docs, classes, width)
    tidy(docs.sparkSession)
    roots = components(near)
    # each shingle with the shared one before it in its set
    before = lambda e, k: F.when(k > 0, F.get("entries", k - 1)["token"]).otherwise(F.col("sig"))
    each = held.select("sig", "n", F.explode(F.transform("entries", lambda e, k: F.struct(e["token"].alias("token"), e["pos"].alias("pos"), before(e, k).alias("prev")))).alias("e"))
    each = each.select("e.token", "sig", "n", "e.pos", "e.prev")
    label = each.join(roots, each["sig"] == roots["node"], "left").select("token", "sig", "n", "pos", "prev", F.coalesce("root", "sig").alias("label"))
    far = likely(label.repartition("token").mapInArrow(_across, "a long, b long").distinct())
    return near.unionByName(_confirmed(cut(far), docs, classes, width))
