"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (sum of squared piece
lengths).  Pieces are placed longest first; among the sequences that can take a piece under every
constraint the one is chosen whose weighted residual norm afterwards is smallest (``norm``), or
whose residual capacity has the largest weighted dot product with the piece's needs (``dot``); of equals the one with
fewer documents left, then less cost left.  Residuals are parts of their capacity.

Scale: a piece matters to the rule only by its length, and lengths are bounded by the capacity.  So
the corpus is reduced to a histogram of at most ``capacity`` rows, the rule is run on the driver
over classes of sequences with equal residuals, and the resulting plan - "ranks a..b of length L go to
sequences s.., so many to each, from offset o" - is applied to the pieces by their rank within their
length.  The plan is the one that placing piece by piece gives: under ``norm`` a sequence that has
taken a piece stays the best while another one of that length fits, so it takes as many at once; under ``dot`` the class's
other sequences come first.  Ranks come from salted two-level counts, so no length (however frequent)
meets in one task.

The query's capacities are tokens 1024, documents 1024 and cost 1024 ** 2, which no set of pieces within 1024 tokens exceeds:
under its contract only tokens may limit a sequence.  Documents and cost take part in the choice by their weights.

Defined cases: null text is empty (end id only); texts of any length are encoded whole and cut into pieces; an empty table gives no rows;
repeated rows are packed separately; ties in rank order fall to (doc_id, piece, ids_crc32); columns other than doc_id and text are not
read, so none can clash.

:func:`pack` runs the encoding and the histogram when it is called.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, id_text
from tracewright.llm.tokens import encoded, forget_encoders, public_vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one rank group; the salt grows with the table.
RANK_GROUP = 20_000


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    #: Weights of the three residuals.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def __post_init__(self):
        if self.rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {self.rule!r}")
        if self.tokens < 1 or self.documents < 1 or self.cost < self.tokens**2:
            raise ValueError("an empty sequence must admit a piece of as many ids as it has tokens")

    def needs(self, length: int) -> tuple[int, int, int]:
        return length, 1, length * length

    def score(self, left: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Smaller is better; ``left``: rows of residuals."""
        size, weight = np.array([self.tokens, self.documents, self.cost], dtype=float), np.array(self.weights)
        if self.rule == "norm":
            return (((left - need) / size) ** 2 * weight).sum(axis=1)
        return -((left / size) * (need / size) * weight).sum(axis=1)


def pieces(docs: DataFrame, capacity: int, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Every document cut into pieces of ``capacity`` ids; only the first may be shorter."""
    vocabulary = vocabulary or public_vocabulary()

    def go(batches):
        end = np.array([end_id], dtype="<u4").tobytes()
        for ids, blobs in encoded(vocabulary)(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, blob in zip(ids, blobs):
                raw = memoryview(blob + end)
                n = len(raw) // 4
                count = -(-n // capacity)
                at = 0
                for k in range(count):
                    size = n - capacity * (count - 1) if k == 0 else capacity
                    for column, value in zip(out, (doc_id, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]))):
                        column.append(value)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_text(docs).mapInArrow(go, PIECES)


class Classes:
    """Open sequences by what they have left; equal ones are one class of number ranges."""

    def __init__(self):
        self.left = np.full((1024, 3), -1.0)
        self.ranges: list[list[tuple[int, int]]] = []
        self.where: dict[tuple[int, int, int], int] = {}
        self.free: list[int] = []

    def put(self, left: tuple[int, int, int], span: tuple[int, int]) -> None:
        k = self.where.get(left)
        if k is None:
            if self.free:
                k = self.free.pop()
            else:
                k = len(self.ranges)
                self.ranges.append([])
                if k >= len(self.left):
                    self.left = np.vstack([self.left, np.full_like(self.left, -1.0)])
            self.where[left], self.left[k] = k, left
        heapq.heappush(self.ranges[k], span)

    def take(self, k: int, most: int) -> tuple[int, int]:
        """The lowest numbers of the class, ``most`` of them at most."""
        first, end = heapq.heappop(self.ranges[k])
        if first + most < end:
            heapq.heappush(self.ranges[k], (first + most, end))
            return first, first + most
        if not self.ranges[k]:
            del self.where[tuple(int(x) for x in self.left[k])]
            self.left[k] = -1
            self.free.append(k)
        return first, end

    def best(self, cap: Capacity, need: np.ndarray) -> int | None:
        """The class that takes the next piece."""
        live = self.left[: len(self.ranges)]
        at = np.flatnonzero((live >= need).all(axis=1))
        if not len(at):
            return None
        return int(at[np.lexsort((live[at, 0], live[at, 2], live[at, 1], cap.score(live[at], need)))[0]])


def plan(histogram: dict[int, int], cap: Capacity) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset, pieces in each), by length and rank:
    rank ``r`` goes to sequence ``first + (r - first rank) // pieces``."""
    classes, out, made = Classes(), [], 0
    full = (cap.tokens, cap.documents, cap.cost)
    for length in sorted(histogram, reverse=True):
        left, rank, need = histogram[length], 0, np.array(cap.needs(length), dtype=float)
        if (need > full).any():
            raise ValueError(f"a piece of {length} ids exceeds an empty sequence")
        while left:
            k = classes.best(cap, need)
            room = full if k is None else tuple(int(x) for x in classes.left[k])
            each = min(left, int(min(a // b for a, b in zip(room, need)))) if k is None or cap.rule == "norm" else 1
            most = left // each
            if k is None:
                # a new sequence is the only one that fits, so it is filled before the next one opens
                first, end = made, made + most
                made = end
            else:
                first, end = classes.take(k, most)
            n = (end - first) * each
            out.append((length, rank, rank + n, first, cap.tokens - room[0], each))
            after = tuple(int(a - each * b) for a, b in zip(room, need))
            classes.put(after, (first, end))
            left -= n
            rank += n
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 6)


def ranked(parts: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0 within a length).  The salt keeps a frequent length in many groups."""
    total = parts.count()
    groups = max(1, -(-total // RANK_GROUP))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(sums, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("salt", "inside", "before")
    )


def pack(parts: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """``parts``: rows with doc_id, piece, length, ids_crc32 (and more), already cut from lineage.

    Adds sequence_id and offset.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    steps = plan(counts, cap)
    names = [*parts.columns, "sequence_id", "offset"]

    def place(batches):
        forget_encoders()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            # steps are sorted by (length, first rank): search the combined key
            base = int(steps[:, 2].max(initial=1)) + 1
            k = np.searchsorted(steps[:, 0] * base + steps[:, 1], length * base + rank, side="right") - 1
            turn, inside = np.divmod(rank - steps[k, 1], steps[k, 5])
            t = t.append_column("sequence_id", pa.array(steps[k, 3] + turn)).append_column("offset", pa.array(steps[k, 4] + inside * length))
            yield from t.select(names).combine_chunks().to_batches()

    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return ranked(parts).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    return pack(cut(pieces(docs, cap.tokens, vocabulary, end_id)), cap)
