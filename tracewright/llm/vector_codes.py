"""Product codes of vectors: every part position has a codebook of a few entries, a vector is the
numbers of its parts' nearest entries.

Components become integers (``floor(scale * x)``), so all distances, sums and ties are exact.  The
nearest entry is searched in a vantage-point tree over the entries of a part position: a node holds
one entry and halves the others by their distance to it.  A query visits a half only if the triangle
inequality admits an entry at most as far as the best one so far: radii are rounded outwards to whole
numbers, the bound is compared in integers without strictness, so entries at equal distance are always
met and the lower index wins.

Scale: the table is read once a round, only the vector column; a partition sends one row for each
component of an entry that it used, whatever its number of rows.  Trees hold ``parts * entries``
entries, a parameter, and travel with the tasks.  Labels with over a thousandth of all rows (at most
1,000 of them) are joined by broadcast, the others by their shuffled sums.

Defined cases: a vector that is null or holds a null or non-finite component is dropped; so is one
whose length differs from that of the kept vector with the smallest id, which sets the dimension.  A
length that the parts do not divide (and the empty vector) is filled up with zeros.  Integers beyond
``bound`` (over 10^8 for ordinary sizes) are clamped to it, so that squared distances stay within 64 bits.  Null
ids count as larger than all others, equal ids are ordered by their components; rows are never merged.
With fewer kept rows than entries the codebooks are shorter.  An empty table gives no rows.  Other
columns are not read.

:func:`codes` runs the rounds when it is called.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut

#: Entries of a node of the tree that are compared one by one.
LEAF = 2
#: Rows that are searched together.
ROWS = 8_192
#: A label is hot from this share of the rows on (one in so many).
HOT_SHARE = 1_000


# --- the tree ------------------------------------------------------------------------------------


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers at or below, and at or above, the square roots of non-negative integers."""
    low = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    low -= low * low > squares
    low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


@dataclass(frozen=True)
class Half:
    """A subtree, and bounds of its entries' distances to the vantage point above it."""

    node: Node
    near: int
    far: int


@dataclass(frozen=True)
class Node:
    #: Numbers of the entries that stand here themselves: the vantage point, or all of a leaf.
    own: tuple[int, ...]
    halves: tuple[Half, ...] = ()
    #: Squared distance that parts the halves.
    middle: int = 0


def grow(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The vantage-point tree over the rows of ``entries`` (int64)."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= LEAF:
        return Node(tuple(members.tolist()))
    point, rest = members[0], members[1:]
    away = squared(entries[rest], entries[point])
    order = np.argsort(away, kind="stable")
    rest, away = rest[order], away[order]
    low, high = roots(away)
    middle = len(rest) // 2
    halves = tuple(
        Half(grow(entries, np.sort(rest[a:b])), int(low[a]), int(high[b - 1])) for a, b in ((0, middle), (middle, len(rest))) if b > a
    )
    return Node((int(point),), halves, int(away[middle]))


class Search:
    """Nearest entries of many queries at once."""

    def __init__(self, entries: np.ndarray, root: Node | None = None):
        self.entries, self.root = entries, root or grow(entries)
        #: Distances computed, for tests of the pruning.
        self.compared = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for every row; of equally near entries the lowest."""
        self.queries = queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.full(len(queries), len(self.entries), dtype=np.int64)
        self._visit(self.root, np.arange(len(queries)))
        return self.entry, self.best

    def _meet(self, number: int, rows: np.ndarray) -> np.ndarray:
        away = squared(self.queries[rows], self.entries[number])
        self.compared += len(rows)
        better = (away < self.best[rows]) | ((away == self.best[rows]) & (number < self.entry[rows]))
        self.best[rows[better]], self.entry[rows[better]] = away[better], number
        return away

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        for number in node.own:
            away = self._meet(number, rows)
        if not node.halves:
            return
        low, high = roots(away)
        inside = away < node.middle
        # the half that the query lies in comes first, so the other one is pruned more often
        for first in (True, False):
            at = np.flatnonzero(inside == first)
            for half in node.halves if first else node.halves[::-1]:
                least = np.maximum(np.maximum(low[at] - half.far, half.near - high[at]), 0)
                self._visit(half.node, rows[at[least * least <= self.best[rows[at]]]])


# --- the rounds ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shape:
    dimension: int
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    @property
    def width(self) -> int:
        """Components of a part."""
        return max(1, -(-self.dimension // self.parts))

    @property
    def bound(self) -> int:
        """Largest integer of a component: a row's squared distances sum up to less than 2 ** 62."""
        return min(2**31 - 1, math.isqrt(2**60 // (self.parts * self.width)))


def finite(vectors: DataFrame, vector_col: str) -> DataFrame:
    good = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(vector_col).isNotNull() & good)


def integers(shape: Shape, vector_col: str = "x"):
    """The vector as integers, filled up with zeros: an array of 32-bit integers."""
    bound, fill = float(shape.bound), shape.parts * shape.width - shape.dimension
    x = F.transform(vector_col, lambda v: F.floor(F.least(F.greatest(v * F.lit(float(shape.scale)), F.lit(-bound)), F.lit(bound))).cast("int"))
    return F.concat(x, F.array_repeat(F.lit(0), fill)) if fill else x


def _cubes(batches, shape: Shape):
    """(batch, its integers as rows x parts x width) of bounded batches."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy()
            yield batch, flat.astype(np.int64).reshape(-1, shape.parts, shape.width)


def _searches(books: list[np.ndarray]) -> list[Search]:
    return [Search(b) for b in books]


def sums(rows: DataFrame, shape: Shape, books: list[np.ndarray]) -> DataFrame:
    """For every entry that has parts, by component: the parts' sum and number."""

    def go(batches):
        total = np.zeros((shape.parts, shape.entries, shape.width), dtype=np.int64)
        count = np.zeros((shape.parts, shape.entries), dtype=np.int64)
        searches = _searches(books)
        for _, cube in _cubes(batches, shape):
            for p, search in enumerate(searches):
                entry, _ = search.nearest(cube[:, p])
                np.add.at(total[p], entry, cube[:, p])
                count[p] += np.bincount(entry, minlength=shape.entries)
        p, e = np.nonzero(count)
        if len(p):
            wide = lambda v: pa.array(np.repeat(v, shape.width))
            place = pa.array(np.tile(np.arange(shape.width), len(p)))
            yield pa.RecordBatch.from_arrays([wide(p), wide(e), place, pa.array(total[p, e].ravel()), wide(count[p, e])], names=["part", "entry", "place", "total", "n"])

    partial = rows.select("x").mapInArrow(go, "part long, entry long, place long, total long, n long")
    return partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def moved(books: list[np.ndarray], found: list) -> list[np.ndarray]:
    """Codebooks whose used entries are their parts' floored means."""
    out = [b.copy() for b in books]
    for r in found:
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return out


def books_of(kept: DataFrame, shape: Shape) -> list[np.ndarray]:
    """The starting codebooks: the parts of the smallest ids."""
    order = [F.col("id").asc_nulls_last(), F.col("x").asc()]
    first = kept.select("id", integers(shape).alias("x")).orderBy(*order).limit(shape.entries).collect()
    cube = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), shape.parts, shape.width)
    return [cube[:, p].copy() for p in range(shape.parts)]


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and place, in decimal digits with commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def assigned(rows: DataFrame, shape: Shape, books: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    """id, label, code (two hexadecimal digits a part) and error of every row."""

    def go(batches):
        searches = _searches(books)
        for batch, cube in _cubes(batches, shape):
            found = [s.nearest(cube[:, p]) for p, s in enumerate(searches)]
            codes = np.stack([f[0] for f in found], axis=1)
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            text = codes.astype(np.uint8).tobytes().hex()
            n = 2 * shape.parts
            code = pa.array([text[k : k + n] for k in range(0, len(text), n)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "x").mapInArrow(go, f"id {id_type}, label {label_type}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (cut from lineage) and the sum of errors over its rows of the same label, nulls together.

    A sum beyond 64 bits is null."""
    by_label = cut(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("s")))
    total = by_label.agg(F.sum("n")).first()[0] or 0
    sums_of = by_label.select(F.col("label").alias("of"), F.col("s").try_cast("long").alias("label_error"), (F.col("n") * HOT_SHARE > total).alias("hot"))
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(sums_of.where("hot"))  # at most HOT_SHARE rows
    out = coded.join(hot, same, "inner").unionByName(coded.join(hot, same, "left_anti").join(sums_of.where("not hot"), same, "inner"))
    return out.select("id", "label", "code", "error", "label_error")


def codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error of every kept row; the final codebooks by part).

    ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has two hexadecimal digits for each part")
    kinds = dict(vectors.dtypes)
    plain = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("x"))
    kept = finite(plain, "x")
    first = kept.orderBy(F.col("id").asc_nulls_last(), F.col("x").asc()).select(F.size("x").alias("n")).limit(1).collect()
    shape = Shape(first[0]["n"] if first else 0, parts, entries, rounds, scale)
    kept = kept.where(F.size("x") == shape.dimension)
    books = books_of(kept, shape)
    rows = kept.select("id", "label", integers(shape).alias("x"))
    for _ in range(rounds if first else 0):
        books = moved(books, sums(rows, shape, books).collect())
    coded = cut(assigned(rows, shape, books, kinds[id_col], kinds[label_col]))
    return with_label_error(coded), books
