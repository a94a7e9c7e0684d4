"""Packing as a cutting-stock problem, solved by column generation.

A document's ids fill whole sequences of ``capacity`` ids first; what is left of it (its tail, below
the capacity) is an item.  Items matter by their length alone, so the corpus is a histogram of at most
``capacity - 1`` lengths.  A pattern is a set of lengths that share a sequence; it costs the capacity,
or its own length where that is a power of two (such sequences are not padded).  The linear program
- cover the histogram by patterns at least cost - is solved by the revised simplex method: patterns of
a first-fit-decreasing pass are the first basis, an unbounded knapsack over all lengths prices new
ones (its table gives the best pattern for every fill, so one pass over it offers many columns).  It
stops when the cost is within ``Stock.gap`` of the bound that the prices prove, or when ``Stock.patience``
rounds of pricing have gained less than that share; either way every item is packed.

Patterns are used as often as the solution says, rounded down; the items that are left over are packed
by first fit decreasing.  Sequences that are then not full would be padded.  Instead the emptiest of
them are taken apart, and their documents, laid end to end, are cut to fill the rest of the others; what
remains of them fills whole sequences and powers of two.  So nothing is padded, and only documents of
taken-apart sequences are cut, other than those longer than a sequence.

Scale: the driver holds the histogram and the patterns, both bounded by the capacity.  The plan says
which ranks of a length go where; ranks come from salted two-level counts of slim rows, and the plan is
applied by search.  Full pieces need no shuffle.  Ids are read again for documents that are
cut; these are few unless lengths hardly fit together, so they are broadcast up to ``MOST_BROADCAST``, and joined by a
shuffle of the tails beyond.

Defined cases: a null or empty text is its end id alone; texts of any length are encoded whole; an empty
table gives no rows; repeated rows are packed separately; ties in rank order fall to the row's number in
the written table; columns other than doc_id and text are not read.

:func:`pack_documents` writes the encoded rows when it is called.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrays import ramps
from tracewright.llm.common import byte_slices, cut, id_text, scratch
from tracewright.llm.packing import ranked
from tracewright.llm.tokens import public_vocabulary
from tracewright.llm.words import word_encoder

SLICE_BYTES = 3 << 20
#: Documents that are cut, up to which their places (some 60 bytes each) are broadcast; the plan knows their number.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Stock:
    capacity: int = 2048
    #: The linear program stops within this share of its proven bound.
    gap: float = 1e-5
    #: Rounds of pricing that may gain less than ``gap`` together.
    patience: int = 12

    def cost(self, fill: np.ndarray) -> np.ndarray:
        """Ids of a sequence that holds ``fill`` ids, padding included."""
        return np.where((fill & (fill - 1)) == 0, fill, self.capacity)


Pattern = tuple[tuple[int, int], ...]  #: ((length, how often), ...), longest first


def _pattern(lengths: list[int]) -> Pattern:
    values, counts = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
    return tuple(zip(values[::-1].tolist(), counts[::-1].tolist()))


def _fill(p: Pattern) -> int:
    return sum(length * n for length, n in p)


# --- the linear program --------------------------------------------------------------------------


def first_fit(histogram: dict[int, float], capacity: int, whole: bool) -> list[tuple[Pattern, float, int]]:
    """(pattern, its use, a length that it uses up), longest lengths first: each pattern takes the longest that
    still fits, as often as it fits, and is used until one of its lengths is used up.  ``whole``: in whole numbers."""
    left = dict(histogram)
    lengths = np.array(sorted(left), dtype=np.int64)
    out = []
    while len(lengths):
        room, taken = capacity, []
        top = len(lengths)
        while top and room >= lengths[0]:
            top = min(top, int(np.searchsorted(lengths, room, side="right")))
            if not top:
                break
            length = int(lengths[top - 1])
            n = room // length
            if whole:
                n = min(n, int(left[length]))
            taken += [length] * n
            room -= n * length
            top -= 1
        pattern = _pattern(taken)
        use = min(left[length] // n if whole else left[length] / n for length, n in pattern)
        ending = min(pattern, key=lambda x: left[x[0]] / x[1])[0]
        for length, n in pattern:
            left[length] -= use * n
        if whole:
            lengths = lengths[[left[int(x)] > 0 for x in lengths]] if any(left[x] <= 0 for x, _ in pattern) else lengths
        else:
            lengths = lengths[lengths != ending]  # exactly one length leaves: the patterns are a basis
            for length, _ in pattern:
                left[length] = max(left[length], 0.0)
        out.append((pattern, use, ending))
    return out


class Knapsack:
    """The best value of every exact fill under given prices of lengths, items without number."""

    def __init__(self, lengths: np.ndarray, price: np.ndarray, capacity: int):
        self.lengths, self.price = lengths, price
        self.best = np.full(capacity + 1, -np.inf)
        self.last = np.full(capacity + 1, -1, dtype=np.int64)
        self.best[0] = 0.0
        ends = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for fill in range(1, capacity + 1):
            n = ends[fill]
            if n:
                value = self.best[fill - lengths[:n]] + price[:n]
                k = int(value.argmax())
                if value[k] > -np.inf:
                    self.best[fill], self.last[fill] = value[k], k

    def counts(self, fill: int) -> dict[int, int]:
        out: dict[int, int] = {}
        while fill:
            k = int(self.last[fill])
            out[k] = out.get(k, 0) + 1
            fill -= int(self.lengths[k])
        return out


def _inverse(columns: list[dict[int, int]], ending: list[int]) -> np.ndarray:
    """Inverse of the first basis.  A pattern's last length stands in no later pattern, so the rows in that order
    are triangular and can be solved one by one."""
    m = len(columns)
    turn = {k: j for j, k in enumerate(ending)}
    of_row: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for j, column in enumerate(columns):
        for k, n in column.items():
            of_row[turn[k]].append((j, n))
    out = np.zeros((m, m))
    for i, entries in enumerate(of_row):
        row = np.zeros(m)
        row[ending[i]] = 1.0
        for j, n in entries:
            if j < i:
                row -= n * out[j]
        out[i] = row / dict(entries)[i]
    return out


@dataclass
class Solution:
    patterns: list[tuple[Pattern, float]]
    cost: float
    bound: float
    rounds: int = 0
    history: list[float] = field(default_factory=list)


def solve(histogram: dict[int, int], stock: Stock = Stock()) -> Solution:
    """The linear program over all patterns, up to ``stock.gap``."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return Solution([], 0.0, 0.0)
    demand = np.array([histogram[int(x)] for x in lengths], dtype=float)
    place = {int(x): k for k, x in enumerate(lengths)}
    start = first_fit(dict(zip(lengths.tolist(), demand.tolist())), stock.capacity, whole=False)
    columns = [{place[x]: n for x, n in p} for p, *_ in start]
    use = np.array([u for _, u, _ in start])
    m = len(lengths)
    inverse = _inverse(columns, [place[e] for *_, e in start])
    costs = stock.cost(np.array([_fill(p) for p, *_ in start])).astype(float)
    price = (costs[:, None] * inverse).sum(axis=0)
    fills = np.arange(stock.capacity + 1)
    full = stock.cost(np.maximum(fills, 1)).astype(float)
    # the ids themselves are a bound: every price at its length
    out = Solution([], float((costs * use).sum()), float((lengths * demand).sum()))
    while out.cost > out.bound * (1 + stock.gap):
        sack = Knapsack(lengths, price, stock.capacity)
        gain = sack.best[1:] / full[1:]
        # prices divided by the best gain are feasible prices
        out.bound = max(out.bound, float((price * demand).sum()) / max(1.0, float(gain.max())))
        out.rounds += 1
        out.history.append(out.cost)
        before = out.cost
        # fills worth more than they cost, the best first; each is priced again before it enters
        offers = [int(f) + 1 for f in np.argsort(-gain) if gain[f] > 1 + 1e-9][: max(8, m // 8)]
        for fill in offers:
            column = sack.counts(fill)
            rows = np.array(list(column), dtype=np.int64)
            often = np.array(list(column.values()), dtype=float)
            reduced = full[fill] - float((price[rows] * often).sum())
            if reduced >= -1e-9 * full[fill]:
                continue
            step = (inverse[:, rows] * often).sum(axis=1)
            positive = step > 1e-9
            if not positive.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[positive] = use[positive] / step[positive]
            r = int(ratio.argmin())
            turn = max(float(ratio[r]), 0.0)
            use -= turn * step
            np.maximum(use, 0.0, out=use)
            use[r] = turn
            pivot = inverse[r] / step[r]
            inverse -= np.outer(step, pivot)
            inverse[r] = pivot
            price += reduced * pivot
            columns[r], costs[r] = column, full[fill]
            out.cost = float((costs * use).sum())
        if not offers or len(out.history) > stock.patience and out.history[-stock.patience] - out.cost <= stock.gap * out.cost:
            break
    out.patterns = [
        (tuple(sorted(((int(lengths[k]), n) for k, n in c.items()), reverse=True)), float(u)) for c, u in zip(columns, use) if u > 0
    ]
    return out


# --- the plan --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """``steps``: (length, first rank, end rank, first sequence, offset, items in each, place on the tape or -1),
    by length and rank.  A step without place puts rank ``r`` into sequence ``first + (r - first rank) // each``;
    one with a place lays its items end to end on the tape.  ``cuts``: (place on the tape, ids of a cut, first
    sequence, offset), by place: the tape is cut into runs of equal cuts, one for each sequence."""

    steps: np.ndarray
    cuts: np.ndarray
    sequences: int
    solution: Solution


def plan(histogram: dict[int, int], stock: Stock = Stock()) -> Plan:
    solution = solve(histogram, stock)
    left = dict(histogram)
    used: list[tuple[Pattern, int]] = []
    for pattern, use in solution.patterns:
        # several patterns may hold a length, and prices are floats: never more than is there
        times = min(int(use + 1e-9), *(left[x] // n for x, n in pattern))
        if times > 0:
            used.append((pattern, times))
            for x, n in pattern:
                left[x] -= times * n
    used += [(p, int(n)) for p, n, _ in first_fit({x: n for x, n in left.items() if n}, stock.capacity, whole=True)]
    # the emptiest sequences are taken apart: each yields what it holds and needs no filling any more
    fill = {p: _fill(p) for p, _ in used}
    rest = lambda p: int(stock.cost(np.array([fill[p]]))[0]) - fill[p]
    used.sort(key=lambda x: (rest(x[0]), x[0]))
    apart_of = -(-sum(rest(p) * n for p, n in used) // stock.capacity)
    kept: list[tuple[Pattern, int]] = []
    apart: list[tuple[Pattern, int]] = []
    for p, n in reversed(used):
        out = min(n, apart_of)
        apart_of -= out
        apart += [(p, out)] if out else []
        kept += [(p, n - out)] if n > out else []
    rank = dict.fromkeys(histogram, 0)
    steps, cuts, made, tape = [], [], 0, 0
    for p, n in kept:
        offset = 0
        for x, each in p:
            steps.append((x, rank[x], rank[x] + n * each, made, offset, each, -1))
            rank[x] += n * each
            offset += x * each
        if rest(p):
            cuts.append((tape, rest(p), made, offset))
            tape += rest(p) * n
        made += n
    place = 0
    for p, n in apart:
        for x, each in p:
            steps.append((x, rank[x], rank[x] + n * each, -1, 0, each, place))
            rank[x] += n * each
            place += x * n * each
    # what the tape still holds: whole sequences, then powers of two
    for size in (stock.capacity >> k for k in range(stock.capacity.bit_length())):
        if n := (place - tape) // size:
            cuts.append((tape, size, made, 0))
            tape, made = tape + size * n, made + n
    return Plan(np.array(sorted(steps), dtype=np.int64).reshape(-1, 7), np.array(cuts, dtype=np.int64).reshape(-1, 4), made, solution)


def tape_pieces(cuts: np.ndarray, start: int, length: int) -> list[tuple[int, int, int, int]]:
    """The pieces of an item that lies at ``start`` on the tape: (ids before it, ids, sequence, offset)."""
    out, at = [], start
    k = int(np.searchsorted(cuts[:, 0], at, side="right")) - 1
    while at < start + length:
        if k + 1 < len(cuts) and at >= cuts[k + 1, 0]:
            k += 1
        first, size, sequence, offset = cuts[k].tolist()
        turn, inside = divmod(at - first, size)
        n = min(size - inside, start + length - at)
        out.append((at - start, n, sequence + turn, offset + inside))
        at += n
    return out


# --- the documents -------------------------------------------------------------------------------

#: ``serial`` numbers rows, ``first_full`` the whole sequences of the table; ``full`` are these sequences' checksums.
ROWS = "serial long, id long, doc_tokens long, first_full long, full array<long>, length long, ids_crc32 long, ids binary"
PLACED = "serial long, id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, tape long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def _table(ddl: str, columns: list) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def encoded(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """Every document's ids: checksums of its whole sequences, and the tail after them."""

    def go(batches):
        serial = full = TaskContext.get().partitionId() << 33
        for doc_ids, texts in byte_slices(batches, SLICE_BYTES):
            flat, sizes = word_encoder(vocabulary).encode(texts)
            # every document's end id after its own
            ids = np.insert(flat, np.cumsum(sizes), np.uint32(end_id)).astype("<u4", copy=False)
            n = sizes + 1
            ends = np.cumsum(n)
            whole, tail = np.divmod(n, capacity)
            sums, tails, crcs = [], [], []
            raw, short = memoryview(ids.tobytes()), memoryview(ids.astype("<u2").tobytes()) if ids.max(initial=0) < 1 << 16 else None
            for a, b, w in zip((ends - n).tolist(), ends.tolist(), whole.tolist()):
                sums.append([zlib.crc32(raw[4 * k : 4 * (k + capacity)]) for k in range(a, a + w * capacity, capacity)])
                a += w * capacity
                crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
                # two bytes an id where they suffice: a tail's length tells which
                tails.append(bytes(short[2 * a : 2 * b]) if short is not None else bytes(raw[4 * a : 4 * b]))
            yield _table(ROWS, [serial + np.arange(len(n)), doc_ids, n, full + np.cumsum(whole) - whole, sums, tail, crcs, tails])
            serial, full = serial + len(n), full + int(whole.sum())

    return id_text(docs).mapInArrow(go, ROWS)


def _place(steps: np.ndarray):
    base = int(steps[:, 2].max(initial=1)) + 1
    keys = steps[:, 0] * base + steps[:, 1]

    def go(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            length, rank = column("length").to_numpy(), column("rank").to_numpy()
            k = np.searchsorted(keys, length * base + rank, side="right") - 1
            turn, inside = np.divmod(rank - steps[k, 1], steps[k, 5])
            tape = np.where(steps[k, 6] < 0, -1, steps[k, 6] + (rank - steps[k, 1]) * length)
            yield _table(
                PLACED,
                [*(column(c) for c in ("doc_id", "id", "doc_tokens", "start", "length", "ids_crc32")), steps[k, 3] + turn, steps[k, 4] + inside * length, tape],
            )

    return go


def _cut(cuts: np.ndarray):
    def go(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r in batch.to_pylist():
                width = len(r["ids"]) // r["length"]
                ids = np.frombuffer(r["ids"], dtype=f"<u{width}").astype("<u4")
                for before, n, sequence, offset in tape_pieces(cuts, r["tape"], r["length"]):
                    crc = zlib.crc32(ids[before : before + n].tobytes())
                    for column, value in zip(out, (r["id"], r["start"] + before, n, crc, r["doc_tokens"], sequence, offset)):
                        column.append(value)
            yield _table(PIECES, out)

    return go


def pack_documents(docs: DataFrame, stock: Stock = Stock(), vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents and their places: sequence (any number) and offset there."""
    spark = docs.sparkSession
    path = scratch(spark, "stock-rows")
    encoded(docs, stock.capacity, vocabulary or public_vocabulary("word_bpe_49k.json"), end_id).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    tails = rows.where("length > 0")
    found = plan({r["length"]: r["count"] for r in tails.groupBy("length").count().collect()}, stock)
    slim = tails.select(
        F.col("serial").alias("doc_id"), F.lit(0).alias("piece"), "length", "ids_crc32", "id", "doc_tokens", (F.col("doc_tokens") - F.col("length")).alias("start")
    )
    placed = cut(ranked(slim).mapInArrow(_place(found.steps), PLACED))
    names = [c.split(" ")[0] for c in PIECES.split(", ")]
    whole = rows.select("id", "doc_tokens", "first_full", F.posexplode("full").alias("at", "ids_crc32")).select(
        F.col("id").alias("doc_id"), (F.col("at").cast("long") * stock.capacity).alias("start"), F.lit(stock.capacity).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (-1 - F.col("first_full") - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    uncut = placed.where("tape < 0").withColumnRenamed("id", "doc_id").select(names)
    taken = placed.where("tape >= 0").select("serial", "id", "doc_tokens", "start", "length", "tape")
    on_tape = found.steps[found.steps[:, 6] >= 0]
    if int((on_tape[:, 2] - on_tape[:, 1]).sum()) <= MOST_BROADCAST:
        taken = F.broadcast(taken)
    taken = rows.select("serial", "ids").join(taken, "serial")
    return whole.select(names).unionByName(uncut).unionByName(taken.mapInArrow(_cut(found.cuts), PIECES))
