"""Language-model scores by logistic context mixing over hashed byte contexts, with a match model and a
word-unigram base.

Bits.  A text is its lower-cased bytes and an end byte 0.  Each byte is eight binary decisions.  Five
predictors (the word so far, of which at most the last five bytes, and the last 2..5 bytes, hashed with
the decision's place into tables of ``2 ** slot_bits`` slots) give counts of zeros and ones; their
stretched probabilities are mixed by weights that a gate chooses (how many predictors have seen the
context, the length of the word so far, and which bit it is); the mixed probability is refined by an
adaptive table over (gate, probability bucket).

Match model.  At places that the text itself chooses (the hash of the last three words ends in
``ANCHOR_BITS`` zeros) the model looks up how training texts went on to the next such place.  That
stretch of text then has the probability ``w * c / C + (1 - w) * bits``: ``C`` counts the context, ``c``
the context with this very stretch, and the gate ``w`` follows from how often a context with so large a
``C`` went on in a way seen elsewhere.  A training document is looked up without its own counts, so
its score tells what the other documents say about it.

The score is the sum of log10 probabilities over the text.

Learning.  One pass counts every (context, decision) of the training documents.  A second pass trains
mixing weights and refinement by steps over small batches: the distinct six-byte strings of a fill (some
10 MB of text), in the order of the slices that they first stand in, ``BATCH`` of them at a time, each
weighted by its count, from counts without the decision at hand.  So the number of updates grows with the
text; the partitions' weights are averaged by the bytes they saw.  Words, and stretches after
their contexts, are counted exactly: blocks send them once to shards and get the totals back
(:mod:`tracewright.llm.exchange`), so what is gathered grows with the corpus.

Sizes.  Bit tables are broadcast: ``ORDERS`` x ``2 ** slot_bits`` x 4 bytes at any corpus size.  A slot's
counts are exact to 60,000; beyond, both are scaled down together and the decision at hand is not
left out of them (it weighs less than one in 60,000).  All decisions of a six-byte string are alike
wherever it stands, so each block is reduced to its distinct strings first.

Words and stretches are told apart by 64 bits of hash: among a billion distinct words two collide
with a chance of 3 %, which would add their counts in ``base_score`` and ``n_known``.

Defined cases: null text is empty (the end only); texts of any length are scored whole; a null doc_id counts as the
empty text for the hold-out rule; repeated rows and rows of one doc_id are documents of their own; ties cannot arise; other columns
are not read; without training documents every decision has probability 1/2 and every word count is
zero; an empty table gives no rows.

:func:`score` runs its counting jobs when it is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrays import opened, packed, words_at
from tracewright.llm.common import byte_slices, crc_of_id, cut, id_text, mixed
from tracewright.llm.exchange import ROW, Meeting, Tree, answer_columns, meet, rows_of

ORDERS = 5
SLOT_BITS = 21
RANGES = 8
GATES = (ORDERS + 1) * (ORDERS + 1) * 8
BUCKETS = 33
RATE = 0.3
#: Strings of one step, and how much of the past a step's scale remembers.
BATCH = 8192
MEMORY = 0.9
#: Counts of a slot beyond this are scaled.
EXACT = 60_000
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 3 << 20
TASK_BYTES = 64 << 20
END = b"\x00"
#: One place in 2 ** ANCHOR_BITS is an anchor of the match model.
CONTEXT_WORDS, ANCHOR_BITS = 3, 4
#: Upper ends of the buckets of a context's count.
MATCH_GATES = np.array([1, 2, 3, 5, 9, 17, 65])
_A = 0x9E3779B97F4A7C15


def held_out(doc_id) -> bool:
    return crc_of_id(doc_id) % 10 == 0


def lowered(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace").lower() for t in texts]


# --- bits ----------------------------------------------------------------------------------------


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte codes (the byte lowest, then its predecessors) of all texts' bytes with their end,
    and the number of codes of every text.  Before its start a text is preceded by zeros."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    pad = b"\x00" * ORDERS
    raw = np.frombuffer(b"".join(p for t in texts for p in (pad, t, END)), dtype=np.uint8).astype(np.uint64)
    if not len(raw):
        return np.zeros(0, np.uint64), sizes
    two = (raw[:-1] << np.uint64(8)) | raw[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    code = (four[:-2] << np.uint64(16)) | two[4:]
    # drop the codes that end inside a padding
    keep = np.ones(len(code), dtype=bool)
    starts = np.cumsum(sizes + ORDERS)[:-1] - ORDERS
    for k in range(ORDERS):
        keep[starts + k] = False
    return code[keep], sizes


def slots(code: np.ndarray, order: int, bit: int, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """Slot of each code's context of ``order`` bytes at the decision of ``bit``."""
    context = word_context(code) if order == 1 else (code >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
    node = (np.uint64(1) << np.uint64(7 - bit)) | ((code & np.uint64(255)) >> np.uint64(bit + 1))
    return (mixed(context * np.uint64(512) + node + (np.uint64(order) << np.uint64(56))) >> np.uint64(64 - slot_bits)).astype(np.int64)


def word_length(code: np.ndarray) -> np.ndarray:
    """How many of the last five bytes belong to the word that is being written."""
    inside, length = np.ones(len(code), dtype=bool), np.zeros(len(code), dtype=np.int64)
    for k in range(1, ORDERS + 1):
        byte = (code >> np.uint64(8 * k)) & np.uint64(255)
        inside &= (byte != 32) & (byte > 13)
        length += inside
    return length


def word_context(code: np.ndarray) -> np.ndarray:
    n = word_length(code).astype(np.uint64)
    return ((code >> np.uint64(8)) & ((np.uint64(1) << (n * np.uint64(8))) - np.uint64(1))) | (n << np.uint64(40))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    at = _firsts(code)
    return code[at], np.diff(np.r_[at, len(code)])


class Distinct:
    """Distinct codes with their counts and the slice they first stood in, gathered over slices."""

    LIMIT = 1_500_000

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.turn = 0

    def add(self, code: np.ndarray) -> None:
        own, n = _distinct(code)
        self.parts.append((own, n, np.full(len(own), self.turn, dtype=np.int32)))
        self.turn += 1
        if sum(len(p[0]) for p in self.parts[1:]) > len(self.parts[0][0]) + 500_000:
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        code, n, turn = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(code, kind="stable")  # parts follow the text: the first of equals is the earliest
        code, n, turn = code[order], n[order], turn[order]
        at = _firsts(code)
        return code[at], np.add.reduceat(n, at) if len(at) else n, turn[at]

    def full(self) -> bool:
        return sum(len(p[0]) for p in self.parts) > self.LIMIT

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, self.parts, self.turn = self.merged(), [], 0
        return out


class Lookup:
    """Places of codes in a sorted array of distinct codes, by open hashing in rounds."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.rounds = keys, []
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        left, factor = np.arange(len(keys), dtype=np.int32), _A
        while len(left):
            slot = self._slot(keys[left], factor)
            owner = np.full(1 << self.bits, -1, dtype=np.int32)
            owner[slot] = left
            self.rounds.append((factor, owner))
            left = left[owner[slot] != left]
            factor = (factor * 0xD6E8FEB86659FD93 + 2) % (1 << 64) | 1

    def _slot(self, code: np.ndarray, factor: int) -> np.ndarray:
        return ((code * np.uint64(factor)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Every code must be one of the keys."""
        out = np.empty(len(code), dtype=np.int32)
        left = None
        for factor, owner in self.rounds:
            c = code if left is None else code[left]
            at = owner[self._slot(c, factor)]
            hit = (self.keys[at] == c) & (at >= 0)
            if left is None:
                out[:] = at
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = at[hit]
                left = left[~hit]
            if not len(left):
                break
        return out


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3)))


class Mixer:
    def __init__(self, slot_bits: int = SLOT_BITS):
        self.slot_bits = slot_bits
        self.weights = np.full((GATES, ORDERS + 1), 0.35, dtype=np.float64)
        self.weights[:, -1] = 0.0
        self.refine = np.zeros((GATES, BUCKETS, 2))
        self.scale = np.zeros(GATES)
        self.seen = 0.0

    def inputs(self, tables: np.ndarray, code: np.ndarray, bit: int, length: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and gates.

        ``tables``: counts where ``without`` (the outcomes to leave out of them) is given, else
        stretched already.  A predictor that leans to neither side counts as not having seen it.
        """
        x = np.empty((len(code), ORDERS + 1), dtype=np.float32)
        seen = np.zeros(len(code), dtype=np.int64)
        for k in range(ORDERS):
            at = slots(code, k + 1, bit, self.slot_bits)
            if without is None:
                own = np.take(tables[k], at)
            else:
                pair = np.take(tables[k].view(np.uint32).ravel(), at)
                n0, n1 = (pair & np.uint32(0xFFFF)).astype(np.float32), (pair >> np.uint32(16)).astype(np.float32)
                exact = np.maximum(n0, n1) < EXACT
                own = _stretch(np.maximum(n0 - (~without & exact), 0), np.maximum(n1 - (without & exact), 0))
            x[:, k] = own
            seen += own != 0
        x[:, -1] = 1.0
        return x, (seen * (ORDERS + 1) + length) * 8 + bit

    def dot(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate].astype(np.float32)), -15, 15).astype(np.float64)

    @staticmethod
    def bucket(s: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(s * 2) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.int64)

    def learn(self, tables: np.ndarray, code: np.ndarray, count: np.ndarray, turn: np.ndarray) -> None:
        """A step for each bit of each batch; strings in the order of their slices, within one by hash."""
        order = np.lexsort((mixed(code), turn))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            c, n = code[part], count[part].astype(np.float64)
            length = word_length(c)
            for bit in range(8):
                y = ((c >> np.uint64(bit)) & np.uint64(1)).astype(bool)
                x, gate = self.inputs(tables, c, bit, length, y)
                s = self.dot(x, gate)
                error = n * (y - 1 / (1 + np.exp(-s)))
                cell = gate * BUCKETS + self.bucket(s)
                self.refine[..., 0] += np.bincount(cell, weights=n, minlength=GATES * BUCKETS).reshape(GATES, BUCKETS)
                self.refine[..., 1] += np.bincount(cell, weights=n * y, minlength=GATES * BUCKETS).reshape(GATES, BUCKETS)
                size = np.bincount(gate, weights=n, minlength=GATES)
                power = np.bincount(gate, weights=n * np.einsum("ij,ij->i", x, x), minlength=GATES)
                live = size > 0
                self.scale[live] = MEMORY * self.scale[live] + size[live] * 0.1 + 0.25 * power[live] / (ORDERS + 1)
                rate = RATE / self.scale[live]
                for k in range(ORDERS + 1):
                    self.weights[live, k] += rate * np.bincount(gate, weights=error * x[:, k], minlength=GATES)[live]
        self.seen += float(count.sum())

    def log10(self, stretched: np.ndarray, code: np.ndarray) -> np.ndarray:
        """log10 probability of each code's byte after its context."""
        total, length = np.zeros(len(code)), word_length(code)
        # the refinement's rate, held to the mixed probability by 20 pseudo-counts
        weight = self.refine[..., 0] + 20
        for bit in range(8):
            y = ((code >> np.uint64(bit)) & np.uint64(1)).astype(bool)
            x, gate = self.inputs(stretched, code, bit, length)
            s = self.dot(x, gate)
            p = 1 / (1 + np.exp(-s))
            at = self.bucket(s)
            p = (p + (self.refine[gate, at, 1] + 20 * p) / weight[gate, at]) / 2
            total += np.log10(np.clip(np.where(y, p, 1 - p), 1e-9, 1))
        return total


# --- words and matches -----------------------------------------------------------------------------


class Stretches:
    """The words of some texts, and what stands between the texts' anchors.

    ``text``, ``begin``, ``end``: text number and bounds (in the texts written one after another with a
    line feed after each) of every stretch that follows an anchor; ``context`` and ``tail``
    are the hashes of what precedes it and of itself.  The last stretch takes the text's end in.
    """

    def __init__(self, texts: list[bytes]):
        self.words, starts, counts = words_at(texts)
        self.counts = counts
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        h = self.words
        if len(h) <= CONTEXT_WORDS:
            self.text = self.begin = self.end = np.zeros(0, np.int64)
            self.context = self.tail = np.zeros(0, np.uint64)
            return
        key = np.zeros(len(h) - CONTEXT_WORDS, dtype=np.uint64)
        for k in range(CONTEXT_WORDS):
            key = key * np.uint64(_A) + h[k : k + len(key)]
        key = mixed(key + np.uint64(CONTEXT_WORDS))
        owner = np.repeat(np.arange(len(texts)), counts)
        low = np.uint64((1 << ANCHOR_BITS) - 1)
        at = np.flatnonzero((owner[CONTEXT_WORDS:] == owner[: len(key)]) & (key & low == 0))
        self.text, self.begin, self.context = owner[at + CONTEXT_WORDS], starts[at + CONTEXT_WORDS], key[at]
        last = np.r_[self.text[1:] != self.text[:-1], True] if len(at) else np.zeros(0, bool)
        self.end = np.where(last, ends[self.text], np.r_[self.begin[1:], 0]) if len(at) else self.begin
        raw = END.join([*texts, b""])
        digest = xxhash.xxh3_64_intdigest
        tail = [digest(raw[a:b]) for a, b in zip(self.begin.tolist(), self.end.tolist())]
        # a word stands in the exchange with the tail 0
        self.tail = np.array(tail, dtype=np.uint64) | np.uint64(1)


def _counted(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in sorted order, their summed weights, and the pair of each entry."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    of = np.empty(len(a), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(a)]))
    return a[at], b[at], np.bincount(of, weights=weight, minlength=len(at)).astype(np.uint64), of


class Entries:
    """What a block asks for: its distinct words, and its distinct (context, tail) pairs, in one order."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.learns = np.array([not held_out(d) for d in ids], dtype=bool)
        words, weight, self.parts = [], [], []
        done = 0
        for part in _parts(texts):
            s = Stretches(part)
            own = self.learns[done : done + len(part)]
            words.append(s.words)
            weight.append(np.repeat(own, s.counts))
            self.parts.append((part, own, s))
            done += len(part)
        h, trained = np.concatenate(words), np.concatenate(weight)
        self.word_key, back = np.unique(h, return_inverse=True)
        self.word_of = back.ravel()
        n = np.bincount(self.word_of, weights=trained, minlength=len(self.word_key)).astype(np.uint64)
        context = np.concatenate([s.context for _, _, s in self.parts])
        tail = np.concatenate([s.tail for _, _, s in self.parts])
        trained = np.concatenate([own[s.text] for _, own, s in self.parts])
        key, sub, m, self.pair_of = _counted(context, tail, trained)
        both = np.concatenate([self.word_key, key])
        subs = np.concatenate([np.zeros(len(self.word_key), np.uint64), sub])
        order = np.lexsort((subs, both))
        self.key, self.sub, self.n = both[order], subs[order], np.concatenate([n, m])[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.word_at, self.pair_at = place[: len(self.word_key)], place[len(self.word_key) :]


def match_gate(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(MATCH_GATES, count, side="left")


def _settle(key, sub, n):
    """Totals of a key and of a pair; facts: distinct and all words in training, and for each gate how
    many stretches met their context elsewhere, and how many met themselves."""
    at = _firsts(key)
    size = np.diff(np.r_[at, len(key)])
    total = np.repeat(np.add.reduceat(n, at), size) if len(at) else n
    word = sub == 0
    facts = [float((word & (n > 0)).sum()), float(n[word].sum())]
    pair = ~word & (total > 1)
    gate = match_gate(total[pair] - 1)
    seen = np.bincount(gate, weights=n[pair], minlength=len(MATCH_GATES) + 1)
    met = np.bincount(gate, weights=np.where(n[pair] > 1, n[pair], 0), minlength=len(MATCH_GATES) + 1)
    return [total, n], [*facts, *seen, *met]


def _give(own, met, found):
    return found


MEETING = Meeting(np.add, _settle, _give, 2)


# --- passes --------------------------------------------------------------------------------------

PART = "kind string, shard int, payload binary"
_PART = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("payload", pa.binary())])


def _trained_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for ids, texts in byte_slices(batches, SLICE_BYTES):
        raw = lowered([t for d, t in zip(ids, texts) if not held_out(d)])
        if raw:
            yield raw


def _first(slot_bits: int):
    """Counts of context decisions in a partition's training documents."""

    def go(batches: Iterator[pa.RecordBatch]):
        tables = np.zeros((ORDERS, 1 << slot_bits, 2), dtype=np.uint32)
        docs = 0
        held = Distinct()

        def count():
            code, n, _ = held.take()
            for k in range(ORDERS if len(code) else 0):
                own, back = _distinct_contexts(code, n, k + 1)
                for bit in range(8):
                    at = slots(own, k + 1, bit, slot_bits) * 2 + ((own >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
                    order = np.argsort(at)
                    at, weight = at[order], back[order]
                    first = _firsts(at)
                    tables[k].reshape(-1)[at[first]] += np.add.reduceat(weight, first).astype(np.uint32)

        for raw in _trained_slices(batches):
            docs += len(raw)
            held.add(strings(raw)[0])
            if held.full():
                count()
        if docs:
            count()
            step = (1 << slot_bits) // RANGES
            for k in range(ORDERS):
                parts = ((k * RANGES + r, tables[k, r * step : (r + 1) * step]) for r in range(RANGES))
                rows = [{"kind": "bits", "shard": s, "payload": packed(x)} for s, x in parts if x.any()]
                yield pa.RecordBatch.from_pylist(rows, schema=_PART)
            yield pa.RecordBatch.from_pylist([{"kind": "size", "shard": 0, "payload": np.array([docs], dtype=np.int64).tobytes()}], schema=_PART)

    return go


def _distinct_contexts(code: np.ndarray, count: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes cut to ``order`` bytes of context, distinct, with summed counts."""
    if order in (1, ORDERS):
        return code, count
    own, back = np.unique(code & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
    return own, np.bincount(back.ravel(), weights=count)


def _sum(batches):
    """Sums what meets in a partition, one row after another."""
    bits: dict[int, np.ndarray] = {}
    docs = 0
    for batch in batches:
        for kind, s, raw in zip(batch["kind"].to_pylist(), batch["shard"].to_pylist(), batch["payload"]):
            if kind == "size":
                docs += int(np.frombuffer(raw.as_py(), np.int64)[0])
                continue
            got = opened(raw.as_py(), np.uint32).astype(np.uint64)
            bits[s] = bits[s] + got if s in bits else got
    for s, sums in bits.items():
        pair = sums.reshape(-1, 2).astype(np.float64)
        scale = np.minimum(1.0, EXACT / np.maximum(pair.max(axis=1), 1))
        row = {"kind": "bits", "shard": s, "payload": packed(np.ceil(pair * scale[:, None]).astype(np.uint16))}
        yield pa.RecordBatch.from_pylist([row], schema=_PART)
    if docs:
        yield pa.RecordBatch.from_pylist([{"kind": "size", "shard": 0, "payload": np.array([docs], dtype=np.int64).tobytes()}], schema=_PART)


class Model:
    """Bit tables, mixer, the gates of the match model and the totals of the word base."""

    def __init__(self, slot_bits: int = SLOT_BITS):
        self.tables = np.zeros((ORDERS, 1 << slot_bits, 2), dtype=np.uint16)
        self.mixer = Mixer(slot_bits)
        self.match = np.full(len(MATCH_GATES) + 1, 0.5)
        self.docs = self.words = self.word_tokens = 0
        self._stretched = None

    @property
    def tokens(self) -> int:
        return self.word_tokens + self.docs

    def stretched(self) -> np.ndarray:
        """Made once in each worker, in place of the counts."""
        if self._stretched is None:
            self._stretched = np.empty(self.tables.shape[:2], dtype=np.float32)
            for k in range(ORDERS):
                pair = self.tables[k].astype(np.float32)
                self._stretched[k] = _stretch(pair[:, 0], pair[:, 1])
            self.tables = None
        return self._stretched


def train(docs: DataFrame, slot_bits: int = SLOT_BITS) -> Model:
    """Bit tables and mixer.  Tasks take ``TASK_BYTES`` of text or more, since each holds whole tables."""
    own, sc = id_text(docs), docs.sparkSession.sparkContext
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    waves = -(-total // (TASK_BYTES * max(1, sc.defaultParallelism)))
    own = own.coalesce(max(1, waves) * max(1, sc.defaultParallelism))
    sums = own.mapInArrow(_first(slot_bits), PART).repartition("kind", "shard").mapInArrow(_sum, PART)
    model = Model(slot_bits)
    step = (1 << slot_bits) // RANGES
    for r in sums.collect():
        raw = bytes(r["payload"])
        if r["kind"] == "bits":
            k, part = divmod(r["shard"], RANGES)
            model.tables[k, part * step : (part + 1) * step] = opened(raw, np.uint16).reshape(-1, 2)
        else:
            model.docs = int(np.frombuffer(raw, np.int64)[0])
    shared = sc.broadcast(model.tables)

    def mix(batches):
        mixer, held = Mixer(slot_bits), Distinct()
        for raw in _trained_slices(batches):
            held.add(strings(raw)[0])
            if held.full():
                mixer.learn(shared.value, *held.take())
        mixer.learn(shared.value, *held.take())
        if mixer.seen:
            both = np.concatenate([mixer.weights.ravel() * mixer.seen, mixer.refine.ravel(), [mixer.seen]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)), pa.int32()), pa.array(both)], names=["place", "value"])

    got = own.mapInArrow(mix, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    shared.unpersist()
    if got:
        both = np.zeros(len(got))
        both[[r["place"] for r in got]] = [r["value"] for r in got]
        m = model.mixer
        m.weights = (both[: m.weights.size] / both[-1]).reshape(m.weights.shape)
        m.refine = both[m.weights.size : -1].reshape(m.refine.shape)
    return model


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about ``SLICE_BYTES``."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > SLICE_BYTES:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    yield out


def _rows(table: pa.Table) -> tuple[list, list[bytes]]:
    """A block's rows in a repeatable order: equal ids by text."""
    ids, texts = table["doc_id"].to_pylist(), lowered(table["text"].to_pylist())
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order]


def _ask(tree: Tree):
    def go(key, table):
        e = Entries(*_rows(table))
        return rows_of(tree, 1, key[0].as_py(), e.key, e.sub, e.n)

    return go


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "n_bytes long, bits_per_byte double, matched_bytes long"
)
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64())]
    + [("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64()), ("matched_bytes", pa.int64())]
)


def mixed_log10(bits: np.ndarray, total: np.ndarray, own: np.ndarray, gates: np.ndarray) -> np.ndarray:
    """log10 of ``w * own / total + (1 - w) * 10 ** bits``; ``bits`` alone where nothing was counted."""
    some = total > 0
    w = np.where(some, gates[match_gate(total)], 0.0)
    rest = np.log10(1 - w) + bits
    with np.errstate(divide="ignore"):
        match = np.log10(w * own / np.maximum(total, 1))
    top = np.maximum(rest, match)
    return np.where(own > 0, top + np.log10(10.0 ** (rest - top) + 10.0 ** (match - top)), rest)


def _score(shared):
    def go(key, docs, answers):
        model: Model = shared.value
        if not docs.num_rows:
            return pa.Table.from_pylist([], schema=_RESULT)
        ids, texts = _rows(docs)
        e = Entries(ids, texts)
        total_of, own_of = (x.astype(np.float64) for x in answer_columns(answers, 2))
        # words
        count = own_of[e.word_at]
        mass = model.tokens + 0.1 * (model.words + (model.docs > 0) + 1)
        logs = lambda c: np.log10((c + 0.1) / mass) if model.tokens else np.zeros_like(c)
        n_words = np.concatenate([s.counts for _, _, s in e.parts])
        ends = np.concatenate([[0], np.cumsum(n_words)])
        per_word, known = logs(count)[e.word_of], (count > 0)[e.word_of]
        end_log = float(logs(np.array([float(model.docs)]))[0])
        # bytes: distinct strings of the block first, then the texts a slice at a time
        held = Distinct()
        for part, _, _ in e.parts:
            held.add(strings(part)[0])
        distinct, _, _ = held.take()
        stretched = model.stretched()
        logp = np.concatenate([model.mixer.log10(stretched, distinct[k : k + 100_000]) for k in range(0, len(distinct), 100_000)])
        find = Lookup(distinct)
        scores, matched, done = [], [], 0
        for part, learns, s in e.parts:
            code, sizes = strings(part)
            by_byte = logp[find(code)]
            score = np.add.reduceat(by_byte, np.cumsum(sizes) - sizes)
            hit = np.zeros(len(part))
            n = len(s.text)
            if n:
                bounds = np.stack([s.begin, s.end], axis=1).ravel()
                bits = np.add.reduceat(np.r_[by_byte, 0.0], bounds)[::2]
                at = e.pair_at[e.pair_of[done : done + n]]
                total, own = _without_self(s, learns, total_of[at], own_of[at])
                gain = mixed_log10(bits, total, own, model.match) - bits
                score = score + np.bincount(s.text, weights=gain, minlength=len(part))
                hit = np.bincount(s.text, weights=(own > 0) * (s.end - s.begin), minlength=len(part))
                done += n
            scores.append(score)
            matched.append(hit)
        score, matched = np.concatenate(scores), np.concatenate(matched)
        rows = []
        for k, doc_id in enumerate(ids):
            a, b = int(ends[k]), int(ends[k + 1])
            n_bytes = len(texts[k])
            rows.append(
                (doc_id, bool(not e.learns[k]), b - a + 1, int(known[a:b].sum()) + (model.docs > 0), model.tokens, float(per_word[a:b].sum()) + end_log)
                + (float(score[k]), n_bytes, float(-score[k] / np.log10(2) / max(1, n_bytes)), min(n_bytes, int(matched[k])))
            )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    return go


def _without_self(s: Stretches, learns: np.ndarray, total: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of contexts and pairs less those of the document itself, where it was learned from."""
    text = s.text.astype(np.uint64)
    for_context = _counted(text, s.context, np.ones(len(text)))
    pair = mixed(s.context + s.tail * np.uint64(_A))
    for_pair = _counted(text, pair, np.ones(len(text)))
    mine = learns[s.text]
    less = lambda counted: np.where(mine, counted[2][counted[3]].astype(np.float64), 0.0)
    return np.maximum(total - less(for_context), 0), np.maximum(own - less(for_pair), 0)


def score(docs: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """One row for each document; see the module's notes."""
    spark = docs.sparkSession
    own = id_text(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tree = Tree(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES)))
    rows = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(tree.blocks)).cast("int"))
    model = train(docs, slot_bits)
    asked = rows.groupBy("block").applyInArrow(_ask(tree), ROW)
    answers = cut(meet(asked, tree, MEETING)[0])
    facts = answers.where("facts is not null").select(F.posexplode("facts").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    by = {r["at"]: r["x"] for r in facts}
    model.words, model.word_tokens = int(by.get(0, 0)), int(by.get(1, 0))
    gates = len(MATCH_GATES) + 1
    seen, met = (np.array([by.get(2 + side * gates + g, 0.0) for g in range(gates)]) for side in (0, 1))
    model.match = np.clip((met + 0.5) / (seen + 1), 1e-3, 1 - 1e-3)
    shared = spark.sparkContext.broadcast(model)
    back = answers.where("source is not null").select(F.col("source").cast("int").alias("block"), "node", "payload")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(shared), RESULT)
