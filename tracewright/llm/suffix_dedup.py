"""Removal of long repeated byte strings, by distributed suffix sorting.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a
smaller doc_id.  Suffixes are compared to that depth only.

1. Anchors.  Each window of ``LENGTH`` bytes chooses the smallest hash among its ``GRAM``-byte
   grams (the rightmost of equals).  The choice depends on the window's bytes alone, so equal windows
   choose equal grams at equal places: only windows with a common anchor need to be compared.
   Windows of one document that choose the same gram are neighbours; their bytes are a segment.
2. Meeting.  Distinct (anchor hash, segment hash) pairs of each block, with the block's smallest
   doc_id, meet by anchor (:mod:`tracewright.llm.exchange`; rows in proportion to the blocks).  A segment that stands as
   a whole in a smaller document is settled: all its windows are equal suffixes of one class, told by 128 bits of hash.  One
   representative of each other class under a shared anchor sends its bytes.  An anchor with more
   than ``HOT_CLASSES`` classes is dealt further: its windows travel singly, by their first 16 bytes.
3. Deep-shallow sorting of the representatives' suffixes, which anchors (and the anchor's place in the suffix)
   deal into groups: multikey quicksort, three-way partitioning by 8-byte words, to the shallow
   depth of 16 bytes; the groups that still agree are put into blind tries, which find equal suffixes
   and give the others' order.  Neighbours in the sorted order that agree to the full depth are one class, and
   its smallest doc_id decides.
4. Marks return to the source blocks, where removed runs are counted and cut.

Texts are shuffled once, by block; the three passes over them share that exchange, and the answers of the meeting travel on with what is sent.  Blocks and
shards hold a bounded number of bytes.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; texts of any length are used
whole; a null doc_id counts as larger than every other; rows with equal doc_ids (repeated rows too) do not remove from each other;
columns other than doc_id and text are not read; an empty table gives no rows.

:func:`remove_repeats` measures the texts when it is called.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.arrays import of_planes, of_steps, planes, ramps, steps
from tracewright.llm.common import id_text, mixed
from tracewright.llm.exchange import ROW, Meeting, Tree, answer_columns, meet, rows_of

LENGTH, GRAM = 50, 20
CHOICE = LENGTH - GRAM + 1
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = (1 << 20) - 4096
NO_ID = np.iinfo(np.int64).max
_A = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Order-preserving between signed ids and the exchange's unsigned values.
_SIGN = np.uint64(1 << 63)
HOT_CLASSES = 2_000
NONE, SETTLED, SEND, SEND_DEALT = range(4)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of 2n bytes from those of n."""
    return h[:-n] * _power(n) + h[n:]


class Anchors:
    """Anchors of a block: per entry its document (row), window range, hashes, and how far behind the
    first window's start the anchor lies."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        parts: list[tuple[np.ndarray, ...]] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            parts += self._chunk(start, texts[start:end])
            start = end
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]
        self.row, self.low, self.high, self.anchor, self.segment, self.ahead = columns

    def _chunk(self, first: int, texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
        if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
            # a very long text in overlapping pieces: every window lies in one piece; the runs of
            # windows that choose one gram may be cut at a piece's end, which only splits a segment
            text, out, step = texts[0], [], CHUNK_BYTES - LENGTH + 1
            for at in range(0, len(text) - LENGTH + 1, step):
                for row, low, high, anchor, segment, ahead in self._chunk(first, [text[at : at + CHUNK_BYTES]]):
                    out.append((row, low + at, high + at, anchor, segment, ahead))
            return out
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(raw)
        if n < LENGTH:
            return []
        h1 = _BYTES[raw]
        h2 = _doubled(h1, 1)
        h4 = _doubled(h2, 2)
        h8 = _doubled(h4, 4)
        h16 = _doubled(h8, 8)
        h32 = _doubled(h16, 16)
        gram = mixed(h16[: n - GRAM + 1] * _power(4) + h4[16 : n - 3])
        low_bits = np.uint64((1 << 20) - 1)
        key = (gram & ~low_bits) | (low_bits - np.arange(len(gram), dtype=np.uint64))
        least, width = key, 1
        while 2 * width <= CHOICE:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < CHOICE:
            least = np.minimum(least[: len(key) - CHOICE + 1], least[CHOICE - width :][: len(key) - CHOICE + 1])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        # windows that stay inside their document
        good = np.zeros(n + 1, dtype=np.int32)
        wide = sizes >= LENGTH
        np.add.at(good, begins[wide], 1)
        np.add.at(good, ends[wide] - LENGTH + 1, -1)
        window = np.flatnonzero(np.cumsum(good)[: len(least)] > 0)
        if not len(window):
            return []
        chosen = least[window]
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)]
        # two documents that follow each other closely are told apart by their row
        row = np.searchsorted(ends, window, side="right")
        new[1:] |= row[1:] != row[:-1]
        at = np.flatnonzero(new)
        low, high, row = window[at], window[np.r_[at[1:], len(window)] - 1], row[at]
        place = (low_bits - (chosen[at] & low_bits)).astype(np.int64)
        size = high - low + LENGTH
        seg = h32[low] * np.uint64(0xBF58476D1CE4E5B9) + h32[low + (size - 32) // 2] * np.uint64(0x94D049BB133111EB) + h32[low + size - 32] + size.astype(np.uint64)
        # chosen hashes are small ones: they are mixed again, so that shards by their first bits are even
        return [(row + first, low - begins[row], high - begins[row], mixed(gram[place] ^ _A), mixed(seg), place - low)]


class Classes:
    """Distinct (anchor, segment) pairs of a block, in sorted order.

    Only these meet those of other blocks, so a passage that most documents share counts once for each
    block.  The first entry of a class has its smallest doc_id in the block; entries with a larger
    one are settled here already.
    """

    def __init__(self, a: Anchors, ids: np.ndarray):
        n = len(a.anchor)
        order = np.lexsort((a.segment, a.anchor))
        x, y = a.anchor[order], a.segment[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if n else np.zeros(0, bool)
        #: first entry of every class; documents stand in ascending order, so it has the smallest id
        self.first = order[new]
        self.anchor, self.segment = x[new], y[new]
        #: the class of every entry, and whether it shares the smallest doc_id
        self.of = np.empty(n, dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        own = ids[a.row]
        self.doc = own[self.first]
        self.least = own == self.doc[self.of] if n else np.zeros(0, bool)


def _block_docs(t: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Rows of a block in a repeatable order: ids as given, ids for comparing, texts."""
    ids, texts = t["doc_id"].to_pylist(), [x.encode("utf-8", "replace") for x in t["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
    ids = [ids[k] for k in order]
    return ids, np.array([NO_ID if i is None else i for i in ids], dtype=np.int64), [texts[k] for k in order]


# --- deep-shallow sorting ----------------------------------------------------------------------

SHALLOW = 16
#: Suffixes that a blind trie takes.
BLIND = 64
#: Where the words of the deep comparison begin; the last overlaps its predecessor.
DEEP_WORDS = [*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8]


def big_endian(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, first byte highest; zeros follow the end."""
    x = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
    two = (x[:-1] << np.uint64(8)) | x[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[: len(raw)]


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def multikey(order: np.ndarray, start: np.ndarray, end: np.ndarray, places: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of the ranges [start, end) of ``order`` (numbers of suffixes).

    All ranges of a round are partitioned at once around the median of three of their words: smaller
    and larger ones go on at the same depth, equal ones a word deeper.  ``order`` is sorted in
    place; returned are the ranges that are left, with start, end and whether they agree to the full depth: else they
    agree to the shallow depth and are small enough for a trie.
    """
    depth = np.zeros(len(start), dtype=np.int64)
    left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(start[:0], end[:0], np.zeros(0, bool))]
    alive = end - start > 1
    start, end, depth = start[alive], end[alive], depth[alive]
    while len(start):
        size = end - start
        own = order[np.repeat(start, size) + ramps(size)]
        key = word[places[own] + np.repeat(depth, size)]
        # of a word that reaches beyond the full depth only the bytes within count
        over = np.maximum(depth + 8 - LENGTH, 0)
        if over.any():
            key &= np.repeat(~np.uint64(0) << (8 * over).astype(np.uint64), size)
        begin = np.cumsum(size) - size
        pivot = np.repeat(_middle(key[begin], key[begin + size // 2], key[begin + size - 1]), size)
        less, same = key < pivot, key == pivot
        n_less, n_same = np.add.reduceat(less, begin, dtype=np.int64), np.add.reduceat(same, begin, dtype=np.int64)
        # stable places: within its part, a suffix follows those before it
        rank_less, rank_same = np.cumsum(less) - less, np.cumsum(same) - same
        inside = ramps(size)
        rank_less -= np.repeat(rank_less[begin], size)
        rank_same -= np.repeat(rank_same[begin], size)
        to = np.where(less, rank_less, np.where(same, np.repeat(n_less, size) + rank_same, np.repeat(n_less + n_same, size) + inside - rank_less - rank_same))
        order[np.repeat(start, size) + to] = own
        a, b = start + n_less, start + n_less + n_same
        parts = [(start, a, depth), (a, b, depth + 8), (b, end, depth)]
        start, end, depth = (np.concatenate(x) for x in zip(*parts))
        alive = end - start > 1
        start, end, depth = start[alive], end[alive], depth[alive]
        equal = depth >= LENGTH
        done = equal | ((depth >= SHALLOW) & (end - start <= BLIND))
        left.append((start[done], end[done], equal[done]))
        start, end, depth = start[~done], end[~done], depth[~done]
    return tuple(np.concatenate(x) for x in zip(*left))


def _first_bit(x: np.ndarray) -> np.ndarray:
    """How many leading zero bits each value has."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return 64 - np.bitwise_count(x).astype(np.int64)


class BlindTries:
    """Blind tries of many groups of suffixes, grown side by side.

    An inner node holds only the first bit in which its two sides differ.  A suffix follows the
    branches to some leaf, is compared with that leaf's suffix alone, and either is equal to it or
    gets a node at the first differing bit.  Each turn takes one suffix from every group; those that are
    equal to the leaf just made are taken along while a group is young.
    """

    TOGETHER = 3

    def __init__(self, raw: np.ndarray, word: np.ndarray, places: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.raw, self.word, self.places = raw, word, places
        size = end - start
        by_size = np.argsort(-size, kind="stable")
        #: groups by descending size; each has room for 2 * size nodes
        self.start, self.size = start[by_size], size[by_size]
        self.room = np.cumsum(2 * self.size) - 2 * self.size
        n = int(2 * self.size.sum())
        self.bit = np.full(n, -1, dtype=np.int64)
        self.low, self.high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.suffix = np.zeros(n, np.int64)
        self.root = self.room.copy()
        self.used = np.ones(len(self.size), dtype=np.int64)
        #: the leaf of every place in the groups, or -1
        self.leaf = np.full(len(places), -1, dtype=np.int64)
        self._grow()

    def _bit(self, suffix: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (self.raw[suffix + (bit >> 3)] >> (7 - (bit & 7)).astype(np.uint8)) & np.uint8(1)

    def _same(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffixes are equal, and else their first differing bit."""
        bit = np.full(len(a), -1, dtype=np.int64)
        for d in DEEP_WORDS:
            left = np.flatnonzero(bit < 0)
            x = self.word[a[left] + d] ^ self.word[b[left] + d]
            some = x > 0
            bit[left[some]] = 8 * d + _first_bit(x[some])
        return bit < 0, bit

    def _take_along(self, g: np.ndarray, leaf: np.ndarray) -> None:
        """Gives a leaf to all suffixes of its group that are equal to it."""
        size = self.size[g]
        at = np.repeat(self.start[g], size) + ramps(size)
        free = self.leaf[at] < 0
        at, own = at[free], np.repeat(leaf, size)[free]
        same, _ = self._same(self.places[at], self.suffix[own])
        self.leaf[at[same]] = own[same]

    def _grow(self) -> None:
        groups = np.arange(len(self.size))
        self.suffix[self.room] = self.places[self.start]
        self.leaf[self.start] = self.room
        self._take_along(groups, self.room)
        for turn in range(1, int(self.size.max(initial=0))):
            g = groups[: np.searchsorted(-self.size, -turn)]  # those with more than ``turn`` suffixes
            g = g[self.leaf[self.start[g] + turn] < 0]
            if not len(g):
                continue
            at = self.start[g] + turn
            x = self.places[at]
            found = self._follow(g, x, np.full(len(g), 8 * LENGTH))[0]
            same, bit = self._same(x, self.suffix[found])
            self.leaf[at[same]] = found[same]
            g, at, x, bit = (v[~same] for v in (g, at, x, bit))
            if not len(g):
                continue
            below, parent, side = self._follow(g, x, bit)
            leaf, inner = self.room[g] + self.used[g], self.room[g] + self.used[g] + 1
            self.used[g] += 2
            self.suffix[leaf], self.bit[inner], self.leaf[at] = x, bit, leaf
            one = self._bit(x, bit) == 1
            self.low[inner], self.high[inner] = np.where(one, below, leaf), np.where(one, leaf, below)
            top = parent < 0
            self.root[g[top]] = inner[top]
            up = ~top & (side == 0)
            self.low[parent[up]] = inner[up]
            up = ~top & (side == 1)
            self.high[parent[up]] = inner[up]
            if turn <= self.TOGETHER:
                self._take_along(g, leaf)

    def _follow(self, g: np.ndarray, x: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node reached from the root by the suffix's bits, down to a leaf or to the first node at or
        beyond bit ``until``; with its parent (-1: none) and side."""
        node, parent, side = self.root[g], np.full(len(g), -1, np.int64), np.zeros(len(g), np.int64)
        left = np.flatnonzero((self.bit[node] >= 0) & (self.bit[node] < until))
        while len(left):
            at = node[left]
            one = self._bit(x[left], self.bit[at])
            parent[left], side[left] = at, one
            node[left] = np.where(one == 1, self.high[at], self.low[at])
            bit = self.bit[node[left]]
            left = left[(bit >= 0) & (bit < until[left])]
        return node, parent, side

    def ranks(self) -> np.ndarray:
        """Number of every leaf among its group's, in the order of the suffixes, by node."""
        rank = np.zeros(len(self.bit), dtype=np.int64)
        stack = np.zeros(len(self.bit), dtype=np.int64)
        depth, given = np.ones(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        stack[self.room] = self.root
        g = np.arange(len(self.size))
        while len(g):
            node = stack[self.room[g] + depth[g] - 1]
            inner = self.bit[node] >= 0
            leaf = g[~inner]
            rank[node[~inner]] = given[leaf]
            given[leaf] += 1
            depth[leaf] -= 1
            own = g[inner]
            at = self.room[own] + depth[own] - 1
            stack[at], stack[at + 1] = self.high[node[inner]], self.low[node[inner]]
            depth[own] += 1
            g = g[depth[g] > 0]
        return rank


def _ranges(start: np.ndarray, end: np.ndarray, equal: np.ndarray) -> tuple[list, list, list]:
    """The ranges that are equal, and the others, each where there are some."""
    sides = [(side, start[equal == side], end[equal == side]) for side in (True, False)]
    sides = [x for x in sides if len(x[1])]
    return [x[1] for x in sides], [x[2] for x in sides], [x[0] for x in sides]


def suffix_sort(raw: np.ndarray, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): numbers of the suffixes at ``places`` sorted by group and then by their first
    ``LENGTH`` bytes, and whether each differs from its predecessor in that order."""
    n = len(places)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    word = big_endian(raw)
    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    start, end, equal = multikey(order, start, np.r_[start[1:], n], places, word)
    new = np.ones(n, dtype=bool)
    for x, y, same in zip(*_ranges(start, end, equal)):
        at = np.repeat(x, y - x) + ramps(y - x)
        if same:
            new[at] = ramps(y - x) == 0
            continue
        tries = BlindTries(raw, word, places[order], x, y)
        own = tries.ranks()[tries.leaf[at]]
        of = np.repeat(np.arange(len(x)), y - x)
        inside = np.lexsort((own, of))
        order[at] = order[at][inside]
        own, of = own[inside], of[inside]
        new[at] = np.r_[True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])]
    return order, new


# --- the passes ----------------------------------------------------------------------------------

SENT = "shard long, block int, payload binary"
MARKS = "block int, kind int, payload binary"
_SENT = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("payload", pa.binary())])
_MARKS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _settle(anchor, segment, doc):
    """What is to be done under each anchor: windows can be equal across documents where there is more
    than one class and more than one smallest document."""
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[start, len(anchor)])
    live = (size > 1) & (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start))
    code = np.where(live, np.where(size > HOT_CLASSES, SEND_DEALT, SEND), NONE)
    return [np.repeat(code, size).astype(np.uint64)], []


def _give(own, met, found):
    return [np.where(own > met, np.uint64(SETTLED), found[0])]


MEETING = Meeting(np.minimum, _settle, _give, 1)


def _first_pass(tree: Tree):
    def go(key, table):
        _, ids, texts = _block_docs(table)
        c = Classes(Anchors(texts), ids)
        return rows_of(tree, 1, key[0].as_py(), c.anchor, c.segment, c.doc.view(np.uint64) ^ _SIGN)

    return go


def _sendings(a: Anchors, c: Classes, texts: list[bytes], code: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows to be sorted: whole segments, or single windows under an anchor of many classes."""
    whole = np.flatnonzero(code == SEND)
    at = c.first[whole]
    runs = {
        "key": c.anchor[whole], "entry": whole, "first": np.zeros(len(at), np.int64), "windows": a.high[at] - a.low[at] + 1,
        "ahead": a.ahead[at], "row": a.row[at], "low": a.low[at], "doc": c.doc[whole],
    }
    dealt = np.flatnonzero(code == SEND_DEALT)
    if len(dealt):
        at = c.first[dealt]
        size = a.high[at] - a.low[at] + 1
        entry, at, inside = np.repeat(dealt, size), np.repeat(at, size), ramps(size)
        row, low = a.row[at], a.low[at] + inside
        begins = np.array([xxhash.xxh3_64_intdigest(texts[r][x : x + SHALLOW]) for r, x in zip(row.tolist(), low.tolist())], dtype=np.uint64)
        one = {
            "key": mixed(c.anchor[entry] ^ begins), "entry": entry, "first": inside, "windows": np.ones(len(entry), np.int64),
            "ahead": a.ahead[at] - inside, "row": row, "low": low, "doc": c.doc[entry],
        }
        runs = {k: np.concatenate([v, one[k]]) for k, v in runs.items()}
    order = np.argsort(runs["key"], kind="stable")
    return {k: v[order] for k, v in runs.items()}


def _send(tree: Tree):
    def go(key, docs, answers):
        rows = []
        if docs.num_rows and answers.num_rows:
            _, ids, texts = _block_docs(docs)
            a = Anchors(texts)
            c = Classes(a, ids)
            code = answer_columns(answers, 1)[0]
            # the answers go on to the last pass by a shard of their own
            block = key[0].as_py()
            rows.append({"shard": -1 - block, "block": block, "payload": planes(code)})
            r = _sendings(a, c, texts, code)
            shard = tree.lanes(r["key"], tree.levels)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
                own = {k: v[x:y] for k, v in r.items()}
                shape = (own["first"] | (own["windows"] << 8) | (own["ahead"] << 16)).astype(np.uint64)
                head = planes(steps(own["key"]), own["entry"].astype(np.uint64), own["doc"].view(np.uint64) ^ _SIGN, shape)
                sizes = own["windows"] + LENGTH - 1
                body = b"".join(texts[d][p : p + n] for d, p, n in zip(own["row"].tolist(), own["low"].tolist(), sizes.tolist()))
                rows.append({"shard": int(shard[x]), "block": block, "payload": struct.pack("<I", len(head)) + head + body})
        return pa.Table.from_pylist(rows, schema=_SENT)

    return go


def _sort(key, table):
    """Windows of the sent runs that a smaller document holds too, as bit masks per segment."""
    parts, bodies = [], []
    blocks = table["block"].to_pylist()
    if key[0].as_py() < 0:
        return pa.Table.from_pylist([{"block": blocks[0], "kind": 1, "payload": table["payload"][0].as_py()}], schema=_MARKS)
    for number, raw in enumerate(table["payload"]):
        raw = raw.as_py()
        (n,) = struct.unpack_from("<I", raw)
        anchor, entry, doc, shape = of_planes(raw[4 : 4 + n], 4)
        parts.append((np.full(len(entry), number), of_steps(anchor), entry.astype(np.int64), doc, shape.astype(np.int64)))
        bodies.append(raw[4 + n :])
    number, anchor, entry, doc, shape = (np.concatenate(c) for c in zip(*parts))
    first, windows, ahead = shape & 255, (shape >> 8) & 255, shape >> 16
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    del parts, bodies
    sizes = windows + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    owner, inside = np.repeat(np.arange(len(entry)), windows), ramps(windows)
    _, anchor = np.unique(anchor, return_inverse=True)
    group = anchor.ravel()[owner] * (CHOICE + 1) + (ahead[owner] - inside)
    order, new = suffix_sort(raw, begin[owner] + inside, group)
    starts = np.flatnonzero(new)
    d = doc[owner[order]]
    least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.r_[starts, len(d)])) if len(d) else d
    hit = order[d > least]
    bits = np.bincount(owner[hit], weights=2.0 ** (first[owner[hit]] + inside[hit]), minlength=len(entry)).astype(np.uint64)
    rows = []
    for k, block in enumerate(blocks):
        own = (number == k) & (bits > 0)
        if own.any():
            rows.append({"block": block, "kind": 2, "payload": planes(entry[own].astype(np.uint64), bits[own])})
    return pa.Table.from_pylist(rows, schema=_MARKS)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(with_bytes: bool):
    def go(key, docs, marks):
        given, ids, texts = _block_docs(docs)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(sizes) - sizes
        change = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
        a = Anchors(texts)
        c = Classes(a, ids)
        settled, mask = np.zeros(len(c.first), dtype=bool), np.zeros(len(c.first), dtype=np.uint64)
        for kind, raw in zip(marks["kind"].to_pylist(), marks["payload"]):
            if kind == 1:
                settled = of_planes(raw.as_py(), 1)[0] == SETTLED
            else:
                entry, bits = of_planes(raw.as_py(), 2)
                np.bitwise_or.at(mask, entry.astype(np.int64), bits)
        if len(a.row):
            at_byte = base[a.row]
            at = np.flatnonzero(~c.least | settled[c.of])
            np.add.at(change, at_byte[at] + a.low[at], 1)
            np.add.at(change, at_byte[at] + a.high[at] + LENGTH, -1)
            part = np.flatnonzero(c.least & ~settled[c.of] & (mask[c.of] > 0))
            bits = (mask[c.of[part]][:, None] >> np.arange(CHOICE, dtype=np.uint64)) & np.uint64(1)
            k, w = np.nonzero(bits)
            start = at_byte[part[k]] + a.low[part[k]] + w
            np.add.at(change, start, 1)
            np.add.at(change, start + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        out: list[list] = [[], [], [], []]
        for text, at in zip(texts, base.tolist()):
            own = gone[at : at + len(text)]
            removed = int(own.sum())
            kept = text if not removed else np.frombuffer(text, np.uint8)[~own].tobytes()
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
            for column, value in zip(out, (removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)):
                column.append(value)
        return pa.table(
            [pa.array(given, pa.int64()), pa.array(sizes), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    return go


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    own = id_text(docs)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tree = Tree(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_BYTES)))
    rows = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(tree.blocks)).cast("int"))
    first = rows.groupBy("block").applyInArrow(_first_pass(tree), ROW)
    answers = meet(first, tree, MEETING)[0].where("source is not null").select(F.col("source").cast("int").alias("block"), "node", "payload")
    sent = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(tree), SENT)
    found = sent.groupBy("shard").applyInArrow(_sort, MARKS)
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_finish(with_bytes), RESULT)
