"""Meeting of keyed entries from many blocks, with an answer for each entry back to its block.

Every block holds sorted distinct entries (key, sub-key, value), 64 bits each.  Entries of one key
meet in one shard; equal entries are combined on the way.  Rows of the exchange hold runs of entries,
and their number grows in proportion to the blocks: instead of a row for each pair of block and shard,
entries climb a tree of nodes with a fixed fan.  A node of level ``l`` takes the entries whose keys
agree in the first ``l * fan_bits`` bits from ``2 ** (l * fan_bits)`` neighbouring blocks, so it holds
about as much as one block, and sends at most ``2 ** fan_bits`` rows.  Up to ``2 ** fan_bits`` blocks
meet in one step.  Answers go down the same tree.

A key that all blocks hold arrives in a shard once for each node below it, not once for each block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.arrays import of_planes, of_steps, planes, steps

FAN_BITS = 7
ROW = "node long, source long, payload binary"
ANSWER = "source long, node long, payload binary, facts array<double>"
_ROW = pa.schema([("node", pa.int64()), ("source", pa.int64()), ("payload", pa.binary())])
_ANSWER = pa.schema([("source", pa.int64()), ("node", pa.int64()), ("payload", pa.binary()), ("facts", pa.list_(pa.float64()))])

Columns = list[np.ndarray]


@dataclass(frozen=True)
class Tree:
    blocks: int
    fan_bits: int = FAN_BITS

    @property
    def bits(self) -> int:
        """Shards are told apart by so many first bits of the key."""
        return max(1, (self.blocks - 1).bit_length())

    @property
    def levels(self) -> int:
        return -(-self.bits // self.fan_bits)

    def lane_bits(self, level: int) -> int:
        return min(self.bits, level * self.fan_bits)

    def groups(self, level: int) -> int:
        return 1 if level == self.levels else -(-self.blocks // 2 ** (level * self.fan_bits))

    def lanes(self, key: np.ndarray, level: int) -> np.ndarray:
        return (key >> np.uint64(64 - self.lane_bits(level))).astype(np.int64)

    def node(self, level: int, lane, group: int):
        return lane * self.groups(level) + group

    def group_of(self, level: int, node: int) -> int:
        """The number, one level below, of what a node of ``level`` (0: a block) stands for."""
        return node % self.groups(level) if level else node


@dataclass(frozen=True)
class Meeting:
    """What happens to entries that meet.

    ``combine``: the function that folds values of equal entries.  ``settle``: from the sorted
    distinct entries of a shard to its answer columns and facts (numbers to be summed over shards).
    ``give``: from a child's values, the values met and the answers met, both per entry of the child,
    to the child's answers.
    """

    combine: np.ufunc
    settle: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[Columns, list[float]]]
    give: Callable[[np.ndarray, np.ndarray, Columns], Columns]
    answers: int


def _pack(key, sub, value) -> bytes:
    return planes(steps(key), sub, value)


def _entries(raw: bytes) -> Columns:
    key, sub, value = of_planes(raw, 3)
    return [of_steps(key), sub, value]


def rows_of(tree: Tree, level: int, source: int, key: np.ndarray, sub: np.ndarray, value: np.ndarray) -> pa.Table:
    """Sorted entries of a source below ``level`` as its rows to the nodes there."""
    lane = tree.lanes(key, level)
    at = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]]) if len(lane) else np.zeros(0, np.int64)
    group = tree.group_of(level - 1, source) >> tree.fan_bits if level < tree.levels else 0
    rows = [
        {"node": tree.node(level, int(lane[a]), group), "source": source, "payload": _pack(key[a:b], sub[a:b], value[a:b])}
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(lane)])
    ]
    return pa.Table.from_pylist(rows, schema=_ROW)


class _Merged:
    """The children's entries of a node, combined; ``of`` is the place of each child entry among them."""

    def __init__(self, table: pa.Table, meeting: Meeting):
        table = table.sort_by("source")
        self.sources = table["source"].to_pylist()
        parts = [_entries(x.as_py()) for x in table["payload"]]
        self.sizes = [len(p[0]) for p in parts]
        key, sub, self.own = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((sub, key))
        key, sub, value = key[order], sub[order], self.own[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.key, self.sub = key[first], sub[first]
        self.value = meeting.combine.reduceat(value, first) if len(first) else value
        self.of = np.empty(len(key), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1

    def answers(self, node: int, meeting: Meeting, found: Columns) -> list[dict]:
        got = meeting.give(self.own, self.value[self.of], [c[self.of] for c in found])
        rows, at = [], 0
        for source, n in zip(self.sources, self.sizes):
            rows.append({"source": source, "node": node, "payload": planes(*(c[at : at + n].astype(np.uint64) for c in got)), "facts": None})
            at += n
        return rows


def _climb(tree: Tree, level: int, meeting: Meeting):
    def go(key, table):
        node, m = key[0].as_py(), _Merged(table, meeting)
        return rows_of(tree, level + 1, node, m.key, m.sub, m.value)

    return go


def _top(meeting: Meeting):
    def go(key, table):
        node, m = key[0].as_py(), _Merged(table, meeting)
        found, facts = meeting.settle(m.key, m.sub, m.value)
        rows = m.answers(node, meeting, found)
        rows[0]["facts"] = [float(x) for x in facts]
        return pa.Table.from_pylist(rows, schema=_ANSWER)

    return go


def answer_columns(table: pa.Table, columns: int) -> Columns:
    """Answers of one source, in the order of its entries."""
    parts = [of_planes(x.as_py(), columns) for x in table.sort_by("node")["payload"]]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.uint64)] * columns


def _descend(meeting: Meeting):
    def go(key, table, above):
        node, m = key[0].as_py(), _Merged(table, meeting)
        rows = m.answers(node, meeting, answer_columns(above, meeting.answers))
        return pa.Table.from_pylist(rows, schema=_ANSWER)

    return go


def meet(entries: DataFrame, tree: Tree, meeting: Meeting) -> tuple[DataFrame, list[DataFrame]]:
    """(answers, the rows of every level).  ``entries`` are rows of level 1, made by :func:`rows_of`.

    Answers (source = block) with ``facts`` in some rows; facts of the lower levels are not repeated.
    """
    up = [entries]
    for level in range(1, tree.levels):
        up.append(up[-1].groupBy("node").applyInArrow(_climb(tree, level, meeting), ROW))
    down = up[-1].groupBy("node").applyInArrow(_top(meeting), ANSWER)
    facts = down.where("facts is not null").select("facts") if tree.levels > 1 else None
    for level in range(tree.levels - 1, 0, -1):
        down = up[level - 1].groupBy("node").cogroup(down.groupBy("source")).applyInArrow(_descend(meeting), ANSWER)
    if facts is not None:
        empty = "cast(null as long) as source", "cast(null as long) as node", "cast(null as binary) as payload", "facts"
        down = down.unionByName(facts.selectExpr(*empty))
    return down, up
