"""Reversible line dedup: exact reference counts per line, fronted by sharded cuckoo filters.

State (:class:`LineState`): a table of counts - line key (128-bit digest of the normalised line), number of
documents that hold it - and a table of filters - for each shard of the digest space the cuckoo filter of
its frequent keys.  Both are tables, so a state is written, read again and carried on by the next batch.

:func:`insert` and :func:`delete` merge a batch's counts into the table; keys that cross the threshold
enter or leave their shard's filters, shard by shard, so a document's deletion undoes exactly
what its insertion did.  A shard whose filter is full is built anew, larger, from the exact table.

Cleaning ships the filters alone (about 2.4 bytes a key).  Lines whose key hits a filter are candidates;
distinct candidate keys are looked up in the exact table, and those that are not frequent there (false
positives, about one in 5,000) are shipped to a second pass, which drops the other hits.  Where filters or false positives
measure more than ``BROADCAST_BYTES``, (row, key) pairs go to the shards of the filters instead, and the hits
are joined with the exact table.

Documents are told apart by doc_id: rows of one doc_id count a line once; each row with a null
doc_id is a document of its own.  A batch must hold new documents (insert) or all rows of known ones (delete).

Defined cases: null or empty text is one empty line; the empty key is never dropped; texts of any length are
cleaned whole; repeated rows are cleaned each; ties cannot arise; extra columns pass through whatever their names (columns added on the way get names
that are free); an empty table gives no rows and an empty state.

:func:`clean` and :func:`dedup` run jobs when they are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import byte_slices, cut, free_prefix, schema_of, small_batches, text_slices

STRIP = " \t\n\x0b\x0c\r"
BROADCAST_BYTES = 48 << 20
SHARD_BITS = 6
COUNTS = "key binary, n_docs long"
FILTERS = "shard int, filter binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets linked by its fingerprint."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        need = max(1, int(capacity / (self.SLOTS * 0.85)) + 1)
        self.buckets = 1 << (need - 1).bit_length()
        self.table = np.zeros((self.buckets, self.SLOTS), dtype=np.uint16)
        self._turn = 0

    @property
    def count(self) -> int:
        return int((self.table > 0).sum())

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys, dtype=np.uint64)
        print_ = ((keys >> np.uint64(48)) & np.uint64(0xFFFF)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return print_, first, self._other(first, print_)

    def _other(self, bucket, print_):
        mixed = (np.asarray(print_, dtype=np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)
        return np.asarray(bucket, dtype=np.int64) ^ mixed.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self._place(keys)
        return (self.table[a] == print_[:, None]).any(axis=1) | (self.table[b] == print_[:, None]).any(axis=1)

    def insert(self, key: int) -> bool:
        """Adds one copy of ``key``; False, and nothing changed, where there is no room."""
        p, a, b = self._place(np.array([key], dtype=np.uint64))
        print_, at = p[0], int(a[0])
        for bucket in (at, int(b[0])):
            hole = np.flatnonzero(self.table[bucket] == 0)
            if len(hole):
                self.table[bucket, hole[0]] = print_
                return True
        undo = []
        for _ in range(self.KICKS):
            slot = self._turn = (self._turn + 1) % self.SLOTS
            undo.append((at, slot, self.table[at, slot]))
            print_, self.table[at, slot] = self.table[at, slot], print_
            at = int(self._other(at, print_))
            hole = np.flatnonzero(self.table[at] == 0)
            if len(hole):
                self.table[at, hole[0]] = print_
                return True
        for bucket, slot, old in reversed(undo):
            self.table[bucket, slot] = old
        return False

    def delete(self, key: int) -> bool:
        p, a, b = self._place(np.array([key], dtype=np.uint64))
        for bucket in (int(a[0]), int(b[0])):
            hit = np.flatnonzero(self.table[bucket] == p[0])
            if len(hit):
                self.table[bucket, hit[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys: list[int]) -> CuckooFilter:
        """Of all keys, as small as they go in."""
        room = max(16, len(keys))
        while True:
            out = cls(room)
            if all(out.insert(key) for key in keys):
                return out
            room *= 2

    def updated(self, leave: list[int], enter: list[int]) -> CuckooFilter | None:
        """Itself after both changes, or None where it is full."""
        for key in leave:
            if not self.delete(key):
                raise KeyError("the key was never inserted")
        return self if all(self.insert(key) for key in enter) else None

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        out = cls(0)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        out.buckets = len(out.table)
        return out


def _low(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), dtype="<u8")


def _shard(low: np.ndarray) -> np.ndarray:
    return (low & np.uint64((1 << SHARD_BITS) - 1)).astype(np.int64)


#: The same shard in SQL: the digest's first byte holds the lowest bits.
SHARD_SQL = f"cast(conv(hex(substring(key, 1, 1)), 16, 10) as int) & {(1 << SHARD_BITS) - 1}"


class ShardedFilter:
    """All shards, as they are shipped."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.shards = {s: CuckooFilter.load(raw) for s, raw in rows if raw}

    def contains(self, keys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        if keys:
            low = _low(keys)
            shard = _shard(low)
            for s in np.unique(shard).tolist():
                if s in self.shards:
                    at = np.flatnonzero(shard == s)
                    out[at] = self.shards[s].contains(low[at] >> np.uint64(SHARD_BITS))
        return out


def line_key(line: str) -> bytes:
    return line.strip(STRIP).encode("utf-8", "replace").lower()


def _digests(text: str) -> list[bytes]:
    """16-byte digest of each line's key; empty for an empty key."""
    digest = xxhash.xxh3_128_digest
    return [digest(k) if k else b"" for k in map(line_key, text.split("\n"))]


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def line_counts(docs: DataFrame) -> DataFrame:
    """(key binary, n_docs long): in how many documents each line key stands.

    Counts are made where the rows lie; only rows whose doc_id occurs more than once send (key, doc_id) pairs.
    """

    def go(batches):
        for batch in batches:
            for _, texts in byte_slices([batch.select(["doc_id", "text"])]):
                keys: list[bytes] = []
                for text in texts:
                    keys.extend({k for k in _digests(text) if k})
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    def pairs(batches):
        for ids, texts in (x for b in batches for x in byte_slices([b.select(["doc_id", "text"])])):
            rows = [(d, k) for d, t in zip(ids, texts) for k in {k for k in _digests(t) if k}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "key"])

    rows = _docs(docs)
    again = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return rows.mapInArrow(go, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    rows = rows.join(again, "doc_id", "left")
    once = rows.where("again is null").mapInArrow(go, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    more = rows.where("again").mapInArrow(pairs, "doc_id long, key binary").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    return once.unionByName(more).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


# --- state -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineState:
    """Counts of all line keys, and the filters of those in ``min_docs`` documents or more."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10) -> LineState:
        return cls(spark.createDataFrame([], COUNTS), spark.createDataFrame([], FILTERS), min_docs)

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.filters.write.mode("overwrite").parquet(f"{path}/filters")

    @classmethod
    def load(cls, spark: SparkSession, path: str, min_docs: int = 10) -> LineState:
        return cls(spark.read.schema(COUNTS).parquet(f"{path}/counts"), spark.read.schema(FILTERS).parquet(f"{path}/filters"), min_docs)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key")

    def cut(self) -> LineState:
        return LineState(cut(self.counts), cut(self.filters), self.min_docs)


def _merged(state: LineState, counts: DataFrame, sign: int) -> LineState:
    """The next state (cut): new counts, and the filters after the keys that crossed the threshold."""
    old = state.counts.select("key", F.col("n_docs").alias("was"), F.lit(0).cast("long").alias("more"))
    new = counts.select("key", F.lit(0).cast("long").alias("was"), (F.col("n_docs") * sign).alias("more"))
    both = cut(old.unionByName(new).groupBy("key").agg(F.sum("was").alias("was"), F.sum("more").alias("more")).where("was > 0 or was + more > 0"))
    after = F.col("was") + F.col("more")
    least = state.min_docs
    crossed = both.where((F.col("was") >= least) != (after >= least)).select(F.expr(SHARD_SQL).alias("shard"), "key", (after >= least).alias("enters"))

    def update(key, filters, keys):
        now = CuckooFilter.load(filters["filter"][0].as_py()) if filters.num_rows else None
        keys = keys.sort_by("key")
        low = (_low(keys["key"].to_pylist()) >> np.uint64(SHARD_BITS)).tolist() if keys.num_rows else []
        sides = [[k for k, x in zip(low, keys["enters"].to_pylist()) if x == side] for side in (False, True)]
        now = CuckooFilter.of(sides[1]) if now is None else now.updated(*sides)
        return _filter_row(key[0].as_py(), now)

    def build(key, keys):
        low = _low(sorted(keys["key"].to_pylist())) >> np.uint64(SHARD_BITS)
        return _filter_row(key[0].as_py(), CuckooFilter.of(low.tolist()))

    counts = both.select("key", after.alias("n_docs")).where("n_docs > 0")
    filters = cut(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(update, FILTERS))
    full = filters.where("filter is null").select("shard")
    if not full.isEmpty():
        keys = counts.where(F.col("n_docs") >= least).select(F.expr(SHARD_SQL).alias("shard"), "key").join(F.broadcast(full), "shard", "left_semi")
        filters = cut(filters.where("filter is not null").unionByName(keys.groupBy("shard").applyInArrow(build, FILTERS)))
    return LineState(counts, filters, least)


def _filter_row(shard: int, now: CuckooFilter | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([None if now is None else now.dump()], pa.binary())})


def insert(state: LineState, docs: DataFrame) -> LineState:
    return _merged(state, line_counts(docs), 1)


def delete(state: LineState, docs: DataFrame) -> LineState:
    return _merged(state, line_counts(docs), -1)


# --- cleaning --------------------------------------------------------------------------------------


def clean(docs: DataFrame, state: LineState, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns kept, their text without the dropped lines, and after them two
    long columns: how many lines the text had, and how many of them were dropped.

    ``state`` is best cut from its lineage first: it is read more than once here.
    """
    names = docs.columns
    docs = small_batches(docs).withColumn("text", F.coalesce(docs["text"].cast("string"), F.lit("")))
    size = state.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size > broadcast_bytes:
        return _clean_far(docs, state)
    shared = docs.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["filter"])) for r in state.filters.collect()])

    def candidates(batches):
        known = ShardedFilter(shared.value)
        for _, texts in byte_slices(batches):
            keys = list({k for t in texts for k in _digests(t) if k})
            hit = known.contains(keys)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, h in zip(keys, hit) if h], pa.binary())], names=["key"])

    hits = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(candidates, "key binary").distinct()
    wrong = cut(hits.join(state.frequent(), "key", "left_anti"))
    if wrong.count() * 64 > broadcast_bytes:
        return _clean_far(docs, state)
    false = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in wrong.collect()))

    added = _added(docs)

    def go(batches):
        known, not_these = ShardedFilter(shared.value), false.value
        for batch in text_slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            digests = [_digests(t) for t in texts]
            keys = list({k for x in digests for k in x if k})
            drop = {k for k, h in zip(keys, known.contains(keys)) if h} - not_these
            yield _with_lines(batch, names, added, [_cleaned(t, own, drop) for t, own in zip(texts, digests)])

    return docs.mapInArrow(go, _schema(docs))


def _cleaned(text: str, digests: list[bytes], drop: set[bytes]) -> tuple[int, int, str]:
    gone = [k in drop for k in digests]
    n = sum(gone)
    return len(digests), n, "\n".join(x for x, g in zip(text.split("\n"), gone) if not g) if n else text


def _added(docs: DataFrame) -> tuple[str, str]:
    p = free_prefix(docs, "_l_")
    return f"{p}n_lines", f"{p}n_dropped"


def _with_lines(batch: pa.RecordBatch, names: list[str], added: tuple[str, str], results: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n, gone, text = zip(*results)
    cols = [pa.array(text, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
    return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, *added])


def _schema(docs: DataFrame):
    n, gone = _added(docs)
    return schema_of(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {n} long, {gone} long")


def _clean_far(docs: DataFrame, state: LineState) -> DataFrame:
    """The same by shards: (row, key) pairs meet the filters of their shard, hits are joined with the exact
    table and return to their rows.

    Pairs are spread by a salt, over which filters and frequent keys are copied.
    """
    salts, names = 16, docs.columns
    p = free_prefix(docs, "_l_")
    row, gone_col = f"{p}row", f"{p}gone"
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))

    def keys_of(batches):
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = sorted({k for k in _digests(text) if k})
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(keys)), pa.array(keys, pa.binary())], names=["row", "key"])

    def probe(key, filters, pairs):
        keys = pairs["key"].to_pylist()
        hit = CuckooFilter.load(filters["filter"][0].as_py()).contains(_low(keys) >> np.uint64(SHARD_BITS)) if filters.num_rows and keys else np.zeros(len(keys), bool)
        return pairs.select(["row", "key", "salt"]).filter(pa.array(hit))

    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    pairs = rows.select(F.col(row).alias("row"), "text").mapInArrow(keys_of, "row long, key binary")
    pairs = pairs.withColumns({"shard": F.expr(SHARD_SQL), "salt": F.pmod(F.xxhash64("row"), F.lit(salts))})
    hits = state.filters.select("shard", "filter", salt).groupBy("shard", "salt").cogroup(pairs.groupBy("shard", "salt")).applyInArrow(probe, "row long, key binary, salt long")
    hits = hits.join(state.frequent().select("key", salt), ["key", "salt"], "left_semi").groupBy("row").agg(F.collect_list("key").alias(gone_col))
    joined = rows.join(hits, rows[row] == hits["row"], "left").select(*[F.col(f"`{c}`") for c in names], gone_col)

    added = _added(docs)

    def go(batches):
        for batch in text_slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            drops = batch.column(batch.num_columns - 1).to_pylist()
            yield _with_lines(batch, names, added, [_cleaned(t, _digests(t), set(gone or ())) for t, gone in zip(texts, drops)])

    return joined.mapInArrow(go, _schema(docs))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The state of ``docs`` alone, and ``docs`` cleaned with it."""
    return clean(docs, insert(LineState.empty(docs.sparkSession, min_docs), docs))
