"""Whole-text encoding with a public byte-level BPE vocabulary, and a patched frame-of-reference
file format for the ids.

Encoding: a pre-token of this vocabulary holds a space only as its first character, or is white
space alone.  So a text whose white space is single spaces and line feeds can be cut before each of
them, the pieces encoded once by the tokenizers library and remembered; other texts are encoded
whole.  Both ways give the library's ids exactly.

Format of one shard (little-endian, :func:`encode_shard`): magic ``TWPF``, id count (u8), block
size (u4), block count (u4); per block u4 minimum, u1 width, u2 number of exceptions; then u8 byte
offset of every block's packed words; packed words; exception positions (u2) and their full
differences (u4).  Within a block every id loses the block's minimum and is packed at the width
that covers the given percentile; larger differences ("exceptions") are patched in after unpacking.

Defined cases: null text is empty (end id only); texts of any length are encoded whole; rows stand in
the order of doc_id, nulls first, and of one doc_id in the order of their text's hash; repeated rows are kept; columns other than
doc_id and text are not read; an empty table writes no shard and gives no rows.

:func:`token_table` writes the files when it is called.  Rows of one doc_id and one text go to one task.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.arrays import ramps
from tracewright.llm.common import byte_slices, id_text, scratch

BLOCK = 256
#: Ids in one shard row at most (a longer document alone may exceed it).
SHARD_IDS = 2_000_000
PERCENTILE = 98
#: Pieces that an encoder remembers at most, in two generations: a piece stays while it is met again.
CACHE_PIECES = 600_000
SLICE_BYTES = 3 << 20


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of whole texts; remembers the ids of pieces between single spaces and line feeds.

    Pieces are numbered; their ids stand one after another in ``flat``.  A slice of texts is split and
    numbered in one go, so that only its distinct pieces are looked up.  When ``CACHE_PIECES`` are known,
    those that were not met since the last such moment are forgotten.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # words of letters alone are one pre-token each: they go to the library's model directly, in the
        # vocabulary's own alphabet for bytes, without a search for bounds
        plain = spec.get("pre_tokenizer") or {}
        known = plain.get("type") == "ByteLevel" and plain.get("use_regex", True) and not plain.get("add_prefix_space") and not spec.get("normalizer")
        self.feed = self._ids("\n") if known else []
        self.regular = len(self.feed) == 1
        self.marks = {m: ids[0] for m in MARKS if len(ids := self._ids(m)) == 1}
        ending = "".join(self.marks)
        self.lettered = rf"^\n?[{LETTERS}]+[{ending}]?$" if ending else rf"^\n?[{LETTERS}]+$"
        self.ending = ending
        self.words = self.tokenizer.model
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int32)
        self.met = np.zeros(1 << 14, dtype=bool)
        self.used = 0

    def _age(self) -> None:
        """Keeps the pieces met since the last call, and as few as half of the room at most."""
        n = len(self.known)
        stay = self.met[:n]
        if 2 * int(stay.sum()) > CACHE_PIECES:
            return self._forget()
        names = [name for name, number in self.known.items() if stay[number]]
        old = np.array([self.known[name] for name in names], dtype=np.int64)
        size = self.length[old].astype(np.int64)
        flat = self.flat[np.repeat(self.start[old], size) + ramps(size)]
        self._forget()
        self._add(names, flat, size)
        self.met[:] = False

    def _add(self, names: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        first, many = len(self.known), len(names)
        self.flat = _grown(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start, self.length, self.met = (_grown(x, first + many + 1) for x in (self.start, self.length, self.met))
        self.start[first : first + many], self.length[first : first + many] = self.used + np.cumsum(size) - size, size
        self.met[first : first + many] = False
        self.used += len(flat)
        self.known.update(zip(names, range(first, first + many)))

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _model_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that are one pre-token each, and how many each has."""
        ids: list[int] = []
        sizes: list[int] = []
        tokenize = self.words.tokenize
        for word in "\n".join(words).encode("utf-8").decode("latin-1").translate(ALPHABET).split(ALPHABET[10]) if words else ():
            got = tokenize(word)
            sizes.append(len(got))
            ids += [t.id for t in got]
        return np.array(ids, dtype=np.uint32), np.array(sizes, dtype=np.int64)

    def _stem_ids(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, but words that are known as pieces without a mark are not encoded again."""
        number = np.array([self.known.get(x[1:], -1) if x[0] == " " else -1 for x in stems], dtype=np.int64)
        old = number >= 0
        ids, size = self._model_ids([x for x, k in zip(stems, old.tolist()) if not k])
        sizes = np.empty(len(stems), dtype=np.int64)
        sizes[~old], sizes[old] = size, self.length[number[old]]
        begin = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        out[np.repeat(begin[~old], size) + ramps(size)] = ids
        known = sizes[old]
        out[np.repeat(begin[old], known) + ramps(known)] = self.flat[np.repeat(self.start[number[old]], known) + ramps(known)]
        return out, sizes

    def _text_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words that hold no line feed: one text of them, line by line, whose line feeds tell them apart."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            own = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(own == self.feed[0])
            if len(ends) == len(part) - 1:
                ids.append(np.delete(own, ends))
                sizes.append(np.diff(np.r_[-1, ends, len(own)]) - 1)
            else:
                each = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids += each
                sizes.append(np.array([len(e) for e in each]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, names: pa.Array, pieces: list[str]) -> None:
        """``names`` are ``pieces``.  They stand after a space, or begin with a line feed; a final mark after letters is a
        pre-token of its own, so words are encoded without it."""
        fed = pc.starts_with(names, "\n").to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(names, self.lettered).to_numpy(zero_copy_only=False)
        last = np.full(len(pieces), -1, dtype=np.int64)
        for mark, number in self.marks.items():
            last[pc.ends_with(names, mark).to_numpy(zero_copy_only=False) & plain] = number
        # stems: words without line feed and mark, after their space
        core = pc.if_else(pa.array(plain), pc.utf8_trim(names, "\n" + self.ending), pc.utf8_ltrim(names, "\n"))
        # only the first line feed is the piece's own; the others' pieces are taken as they are
        core = pc.if_else(pa.array(~plain & fed), pc.utf8_slice_codeunits(names, 1), core)
        stems = pc.binary_join_element_wise(pc.if_else(pa.array(fed), "", " "), core, "")
        own = pc.if_else(pa.array(plain), stems, None).dictionary_encode()
        rest = pc.if_else(pa.array(plain), None, stems).dictionary_encode()
        a, b = self._stem_ids(own.dictionary.to_pylist()), self._text_ids(rest.dictionary.to_pylist())
        ids, size = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        begin = np.cumsum(size) - size
        fill = lambda d: pc.fill_null(d.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        stem = np.where(plain, fill(own), len(own.dictionary) + fill(rest))
        n = size[stem] + fed + (last >= 0)
        ends = np.cumsum(n)
        out = np.zeros(int(n.sum()), dtype=np.uint32)
        inner = np.repeat(ends - n + fed, size[stem]) + ramps(size[stem])
        out[inner] = ids[np.repeat(begin[stem], size[stem]) + ramps(size[stem])]
        out[(ends - n)[fed]] = self.feed[0]
        out[(ends - 1)[last >= 0]] = last[last >= 0]
        self._add(pieces, out, n)

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct pieces of regular texts, one after another, and how many each has.

        Pieces stand after a space, or begin with their line feed; ``regular`` must hold."""
        if len(self.known) > CACHE_PIECES:
            self._age()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(pa.array(new, pa.string()), new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met[at] = True
        size = self.length[at].astype(np.int64)
        return self.flat[np.repeat(self.start[at], size) + ramps(size)], size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u4 ids of every text."""
        out: list[bytes] = [b""] * len(texts)
        if len(self.known) > CACHE_PIECES:
            self._age()
        regular = [k for k, t in enumerate(texts) if t and self.regular and _regular(t)]
        known = set(regular)
        odd = [k for k, t in enumerate(texts) if t and k not in known]
        for k, ids in zip(odd, self.whole([texts[k] for k in odd]) if odd else ()):
            out[k] = ids
        if not regular:
            return out
        # a text is taken as if after a line feed, whose id is then cut off
        whole = "".join(f"\n{texts[k]}" for k in regular).replace("\n", " \n")
        pieces = pc.split_pattern(pa.array([whole], pa.large_string()), " ").flatten().slice(1).dictionary_encode()
        del whole
        # no piece holds a space: the distinct ones come over as one string
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary.cast(pa.string())), " ")[0].as_py().split(" ")
        distinct = np.array(list(map(self.known.get, names, repeat(-1))), dtype=np.int32)
        new = np.flatnonzero(distinct < 0)
        self.met[distinct] = True  # -1 is the last place, which no piece holds yet
        if len(new):
            first = len(self.known)
            self._learn(pieces.dictionary.take(pa.array(new)).cast(pa.string()), [names[k] for k in new.tolist()])
            distinct[new] = np.arange(first, first + len(new))
        at = distinct[pieces.indices.to_numpy()]
        size = self.length[at]
        ends = np.cumsum(size, dtype=np.int64)
        # place in ``flat`` of every id: where its piece begins there, less where it begins here
        flat = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]))]
        last = np.cumsum([texts[k].count(" ") + texts[k].count("\n") + 1 for k in regular]) - 1
        begin = 0
        for k, end in zip(regular, ends[last].tolist()):
            out[k] = flat[begin + 1 : end].tobytes()
            begin = end
        return out


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}


ALPHABET = _alphabet()
#: Marks that end a word in running text.
MARKS = ",.;:!?"
#: Letters below U+0250, for a character class; words with others are encoded as any text is.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: White space other than space and line feed, as Unicode and Python know it.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_ASCII_SPACE = _OTHER_SPACE[:8]


def _regular(text: str) -> bool:
    """Only single spaces and line feeds, none of them at an end."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE))


_ENCODERS: dict[str, Encoder] = {}


def forget_encoders() -> None:
    """Gives a worker's memory of encoders back to the machine, before work of another kind."""
    import ctypes
    import gc

    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the format --------------------------------------------------------------------------------


def _widths(diff: np.ndarray, percentile: float) -> np.ndarray:
    k = min(diff.shape[1] - 1, int(np.ceil(diff.shape[1] * percentile / 100)) - 1)
    top = np.partition(diff, k, axis=1)[:, k]
    return np.maximum(1, np.ceil(np.log2(top.astype(np.float64) + 1))).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 64) values below 2**width to (m, width) u8 words."""
    v = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((width, v.shape[1]), dtype=np.uint64)
    for j in range(64):
        word, off = divmod(j * width, 64)
        out[word] |= v[j] << np.uint64(off)
        if off + width > 64:
            out[word + 1] |= v[j] >> np.uint64(64 - off)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, w.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, off = divmod(j * width, 64)
        x = w[word] >> np.uint64(off)
        if off + width > 64:
            x = x | (w[word + 1] << np.uint64(64 - off))
        out[j] = x & mask
    return np.ascontiguousarray(out.T)


def encode_shard(ids: np.ndarray, percentile: float = PERCENTILE, block: int = BLOCK) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    padded = np.empty(blocks * block, dtype=np.uint32)
    padded[:n] = ids
    if n < len(padded):
        padded[n:] = padded[n - 1]
    rows = padded.reshape(blocks, block)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None] if blocks else rows
    width = _widths(diff, percentile) if blocks else np.zeros(0, np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    big = diff > limit[:, None] if blocks else np.zeros((0, block), bool)
    per = block // 64
    size = width.astype(np.int64) * per * 8
    start = np.zeros(blocks, dtype=np.int64)
    if blocks:
        start[1:] = np.cumsum(size)[:-1]
    packed = np.zeros(int(size.sum()) // 8, dtype=np.uint64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        low_bits = diff[at] & np.uint32((1 << int(w)) - 1 if w < 32 else 0xFFFFFFFF)
        words = _pack(low_bits.reshape(-1, 64), int(w)).reshape(len(at), -1)
        packed[start[at][:, None] // 8 + np.arange(words.shape[1])[None, :]] = words
    r, c = np.nonzero(big)
    head = struct.pack("<4sQII", b"TWPF", n, block, blocks)
    parts = [low.astype("<u4"), width.astype("<u1"), big.sum(axis=1).astype("<u2"), start.astype("<u8")]
    return b"".join([head, *(x.tobytes() for x in parts), packed.astype("<u8", copy=False).tobytes(), c.astype("<u2").tobytes(), diff[r, c].astype("<u4").tobytes()])


def decode_shard(blob: bytes) -> np.ndarray:
    magic, n, block, blocks = struct.unpack_from("<4sQII", blob)
    if magic != b"TWPF":
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sQII")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    low, width, odd, start = take("<u4", blocks), take("<u1", blocks), take("<u2", blocks), take("<u8", blocks).astype(np.int64)
    per = block // 64
    packed = take("<u8", int((width.astype(np.int64) * per).sum()))
    diff = np.empty((blocks, block), dtype=np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        words = packed[start[rows][:, None] // 8 + np.arange(int(w) * per)[None, :]]
        diff[rows] = _unpack(words, int(w)).reshape(len(rows), block)
    total = int(odd.sum())
    column, value = take("<u2", total), take("<u4", total)
    diff[np.repeat(np.arange(blocks), odd), column] = value
    return (diff + low[:, None]).ravel()[:n] if blocks else np.zeros(0, np.uint32)


# --- tables ------------------------------------------------------------------------------------


def encoded(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[list, list[bytes]]]]:
    def go(batches):
        enc = encoder(vocabulary)
        for ids, texts in byte_slices(batches, SLICE_BYTES):
            yield ids, enc.encode(texts)

    return go


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` in ascending doc_id order into a table of shard files at ``path``.

    Texts are range-partitioned once by (doc_id, text hash); (part, seq) orders the shards.
    """
    ordered = (
        id_text(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .select("doc_id", "text")
    )
    out_schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())]
    )

    def write(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        docs_, counts, held, n = [], [], [], 0

        def shard():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "n_ids": n, "doc_ids": docs_, "counts": counts, "payload": encode_shard(ids)}], schema=out_schema
            )

        for ids, blobs in encoded(vocabulary)(batches):
            for doc_id, blob in zip(ids, blobs):
                held += [blob, end]
                size = len(blob) // 4 + 1
                docs_.append(doc_id)
                counts.append(size)
                n += size
                if n >= shard_ids:
                    yield shard()
                    seq, docs_, counts, held, n = seq + 1, [], [], [], 0
        if docs_:
            yield shard()

    # packed ids still hold what frequent ids leave: the lightest zstd takes a quarter
    shards = ordered.mapInArrow(write, SHARD_SCHEMA).write
    shards.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)


SHARD_SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, counts array<long>, payload binary"


def read_shards(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    Starts come from a running sum over one small row per shard, joined to the decoded rows by
    shard; payloads are never shuffled.
    """
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # running sums in two levels: shards within a part, then parts
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_start = parts.select("part", F.coalesce(F.sum("part_ids").over(upto), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("seq_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(part_start, "part")
        .select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    )

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_shard(row["payload"])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                counts = np.array(row["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                begins = ends - counts
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                k = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["seq"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(decode, "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("local_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_table(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the shard files (under the shared checkpoint folder unless ``path``) and read them back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-shards")
    write_shards(docs, path, vocabulary or public_vocabulary(), end_id)
    return read_shards(spark, path)
