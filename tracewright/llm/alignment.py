"""Alignment of two tokenizers over the same texts, and how often their tokens end together.

A text is encoded by a byte-level BPE (A, over a space and the text) and by a SentencePiece model (B,
over the text; it sets the space itself).  Where a token of each ends at one byte, both sequences are
cut into groups; the two tokens that end there are a link.  A link's key is one int64: B's id in the
upper, A's id in the lower 32 bits.

Passes: (1) slices of texts are encoded and cut; a slice's distinct words are aligned once (neither
vocabulary joins across a space or line feed, so regular texts can be cut there; others are aligned
whole), and the slice is written as word numbers with the words' links; (2) ``np.unique`` counts of a
partition, a range partition by B's id with a sort by key, and sums of runs give sorted shards of
(key, count, highest count of the B id); (3) the shards become raw files in the shared folder, which
Spark hands to every executor once; tasks map them into memory and look up their slices' distinct
keys by ``searchsorted``.

Bound of the shards: of two tokens that end together one's bytes are the other's last bytes, so pairs
are at most the suffix pairs of the two vocabularies (:func:`most_pairs`, some hundred thousand for
public ones), whatever the corpus.  Texts are never shuffled.

Defined cases: a null or empty text, and one whose tokens' bytes differ from space and text (U+2581
in it, which B takes for a space), has no tokens: zeros and an empty string.  Strings of special tokens
are plain text.  Texts of any length are aligned whole.  Repeated rows count each; a null id stays null;
columns other than doc_id and text are not read; an empty table gives no rows.

:func:`score` and :func:`pair_counts` write the slices when they are called.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.arrays import of_planes, planes, ramps
from tracewright.llm.common import byte_slices, id_text, scratch, shared_folder
from tracewright.llm.tokens import ALPHABET, Encoder, _regular, public_vocabulary

#: Words that an aligner remembers at most.
KNOWN_WORDS = 400_000
#: Words that are encoded together, one to a line.
TOGETHER = 2_000
SLICE_BYTES = 3 << 20
#: Bytes of a file of shards.
FILE_BYTES = 4 << 20
SPACE = "▁"


# --- vocabularies --------------------------------------------------------------------------------


class Bytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.repeat(self.start[ids], size) + ramps(size)]


def byte_level(path: str) -> list[bytes]:
    """Tokens of a byte-level vocabulary by id; unused ids are empty."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = dict(spec["model"]["vocab"])
    plain = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    back = {c: b for b, c in ALPHABET.items()}
    out = [b""] * (max([*known.values(), *plain.values()]) + 1)
    for token, number in known.items():
        out[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    for token, number in plain.items():
        out[number] = token.encode()
    return out


def pieces_of(model) -> list[bytes]:
    """Tokens of a SentencePiece model by id; control tokens are empty."""
    out = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(k) or model.is_unknown(k) else piece.replace(SPACE, " ").encode())
    return out


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """Pairs of a token of each vocabulary of which one ends with the other: a bound of the links' kinds."""

    def ends(tokens: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for t in filter(None, tokens):
            out[t] = out.get(t, 0) + 1
        return out

    of_a, of_b = ends(a), ends(b)
    below = sum(of_b.get(t[k:], 0) for t in filter(None, a) for k in range(len(t)))
    return below + sum(of_a.get(t[k:], 0) for t in filter(None, b) for k in range(1, len(t)))


# --- alignment -----------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Texts or words: token and group counts, links one after another, and groups as written text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    a: np.ndarray
    b: np.ndarray
    #: ``a1,a2|b1;`` for every group; empty where the bytes differ.
    written: list[bytes] = field(default_factory=list)


class Aligner:
    """Aligns slices of texts; remembers words."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = Encoder(path_a)
        self.first = self.encoder.tokenizer
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.of_a, self.of_b = Bytes(byte_level(path_a)), Bytes(pieces_of(self.second))
        na, nb = len(self.of_a.tokens), len(self.of_b.tokens)
        digits_a, digits_b = list(map(str, range(na))), list(map(str, range(nb)))
        marks = [digits_a, ","], [digits_a, "|"], [digits_b, ","], [digits_b, ";"]
        self.written = pa.array([x + mark for digits, mark in marks for x in digits], pa.large_string())
        # B's words can be told apart by line feeds if these are one token that stands alone
        feed = self.second.encode("\n")
        self.feed, self.lines = feed[-1], self.encoder.regular and len(feed) == 2
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.store = Aligned(*(np.zeros(0, np.int64) for _ in range(5)))
        self.ends = np.zeros(0, np.int64)

    def _a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x for e in each for x in e], dtype=np.int64), np.array([len(e) for e in each], dtype=np.int64)

    def _by_line(self, words: list[str], fed: bool) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of words that are encoded one to a line; ``fed``: line feeds are their words' first token."""
        ids = self.second.encode("".join(words) if fed else "\n ".join(words), num_threads=1)
        own = np.array(ids[1:] if fed else ids, dtype=np.int64)
        at = np.flatnonzero(own == self.feed)
        if fed and len(at) == len(words) and at[0] == 0:
            return own, np.diff(np.r_[at, len(own)])
        if not fed and len(at) == len(words) - 1:
            return np.delete(own, at), np.diff(np.r_[-1, at, len(own)]) - 1
        return self._flat([e[1:] if fed else e for e in self.second.encode(words, num_threads=1)])

    def _words(self, words: list[str], fed: bool) -> Aligned:
        """``words`` stand after a space, or begin with a line feed (``fed``)."""
        a, a_sizes = self.encoder.pieces(words)
        b, b_sizes = (np.concatenate(c) for c in zip(*(self._by_line(words[at : at + TOGETHER], fed) for at in range(0, len(words), TOGETHER))))
        return self._aligned([w.encode() if fed else b" " + w.encode() for w in words], a.astype(np.int64), a_sizes, b, b_sizes)

    def whole(self, texts: list[str]) -> Aligned:
        a, b = self._flat(self._a([f" {t}" for t in texts])), self._flat(self.second.encode(texts, num_threads=1))
        return self._aligned([b" " + t.encode("utf-8", "replace") for t in texts], *a, *b)

    def _same(self, of: Bytes, ids: np.ndarray, owner: np.ndarray, expected: list[bytes], flat: np.ndarray) -> np.ndarray:
        """For every text whether its tokens' bytes are the expected ones."""
        want = np.array([len(x) for x in expected], dtype=np.int64)
        good = np.bincount(owner, of.size[ids], len(expected)).astype(np.int64) == want
        got = of.joined(ids[good[owner]])
        text = np.repeat(np.arange(len(expected)), want)
        inside = good[text]
        wrong = text[inside][got != flat[inside]]
        good[wrong] = False
        return good

    def _aligned(self, expected: list[bytes], a, a_sizes, b, b_sizes) -> Aligned:
        n = len(expected)
        own_a, own_b = np.repeat(np.arange(n), a_sizes), np.repeat(np.arange(n), b_sizes)
        flat = np.frombuffer(b"".join(expected), dtype=np.uint8)
        good = self._same(self.of_a, a, own_a, expected, flat) & self._same(self.of_b, b, own_b, expected, flat)
        a, own_a, b, own_b = a[good[own_a]], own_a[good[own_a]], b[good[own_b]], own_b[good[own_b]]
        end_a, end_b = np.cumsum(self.of_a.size[a]), np.cumsum(self.of_b.size[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        last_a, last_b = np.isin(end_a, common, assume_unique=True), np.isin(end_b, common, assume_unique=True)
        # groups in order, within a group A's tokens before B's
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        which = np.empty(len(a) + len(b), dtype=np.int64)
        na, nb = len(self.of_a.tokens), len(self.of_b.tokens)
        which[place_a], which[place_b] = a + na * last_a, 2 * na + b + nb * last_b
        n_a, n_b = np.bincount(own_a, minlength=n), np.bincount(own_b, minlength=n)
        text = self.written.take(pa.array(which))
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[: len(text) + 1]
        raw = memoryview(text.buffers()[2] or b"")
        cuts = offsets[np.r_[0, np.cumsum(n_a + n_b)]].tolist()
        return Aligned(
            n_a, n_b, np.bincount(own_a[last_a], minlength=n), a[last_a], b[last_b],
            [bytes(raw[x:y]) for x, y in zip(cuts, cuts[1:])],
        )

    def _learn(self, words: list[str]) -> None:
        for fed in (False, True):
            own = [w for w in words if w.startswith("\n") == fed]
            if own:
                got, s, first = self._words(own, fed), self.store, len(self.known)
                self.store = Aligned(
                    *(np.concatenate([x, y]) for x, y in ((s.n_a, got.n_a), (s.n_b, got.n_b), (s.n_links, got.n_links), (s.a, got.a), (s.b, got.b))),
                    s.written,
                )
                s.written += got.written
                self.known.update(zip(own, range(first, first + len(own))))
        self.ends = np.cumsum(self.store.n_links)

    def slice(self, texts: list[str]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """(the slice's distinct words and whole texts, their numbers text by text, how many each text has)."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        regular = [k for k, t in enumerate(texts) if t and self.lines and _regular(t) and SPACE not in t]
        odd = sorted({*(k for k, t in enumerate(texts) if t)} - set(regular))
        sizes = np.zeros(len(texts), dtype=np.int64)
        numbers, picked = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if regular:
            text = "".join(f" {texts[k]}" for k in regular).replace("\n", " \n")
            split = pc.split_pattern(pa.array([text], pa.large_string()), " ").flatten().slice(1).dictionary_encode()
            names = split.dictionary.to_pylist()
            picked = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
            new = [names[k] for k in np.flatnonzero(picked < 0).tolist()]
            if new:
                self._learn(new)
                picked = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
            numbers = split.indices.to_numpy().astype(np.int64)
            sizes[regular] = [1 + texts[k].count(" ") + texts[k].count("\n") for k in regular]
        s = self.store
        links = s.n_links[picked]
        at = np.repeat(self.ends[picked] - links, links) + ramps(links)
        parts = [Aligned(s.n_a[picked], s.n_b[picked], links, s.a[at], s.b[at], [s.written[k] for k in picked.tolist()])]
        if odd:
            parts.append(self.whole([texts[k] for k in odd]))
            # a whole text is one more word, in its text's place
            out = np.zeros(len(texts), dtype=np.int64)
            out[odd] = 1
            before = np.cumsum(sizes) - sizes
            numbers = np.insert(numbers, before[odd], len(picked) + np.arange(len(odd)))
            sizes += out
        each = [np.concatenate(x) for x in zip(*((p.n_a, p.n_b, p.n_links, p.a, p.b) for p in parts))]
        return Aligned(*each, [w for p in parts for w in p.written]), numbers, sizes

    def texts(self, texts: list[str]) -> tuple[Aligned, np.ndarray, np.ndarray, list[np.ndarray], list[list[bytes]]]:
        """:meth:`slice`, with (n_a, n_b, n_links) of every text and its words' groups as written; texts of
        which a word cannot be aligned have none."""
        words, numbers, sizes = self.slice(texts)
        ends = np.cumsum(sizes)
        lost = np.diff(np.r_[0, np.r_[0, np.cumsum(words.n_a[numbers] == 0)][ends]]) > 0
        if lost.any():
            keep = ~np.repeat(lost, sizes)
            numbers, sizes = numbers[keep], np.where(lost, 0, sizes)
            ends = np.cumsum(sizes)
        counts = [np.diff(np.r_[0, np.r_[0, np.cumsum(c[numbers])][ends]]) for c in (words.n_a, words.n_b, words.n_links)]
        order, w = numbers.tolist(), words.written
        written = [list(map(w.__getitem__, order[e - n : e])) for n, e in zip(sizes.tolist(), ends.tolist())]
        return words, numbers, sizes, counts, written


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_vocabulary("byte_bpe_50k.json"), path_b or public_vocabulary("piece_bpe_32k.model")


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and its groups, written ``a1,a2|b1;a3|b2,b3``."""
    paths = _paths(path_a, path_b)

    def go(batches):
        for ids, texts in byte_slices(batches, SLICE_BYTES):
            *_, written = aligner(*paths).texts(texts)
            out = pa.array([b"".join(w)[:-1].decode() for w in written], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), out], names=["doc_id", "groups"])

    return id_text(docs).mapInArrow(go, "doc_id long, groups string")


# --- pass 1: slices ------------------------------------------------------------------------------

SLICES = "doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, sha256 array<string>, sizes array<long>, places binary, links binary, kinds binary"
_SLICES = pa.schema(
    [(c, pa.list_(pa.int64())) for c in ("doc_id", "n_a", "n_b", "n_links")]
    + [("sha256", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("places", "links", "kinds")]
)


def _sha(written: list[bytes]) -> str:
    if not written:
        return ""
    h = hashlib.sha256()
    for at in range(0, len(written) - 1, 100_000):
        h.update(b"".join(written[at : min(at + 100_000, len(written) - 1)]))
    h.update(written[-1][:-1])  # without the last mark
    return h.hexdigest()


def slices(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each slice of texts: its documents' counts and digests, and their words with the words' links."""

    def go(batches):
        for ids, texts in byte_slices(batches, SLICE_BYTES):
            words, numbers, sizes, counts, written = aligner(path_a, path_b).texts(texts)
            u8 = lambda x: x.astype(np.uint64)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "doc_id": ids, "n_a": counts[0].tolist(), "n_b": counts[1].tolist(), "n_links": counts[2].tolist(),
                        "sha256": list(map(_sha, written)), "sizes": sizes.tolist(),
                        "places": planes(u8(numbers)), "links": planes(u8(words.n_links)), "kinds": planes(u8(words.a), u8(words.b)),
                    }
                ],
                schema=_SLICES,
            )

    return id_text(docs).mapInArrow(go, SLICES)


def _opened(places: bytes, links: bytes, kinds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words' numbers in order, links of every word, their keys)."""
    a, b = of_planes(kinds, 2)
    return of_planes(places, 1)[0].astype(np.int64), of_planes(links, 1)[0].astype(np.int64), ((b << np.uint64(32)) | a).astype(np.int64)


# --- pass 2: counts ------------------------------------------------------------------------------


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64) if len(key) else n[:0]


def _partial(batches):
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            places, links, own = _opened(row["places"], row["links"], row["kinds"])
            times = np.repeat(np.bincount(places, minlength=len(links)), links)
            key, n = _summed(np.concatenate([key, own[times > 0]]), np.concatenate([n, times[times > 0]]))
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key), pa.array(n)], names=["b", "key", "n"])


def _run_sums(batches):
    """Sums of runs of one key, over batches sorted by key."""
    held: tuple[int, int] | None = None
    for batch in batches:
        key, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if held:
            key, n = np.r_[held[0], key], np.r_[held[1], n]
        if not len(key):
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[first], np.add.reduceat(n, first)
        held = int(key[-1]), int(n[-1])
        yield from _pairs(key[:-1], n[:-1])
    if held:
        yield from _pairs(np.array([held[0]]), np.array([held[1]]))


def _pairs(key: np.ndarray, n: np.ndarray):
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key & 0xFFFFFFFF), pa.array(key >> 32), pa.array(n)], names=["a", "b", "n"])


def counted(cut_slices: DataFrame) -> DataFrame:
    """(a, b, n) of all links, sorted by (b, a) within ranges of b; a range holds whole B ids."""
    partial = cut_slices.select("places", "links", "kinds").mapInArrow(_partial, "b long, key long, n long")
    return partial.repartitionByRange("b").sortWithinPartitions("key").mapInArrow(_run_sums, "a long, b long, n long")


def _shard(batches):
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not parts:
        return
    a, b, n = (np.concatenate(c) for c in zip(*parts))
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    best = np.repeat(np.maximum.reduceat(n, first), np.diff(np.r_[first, len(b)]))
    rows = np.stack([(b << 32) | a, n, best]).astype("<i8")
    yield pa.RecordBatch.from_arrays([pa.array([int(rows[0, 0])]), pa.array([rows.tobytes()], pa.binary())], names=["first", "columns"])


def _write(spark: SparkSession, path: str, raw: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def shard_files(spark: SparkSession, counts: DataFrame, most: int) -> list[str]:
    """Writes the sorted shards as files of three int64 columns and hands them to the executors; their names, by first key."""
    found = counts.mapInArrow(_shard, "first long, columns binary").collect()
    shards = [np.frombuffer(r["columns"], dtype="<i8").reshape(3, -1) for r in sorted(found, key=lambda r: r["first"])]
    pairs = sum(s.shape[1] for s in shards)
    if pairs > most:
        raise RuntimeError(f"{pairs} pairs of tokens end together, more than the vocabularies' {most} suffix pairs")
    names, held = [], []
    for k, shard in enumerate(shards):
        held.append(shard)
        if k + 1 == len(shards) or sum(s.nbytes for s in held) + shards[k + 1].nbytes > FILE_BYTES:
            name = f"pair-counts-{uuid.uuid4().hex}"
            path = posixpath.join(shared_folder(spark), name)
            _write(spark, path, np.concatenate(held, axis=1).tobytes())
            spark.sparkContext.addFile(path)
            names.append(name)
            held = []
    return names


class Shards:
    """Lookup in mapped files of sorted counts."""

    def __init__(self, names: list[str]):
        self.columns = [np.memmap(SparkFiles.get(n), dtype="<i8", mode="r").reshape(3, -1) for n in names]
        self.firsts = np.array([c[0, 0] for c in self.columns], dtype=np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, highest count of the same B id) of sorted keys; all of them are known."""
        count, best = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        cuts = np.r_[np.searchsorted(keys, self.firsts), len(keys)]
        for columns, x, y in zip(self.columns, cuts[:-1].tolist(), cuts[1:].tolist()):
            at = np.searchsorted(columns[0], keys[x:y])
            count[x:y], best[x:y] = columns[1][at], columns[2][at]
        return count, best


# --- pass 3: scores ------------------------------------------------------------------------------

SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scores(names: list[str]):
    def go(batches):
        shards = Shards(names)
        for batch in batches:
            for row in batch.to_pylist():
                places, links, key = _opened(row["places"], row["links"], row["kinds"])
                distinct, at = np.unique(key, return_inverse=True)
                count, best = shards.find(distinct)
                word = np.r_[0, np.cumsum(links)]
                ends = np.cumsum(np.array(row["sizes"], dtype=np.int64))
                sums = []
                for value in ((count == best).astype(np.int64), count):
                    of_word = np.diff(np.r_[0, np.cumsum(value[at])][word])
                    sums.append(np.diff(np.r_[0, np.r_[0, np.cumsum(of_word[places])][ends]]))
                out = [row["doc_id"], row["n_a"], row["n_b"], row["n_links"], row["n_links"], *sums]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in out), pa.array(row["sha256"], pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return go


def _written(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "token-slices")
    slices(docs, *paths).write.parquet(path)
    return spark.read.parquet(path)


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(a, b, n): how many links of the corpus hold the two ids."""
    return counted(_written(docs, _paths(path_a, path_b)))


def score(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document its tokens, groups and links, how many links are the commonest of their B id, and the sum of their counts."""
    paths = _paths(path_a, path_b)
    rows = _written(docs, paths)
    own = aligner(*paths)
    names = shard_files(docs.sparkSession, counted(rows), most_pairs(own.of_a.tokens, own.of_b.tokens))
    return rows.mapInArrow(_scores(names), SCORES)
