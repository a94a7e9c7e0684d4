"""Shared helpers of the training-data operators.

Text conventions used everywhere in this subpackage: a null text is the empty text; white space is
``[\\x20\\x09-\\x0D]`` (exactly what ``bytes.split()`` splits at); lower-casing touches A-Z only
(exactly what ``bytes.lower()`` does).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.shared import cut, free_prefix, made, release, scratch, shared_folder, tidy  # noqa: F401

#: White space between words, as a Java/RE2 pattern.
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are large, and a batch is held several times over on its way.
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are made no larger than ``BATCH_ROWS``."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns can never clash."""
    return small_batches(df).select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8 bytes."""
    return text.encode("utf-8", "replace").lower().split()


def crc_of_id(doc_id) -> int:
    """crc32 of the id written as decimal text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_col(col: Column) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def byte_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) lists of about ``limit`` characters, at least one row each.

    Bounds what a Python worker holds at once whatever the Arrow batch size is.
    """
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        start, run = 0, 0
        for k, n in enumerate(sizes):
            if run and run + n > limit:
                yield ids.slice(start, k - start).to_pylist(), col.slice(start, k - start).to_pylist()
                start, run = k, 0
            run += int(n)
        yield ids.slice(start).to_pylist(), col.slice(start).to_pylist()


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at least one row and about ``limit`` bytes of their ``text`` column."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        start, run = 0, 0
        for k, n in enumerate(sizes):
            if run and run + n > limit:
                yield batch.slice(start, k - start)
                start, run = k, 0
            run += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def schema_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


# --- letter-and-digit words, hashed ---------------------------------------------------------------

PLAIN = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it holds too many words."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(self) < self.LIMIT:
            self[word] = value
        return value


_HASHES = WordHashes()


def plain_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return PLAIN.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_HASHES) >= WordHashes.LIMIT:
        _HASHES.clear()
    return np.array([_HASHES[w] for w in words], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``n`` values, mixed."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mixed(out)


def spec(docs: DataFrame, more: str):
    """The schema of ``docs`` and the columns of the DDL text ``more``."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return schema_of(f"{ddl}, {more}" if more else ddl)
