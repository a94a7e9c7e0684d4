"""A training corpus from the raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; a stage's rows
are written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, line_dedup, packing, quality, simhash
from tracewright.llm.common import made, release, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go; null and empty texts too.  Repeated rows are judged alike."""
    return quality.keep(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; n_chars follows the remaining text.

    Documents are told apart by doc_id (a null id: each row); a null text becomes the empty text.
    """
    out = line_dedup.dedup(docs, min_docs=10)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Documents are linked at a Jaccard similarity of 0.8 or more between their five-word-shingle sets:
    SimHash tries propose links, the exact sets confirm them, and pairs too far apart for the tries are found by a
    prefix-filtered join.  A repeated doc_id keeps all its rows only if their texts are not near-duplicates; exact
    repeats of a row fall together.  Null and empty texts are copies of each other.
    """
    return simhash.keep_first(docs, width=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none.  Repeated rows are judged alike."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids and their place in the packed sequences; an empty or null text is one end id.

    Repeated rows are packed each.
    """
    return packing.pack_documents(docs, packing.Capacity(tokens=1024), end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("drop_common_lines", drop_common_lines),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("pack_sequences", pack_sequences),
]

#: The quality model and the subword encoding have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Stages run when this is called; what a stage wrote goes when the next one is written."""
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, keep=(*others, path))
        docs = spark.read.parquet(path)
    return docs
