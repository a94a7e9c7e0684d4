"""The thin queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import language_model

    return language_model.score(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import quality

    return quality.score(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import line_dedup

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = line_dedup.dedup(docs, min_docs=10)
    n_lines, n_dropped = out.columns[-2:]
    return out.select(
        "doc_id",
        F.col(n_lines).alias("n_lines"),
        F.col(n_dropped).alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.Capacity(tokens=1024), end_id=2).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import suffix_dedup

    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import simhash

    out = simhash.near_classes(table(spark, sf_dir, "documents"), width=4, budget=4)
    return out.select("doc_id", simhash.hex_fp(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import tokens

    return tokens.token_table(table(spark, sf_dir, "documents"), end_id=0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import decontamination

    out = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import alignment

    return alignment.score(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import vector_codes

    out, books = vector_codes.codes(table(spark, sf_dir, "embeddings"))
    return out.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracewright.llm import cutting_stock

    return cutting_stock.pack_documents(table(spark, sf_dir, "documents"), cutting_stock.Stock(capacity=2048), end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_language_model": op2_language_model,
        "op3_quality": op3_quality,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_packing": op6_packing,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_simhash": op8_simhash,
        "op9_token_ids": op9_token_ids,
        "op10_decontamination": op10_decontamination,
        "op11_token_alignment": op11_token_alignment,
        "op12_vector_codes": op12_vector_codes,
        "op13_cutting_stock": op13_cutting_stock,
    }


def oracle_sql() -> dict[str, str]:
    from tracewright.llm import sql

    return sql.oracle_sql()
