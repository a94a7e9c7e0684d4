"""The driver's tables read as traces, spans, results and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each document: its label gives the status, feedback and evaluation."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    return joined.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("trace_id"),
        F.col("text").alias("input_text"),
        "source",
        "lang",
        F.when((q == 0) & (t == 1), "error").when(q == 0, "failure").otherwise("unknown").alias("status"),
        F.when(t == 1, "negative").alias("rating"),
        F.lit(None).cast("string").alias("comment"),
        F.lit(None).cast("double").alias("score"),
        F.when(
            q.isNotNull(),
            F.array(F.struct(F.lit("quality").alias("name"), (q == 1).alias("passed"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason"))),
        )
        .otherwise(F.array().cast("array<struct<name:string,passed:boolean,score:double,reason:string>>"))
        .alias("evaluations"),
        F.array().cast("array<struct<position:int,type:string,name:string,passed:boolean,score:double,reason:string>>").alias("events"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each user and day, a span for each event."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("tool"),
        F.col("props").alias("arguments"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_type") == "error").alias("errored"),
        "user_id",
        "value",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the same tests: events before and from 16 January 2024."""
    rows = spans(spark, sf_dir).select(
        F.when(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), "baseline").otherwise("candidate").alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 10).cast("string")).alias("test_id"),
        F.when(F.col("tool") == "error", "error").when(F.col("tool") == "view", "fail").otherwise("pass").alias("outcome"),
        "ts",
        "event_id",
        F.col("value").alias("latency"),
    )
    order = Window.partitionBy("run_id", "test_id").orderBy("ts", "event_id")
    return rows.withColumn("repetition", F.row_number().over(order) - 1)
