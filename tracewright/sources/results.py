"""Runner result documents as case results, and export of approved tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.redaction import redact_text

CASE = "struct<testCase:struct<description:string,metadata:struct<test_id:string>>,success:boolean,failureReason:int,error:string,latencyMs:bigint,response:struct<output:string>,gradingResult:struct<pass:boolean,reason:string,componentResults:array<struct<pass:boolean,reason:string>>>>"


def read_results(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """(run_id, test_id, repetition, outcome, error_kind, error, latency_ms, observation, failed_assertions)."""
    text = spark.read.text(path, wholetext=True)
    cases = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.results.results"), f"array<{CASE}>")).alias("at", "c"))
    test = F.coalesce(F.nullif(F.col("c.testCase.metadata.test_id"), F.lit("")), F.col("c.testCase.description"))
    rows = cases.withColumn("test_id", test).where("test_id <> ''")
    reason = F.coalesce("c.failureReason", F.lit(0))
    passed = F.coalesce("c.success", F.lit(False))
    outcome = F.when(passed, "pass").when(reason == 1, "fail").otherwise("error")
    slow = F.lower(F.coalesce("c.error", F.lit(""))).rlike("timeout|timed out")
    kind = F.when(outcome == "error", F.when((reason == 2) & slow, "timeout").otherwise("execution_error"))
    parts = F.filter(F.coalesce("c.gradingResult.componentResults", F.expr("array()")), lambda p: ~F.coalesce(p["pass"], F.lit(True)))
    reasons = F.transform(parts, lambda p: F.trim(F.coalesce(p["reason"], F.lit(""))))
    overall = F.trim(F.coalesce("c.gradingResult.reason", F.lit("")))
    failed = F.when(F.size(reasons) > 0, reasons).when((overall != "") & ~F.coalesce("c.gradingResult.pass", F.lit(True)), F.array(overall)).otherwise(F.expr("array()"))
    order = Window.partitionBy("test_id").orderBy("at")
    return rows.select(
        F.lit(run_id).alias("run_id"),
        "test_id",
        (F.row_number().over(order) - 1).alias("repetition"),
        outcome.alias("outcome"),
        kind.alias("error_kind"),
        redact_text(F.nullif(F.col("c.error"), F.lit(""))).alias("error"),
        F.col("c.latencyMs").alias("latency_ms"),
        redact_text(F.col("c.response.output")).alias("observation"),
        failed.alias("failed_assertions"),
    )


def export_jsonl(tests: DataFrame, path: str) -> None:
    """Approved tests as JSON lines, fields in alphabetical order."""
    own = tests.where("status = 'approved'")
    own.select(F.to_json(F.struct(*sorted(own.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
