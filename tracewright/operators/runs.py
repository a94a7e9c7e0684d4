"""Evaluation runs: saved with their results, promoted to baselines, found again by id, prefix or target."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import comparison, store
from tracewright.shared import cut, exists

RUN = "run_id string, target_id string, suite_hash string, tests int, repetitions int, status string, started_at timestamp, finished_at timestamp"
PROMOTION = "promotion_id string, run_id string, target_id string, promoted_at timestamp, reviewer string, reason string"
BASELINE, CANDIDATE = "baseline", "candidate"


class RunError(ValueError):
    """A run that cannot be found, promoted or compared."""


def _table(spark: SparkSession, folder: str, name: str, ddl: str) -> DataFrame:
    path = f"{folder}/{name}"
    return spark.read.schema(ddl).parquet(path) if exists(spark, path) else spark.createDataFrame([], ddl)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "runs", RUN)


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """Newest first."""
    return _table(spark, folder, "promotions", PROMOTION).orderBy(F.desc("promoted_at"), F.desc("promotion_id"))


def results(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/results").where(F.col("run_id") == run_id).orderBy("test_id", "repetition")


def save(folder: str, run: DataFrame, case_results: DataFrame) -> None:
    """A run (one row) and its results; both replace what was saved under its id, the start time stays."""
    spark = run.sparkSession
    next_ = cut(store.upsert(runs(spark, folder), run.select(*runs(spark, folder).columns), "run_id", keep=("started_at", "suite_hash", "target_id")))
    case_results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{folder}/results")
    next_.write.mode("overwrite").parquet(f"{folder}/runs")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, passed, failed, errored)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return spark.read.parquet(f"{folder}/results").groupBy("run_id").agg(n("pass").alias("passed"), n("fail").alias("failed"), n("error").alias("errored"))


def baseline(spark: SparkSession, folder: str) -> Row | None:
    return promotions(spark, folder).first()


def recent(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    """The newest runs with their outcomes, and which of them is the baseline."""
    now = baseline(spark, folder)
    rows = runs(spark, folder).join(outcomes(spark, folder), "run_id", "left").withColumn("is_baseline", F.lit(now is not None) & (F.col("run_id") == (now["run_id"] if now else "")))
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def find(spark: SparkSession, folder: str, name: str) -> Row | None:
    """By id, by a prefix that only one id has, or the newest run of a target."""
    table = runs(spark, folder)
    try:
        row = store.by_prefix(table, "run_id", name.strip()).first() if name.strip() else None
    except LookupError as e:
        raise RunError(f"{e}; use more characters of the run id") from e
    return row or table.where(F.col("target_id") == name.strip()).orderBy(F.desc("started_at"), F.desc("run_id")).first()


def resolve(spark: SparkSession, folder: str, name: str | None, role: str) -> Row:
    """Nothing given: the promoted baseline, else the newest run of the target that is named like the role."""
    now = baseline(spark, folder) if name is None and role == BASELINE else None
    row = (now and find(spark, folder, now["run_id"])) or find(spark, folder, name or role)
    if row is None:
        raise RunError(f"no {role} run matches {name or role!r}")
    return row


def promote(spark: SparkSession, folder: str, name: str, reviewer: str, reason: str | None = None) -> str:
    """Makes a run the baseline; refused where tests never ran.  Promotions are only ever added."""
    run = find(spark, folder, name)
    if run is None:
        raise RunError(f"no run matches {name!r}")
    bad = results(spark, folder, run["run_id"]).where("outcome = 'error'").count()
    if bad:
        raise RunError(f"{bad} results of that run are errors; a baseline must have run")
    row = (uuid.uuid4().hex, run["run_id"], run["target_id"], reviewer, reason)
    new = spark.createDataFrame([row], "promotion_id string, run_id string, target_id string, reviewer string, reason string").withColumn("promoted_at", F.current_timestamp())
    new.write.mode("append").parquet(f"{folder}/promotions")
    return run["run_id"]


def compare(spark: SparkSession, folder: str, first: str | None = None, second: str | None = None, allow_drift: bool = False) -> DataFrame:
    """The comparison of two runs, with texts on rates and on what cannot be compared."""
    a, b = resolve(spark, folder, first, BASELINE), resolve(spark, folder, second, CANDIDATE)
    if a["run_id"] == b["run_id"]:
        raise RunError("baseline and candidate are one run")
    comparison.suite_compatible(a["suite_hash"], b["suite_hash"], allow_drift)
    both = results(spark, folder, a["run_id"]).unionByName(results(spark, folder, b["run_id"]))
    kinds = both.where("outcome = 'error'").groupBy("run_id", "test_id").agg(F.min_by("error_kind", "repetition").alias("kind"))
    side = lambda run, c: kinds.where(F.col("run_id") == run["run_id"]).select("test_id", F.col("kind").alias(c))
    rows = comparison.compare(both, a["run_id"], b["run_id"]).join(side(a, "b_kind"), "test_id", "left").join(side(b, "c_kind"), "test_id", "left")
    return rows.withColumns({"reason": comparison.reason(), "rates": comparison.rates()})
