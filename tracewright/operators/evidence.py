"""Failure evidence: three detectors, each an array of signals, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.identity import failure_id

SIGNAL = "struct<detector:string,kind:string,source:string,summary:string,evidence:map<string,string>>"


def _signal(kind: str, source: Column, summary: Column, **evidence: Column) -> Column:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return F.struct(
        F.lit(kind).alias("detector"), F.lit(kind).alias("kind"), source.alias("source"), summary.alias("summary"), known.alias("evidence")
    ).cast(SIGNAL)


def _none() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def explicit_status() -> Column:
    s = F.col("status")
    text = F.when(s == "failure", "the trace is explicitly marked as failed").otherwise("the trace is explicitly marked as errored")
    return F.when(s.isin("failure", "error"), F.array(_signal("explicit_status", F.lit("outcome.status"), text, status=s))).otherwise(_none())


def negative_feedback() -> Column:
    """Only a rating of negative counts, never a bare score."""
    comment = F.when(F.col("comment") != "", F.col("comment"))
    one = _signal("negative_feedback", F.lit("outcome.feedback"), F.coalesce(comment, F.lit("feedback was rated negative")), rating=F.col("rating"), comment=comment, score=F.col("score"))
    return F.when(F.col("rating") == "negative", F.array(one)).otherwise(_none())


def failed_evaluator() -> Column:
    """passed = false, not null: outcome evaluations, then evaluation events, each with its place."""

    def of(column: str, prefix: str) -> Column:
        placed = F.transform(column, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        failed = F.filter(placed, lambda p: p["x"]["passed"] == F.lit(False))

        def signal(p: Column) -> Column:
            reason = F.when(p["x"]["reason"] != "", p["x"]["reason"])
            text = F.coalesce(reason, F.concat(F.lit("evaluator '"), p["x"]["name"], F.lit("' reported a failure")))
            return _signal("failed_evaluator", F.concat(F.lit(prefix), p["i"].cast("string")), text, evaluator=p["x"]["name"], passed=F.lit("false"), reason=reason, score=p["x"]["score"])

        return F.transform(failed, signal)

    return F.concat(of("evaluations", "outcome.evaluations."), of("events", "events."))


DETECTORS: dict[str, Callable[[], Column]] = {
    "explicit_status": explicit_status,
    "negative_feedback": negative_feedback,
    "failed_evaluator": failed_evaluator,
}


def detect(traces: DataFrame, detectors: dict[str, Callable[[], Column]] = DETECTORS) -> DataFrame:
    """Adds ``signals``."""
    return traces.withColumn("signals", F.concat(*[d() for d in detectors.values()]))


def signals(traces: DataFrame) -> DataFrame:
    """A row for each signal, with its position."""
    return detect(traces).select(failure_id(F.col("trace_id")).alias("failure_id"), "trace_id", F.posexplode("signals").alias("position", "signal")).select(
        "failure_id", "trace_id", "position", "signal.*"
    )


def failures(traces: DataFrame) -> DataFrame:
    """A row for each trace with signals; kinds distinct, in the order first seen."""
    found = detect(traces).where(F.size("signals") > 0)
    return found.select(
        failure_id(F.col("trace_id")).alias("failure_id"),
        "trace_id",
        F.lit("candidate").alias("status"),
        F.lit("detector").alias("origin"),
        "signals",
        F.array_distinct(F.transform("signals", lambda s: s["kind"])).alias("kinds"),
    )
