"""Case summaries of repeated runs, their comparison and paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.statistics import exact_binomial, paired_wald, wilson

COMPARABLE = ("fixed", "likely_fixed", "regression", "unchanged_failure", "unchanged_pass")


def verdict(passed: Column, failed: Column) -> Column:
    n = passed + failed
    return F.when(n == 0, "error").when(passed == n, "pass").when(passed == 0, "fail").otherwise("flaky")


def summaries(results: DataFrame) -> DataFrame:
    """A row for each (run, test); errors are counted but decide nothing."""
    agg = results.groupBy("run_id", "test_id").agg(
        F.count_if(F.col("outcome") == "pass").alias("passed"),
        F.count_if(F.col("outcome") == "fail").alias("failed"),
        F.count_if(F.col("outcome") == "error").alias("errored"),
        F.count(F.lit(1)).alias("repetitions"),
    )
    n = F.col("passed") + F.col("failed")
    return agg.withColumns({"evaluated": n, "pass_rate": F.when(n > 0, F.col("passed") / n), "verdict": verdict(F.col("passed"), F.col("failed"))})


def representative(results: DataFrame) -> DataFrame:
    """The first repetition of each case, or its last failing one."""
    fails = F.col("outcome") == "fail"
    order = F.struct(fails, F.when(fails, F.col("repetition")).otherwise(-F.col("repetition")))
    return results.groupBy("run_id", "test_id").agg(F.max_by(F.struct("repetition", "outcome", "latency"), order).alias("r")).select("run_id", "test_id", "r.*")


def _mostly(passed: Column, n: Column) -> Column:
    return wilson(passed, n)["low"] > 0.5


def classification() -> Column:
    """Over columns b_/c_ (baseline, candidate): verdict, passed, evaluated, pass_rate."""
    b, c = F.col("b_verdict"), F.col("c_verdict")
    rate_b, rate_c = F.col("b_pass_rate"), F.col("c_pass_rate")
    likely = F.when(_mostly(F.col("c_passed"), F.col("c_evaluated")), "likely_fixed").otherwise("unchanged_failure")
    return (
        F.when(b.isNull() | c.isNull(), "missing")
        .when((b == "error") | (c == "error"), "not_comparable")
        .when(c == "pass", F.when(b == "pass", "unchanged_pass").otherwise("fixed"))
        .when(c == "fail", F.when(b == "fail", "unchanged_failure").otherwise("regression"))
        .when(b == "pass", "regression")
        .when(b == "fail", likely)
        .when(rate_c > rate_b, likely)
        .when(rate_c < rate_b, "regression")
        .otherwise("unchanged_failure")
    )


def compare(results: DataFrame, baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
    """A row for each test of either run.  One aggregation serves both sides."""
    sides = summaries(results)
    fields = ("verdict", "passed", "failed", "errored", "evaluated", "repetitions", "pass_rate")
    side = lambda run, p: sides.where(F.col("run_id") == run).select("test_id", *[F.col(f).alias(f"{p}_{f}") for f in fields])
    both = side(baseline, "b").join(side(candidate, "c"), "test_id", "full_outer")
    flaky = (F.coalesce(F.col("b_verdict"), F.lit("")) == "flaky") | (F.coalesce(F.col("c_verdict"), F.lit("")) == "flaky")
    return both.withColumn("classification", classification()).withColumn("flaky", flaky)


def pass_rates(compared: DataFrame) -> DataFrame:
    own = compared.where(F.col("classification").isin(*COMPARABLE))
    n = F.count(F.lit(1))
    rate = lambda c: F.when(n > 0, F.count_if(F.col(c) == "pass") / n)
    return own.agg(n.alias("comparable"), rate("b_verdict").alias("baseline_rate"), rate("c_verdict").alias("candidate_rate"))


def paired_statistics(compared: DataFrame) -> DataFrame:
    """One row: pairs, fixed, regressions, difference, exact p-value, interval when earned, note."""
    c = F.col("classification")
    agg = compared.where(c.isin(*COMPARABLE)).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(c == "fixed").alias("fixed"), F.count_if(c == "regression").alias("regressions")
    )
    f, r, n = F.col("fixed"), F.col("regressions"), F.col("pairs")
    wald = paired_wald(f, r, n)
    return agg.where("pairs > 0").select(
        "pairs",
        "fixed",
        "regressions",
        ((f - r) / n).alias("difference"),
        exact_binomial(f, f + r).alias("p_value"),
        (exact_binomial(f, f + r) < 0.05).alias("significant"),
        wald["low"].alias("low"),
        wald["high"].alias("high"),
        F.when(f + r == 0, "nothing to test").when(f + r < 10, "too few for an interval").alias("note"),
    )


def reason() -> Column:
    """Why a pair cannot be compared, or an empty text; over b_/c_ columns with b_kind and c_kind (of errors)."""
    absent = F.when(F.col("b_verdict").isNull(), "absent from the baseline run").when(F.col("c_verdict").isNull(), "absent from the candidate run")
    side = lambda p, name: F.when(F.col(f"{p}_verdict") == "error", F.concat(F.lit(f"{name} "), F.coalesce(f"{p}_kind", F.lit("error"))))
    return F.coalesce(absent, side("b", "baseline"), side("c", "candidate"), F.lit(""))


def rates() -> Column:
    """How often each side passed, for sides that were repeated."""
    side = lambda p, name: F.when(F.col(f"{p}_repetitions") > 1, F.concat(F.lit(f"{name} "), f"{p}_passed", F.lit("/"), f"{p}_evaluated"))
    return F.concat_ws(", ", side("b", "before"), side("c", "after"))


def suite_compatible(a: str, b: str, allow_drift: bool = False) -> None:
    if a != b and not allow_drift:
        raise ValueError("the runs were made with different suites")
