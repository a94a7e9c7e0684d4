"""What is clustered, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import families

OPEN = ("candidate", "confirmed")


def parameters(linkage: str = "average", metric: str = "cosine", described: float = families.DESCRIBED, undescribed: float = families.UNDESCRIBED) -> dict[str, object]:
    """The settings of a clustering, to be kept with it; other methods than average linkage of cosine distances are refused."""
    if (linkage, metric) != ("average", "cosine"):
        raise ValueError(f"unknown clustering: {linkage} linkage of {metric} distances")
    return {"linkage": linkage, "metric": metric, "described": described, "undescribed": undescribed}


def gather(failures: DataFrame, analyses: DataFrame, calls: DataFrame, undescribed: bool = False) -> DataFrame:
    """(failure_id, population, text, behaviour, and the description's columns) of open failures.

    Described ones go by their description; the others only where asked for, by what was observed: ``calls`` has
    trace_id and tools (array).
    """
    rows = failures.where(F.col("status").isin(*OPEN)).join(analyses.select("failure_id", "failure_type", "component", "severity", F.col("summary").alias("described")), "failure_id", "left").join(calls, "trace_id", "left")
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    told = F.col("failure_type").isNotNull()
    text = F.when(told, families.cluster_text(F.col("failure_type"), F.col("component"), F.col("described"))).otherwise(families.observation_text(tools, F.col("kinds"), F.transform("signals", lambda s: s["summary"])))
    out = rows.select(
        "failure_id", "trace_id", F.when(told, "described").otherwise("undescribed").alias("population"), text.alias("text"),
        F.nullif(F.array_join(F.array_sort(F.array_distinct(tools)), ", "), F.lit("")).alias("behaviour"), "failure_type", "component", "severity",
    )
    return out if undescribed else out.where("population = 'described'")


def undescribed_count(failures: DataFrame, analyses: DataFrame) -> int:
    return failures.where(F.col("status").isin(*OPEN)).join(analyses, "failure_id", "left_anti").count()


def sizes(members: DataFrame) -> DataFrame:
    """(cluster_id, size, representatives), largest first, then by id."""
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.size("roles") > 0).alias("representatives")).orderBy(F.desc("size"), "cluster_id")


def summary(members: DataFrame) -> DataFrame:
    """One row: clusters, singletons, largest, representatives."""
    return sizes(members).agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"), F.sum("representatives").alias("representatives"))


def open_clusters(labels: DataFrame) -> DataFrame:
    return labels.where(~F.col("dismissed"))
