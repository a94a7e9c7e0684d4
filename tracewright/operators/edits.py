"""Human edits of families: rename, dismiss, merge, split, and their carry-over to a new clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.identity import cluster_id
from tracewright.operators import families


class EditsWouldBeLost(RuntimeError):
    """An edited family has no counterpart in the new clustering."""


def carry_over(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """``new`` families with the label and dismissal of edited ``old`` ones of the same members.

    Rows: cluster_id, label, labelled_by, dismissed.  The id is made from the members, so an equal id
    is an equal family.
    """
    edited = old.where(F.col("dismissed") | F.col("labelled_by").isNotNull())
    lost = edited.join(new, "cluster_id", "left_anti")
    if not force and not lost.isEmpty():
        raise EditsWouldBeLost(", ".join(sorted(r["cluster_id"] for r in lost.select("cluster_id").limit(20).collect())))
    kept = edited.select("cluster_id", F.col("label").alias("old_label"), F.col("labelled_by").alias("old_by"), F.col("dismissed").alias("old_dismissed"))
    out = new.join(kept, "cluster_id", "left")
    named = F.col("old_by").isNotNull()
    return out.select(
        "cluster_id", F.when(named, F.col("old_label")).otherwise(F.col("label")).alias("label"), F.coalesce("old_by", "labelled_by").alias("labelled_by"), F.coalesce("old_dismissed", "dismissed").alias("dismissed")
    )


def rename(rows: DataFrame, cluster: str, label: str, by: str) -> DataFrame:
    one = F.col("cluster_id") == cluster
    return rows.withColumns({"label": F.when(one, F.lit(label)).otherwise(F.col("label")), "labelled_by": F.when(one, F.lit(by)).otherwise(F.col("labelled_by"))})


def dismiss(rows: DataFrame, cluster: str, dismissed: bool = True) -> DataFrame:
    return rows.withColumn("dismissed", F.when(F.col("cluster_id") == cluster, F.lit(dismissed)).otherwise(F.col("dismissed")))


def _renumbered(members: DataFrame, group: Column) -> DataFrame:
    """Members under new groups: ids from the members, roles from the distances they had."""
    rows = members.drop("roles", "cluster_id").withColumn("_group", group)
    ids = rows.groupBy("_group").agg(cluster_id(F.collect_list("failure_id")).alias("cluster_id"))
    return families.roles(rows.join(ids, "_group").drop("_group")).select(*members.columns)


def merge(members: DataFrame, clusters: list[str]) -> DataFrame:
    """The named families as one; the others as they are."""
    inside = F.col("cluster_id").isin(*clusters)
    return members.where(~inside).unionByName(_renumbered(members.where(inside), F.lit(0)))


def split(members: DataFrame, cluster: str, out: list[str]) -> DataFrame:
    """The named members leave their family for one of their own; unknown members are an error."""
    own = members.where(F.col("cluster_id") == cluster)
    found = {r["failure_id"] for r in own.where(F.col("failure_id").isin(*out)).select("failure_id").collect()}
    if missing := sorted(set(out) - found):
        raise LookupError(f"not in {cluster}: {', '.join(missing)}")
    parts = _renumbered(own, F.col("failure_id").isin(*out).cast("int"))
    return members.where(F.col("cluster_id") != cluster).unionByName(parts)
