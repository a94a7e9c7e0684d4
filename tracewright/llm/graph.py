"""Connected components by alternating large-star and small-star contraction.

Only DataFrame joins and aggregates; the edges never leave the executors.  Every round is cut into
the shared checkpoint folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a long, b long).  Returns (node, root), root the smallest node of its component,
    for every node that has an edge.

    Each round sends every node's larger neighbours to its smallest one (large star), then joins
    what lies below to the smallest (small star); it ends when a round changes nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # sum of roots and number of edges both settle exactly when nothing changes any more
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
