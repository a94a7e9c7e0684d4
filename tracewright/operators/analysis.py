"""Descriptions of failures: which need one, a cache in front of the provider, and manual labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.identity import cache_key
from tracewright.operators.store import upsert
from tracewright.shared import cut, scratch

TYPES = ("wrong_tool_argument", "wrong_tool_selection", "unnecessary_action", "hallucination", "other")
COLUMNS = "failure_id string, failure_type string, component string, severity string, summary string"


def needed(failures: DataFrame, analyses: DataFrame, analyzer: str, version: int, force: bool = False) -> DataFrame:
    """Open failures without a description, or with one by another analyser or prompt version.

    Manual descriptions are never replaced.
    """
    done = analyses.select("failure_id", F.col("analyzer").alias("by"), F.col("prompt_version").alias("v"))
    rows = failures.where(F.col("status").isin("candidate", "confirmed")).join(done, "failure_id", "left")
    manual = F.coalesce(F.col("by") == "manual", F.lit(False))
    stale = F.col("by").isNull() | (F.col("by") != analyzer) | (F.col("v") != version) | F.lit(force)
    return rows.where(~manual & stale).drop("by", "v")


def described(rows: DataFrame, cache: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], analyzer: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(analyses, new cache rows) for rows (failure_id, prompt): only prompts that the cache lacks
    reach the provider, each once."""
    keyed = rows.select("failure_id", "prompt", cache_key(F.lit(analyzer), F.lit(str(version)), F.col("prompt")).alias("key"))
    todo = keyed.join(cache, "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
    fresh = todo.select(F.col("key").alias("failure_id"), "prompt").mapInPandas(provider, COLUMNS).withColumnRenamed("failure_id", "key")
    known = cache.unionByName(fresh)
    out = keyed.join(known, "key").select("failure_id", "failure_type", "component", "severity", "summary", F.lit(analyzer).alias("analyzer"), F.lit(version).alias("prompt_version"))
    return out, fresh


@dataclass(frozen=True)
class Produced:
    """``analyses`` of failures, answers that the cache lacked (``fresh``), and ``errors`` (failure_id, error)."""

    analyses: DataFrame
    fresh: DataFrame
    errors: DataFrame


def produce(rows: DataFrame, cache: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], analyzer: str, version: int, limit: int | None = None) -> Produced:
    """Descriptions of rows (failure_id, prompt) by a provider that may fail for some of them.

    The provider's rows have a column ``error``; an item that it fails for is a row of ``errors``, and others go on.  A
    prompt is asked for once, whether it failed or not, and not at all if the cache has it.  With ``limit``, items are
    taken in the order of their ids until that many are *produced*, cached ones included: batches hold what is lacking, and twice as many
    each time.  What a batch answers beyond the limit is in ``fresh``, so the next pass need not ask again.
    """
    spark, answer = rows.sparkSession, COLUMNS.replace("failure_id", "key")
    names = [c.split(" ")[0] for c in answer.split(", ")]
    keyed = cut(rows.select("failure_id", "prompt", cache_key(F.lit(analyzer), F.lit(str(version)), F.col("prompt")).alias("key")))
    cached = cache.select(*names, F.lit(None).cast("string").alias("error"))
    asked, last, size = cached.limit(0), None, limit
    while limit is None or size > 0:
        batch = keyed if last is None else keyed.where(F.col("failure_id") > last)
        if limit is not None:
            # ids alone are ordered; the boundary is all that comes here
            end = batch.select("failure_id").orderBy("failure_id").limit(size).agg(F.max("failure_id")).first()[0]
            if end is None:
                break
            last = end
            batch = batch.where(F.col("failure_id") <= last)
        known = cached.unionByName(asked).select("key")
        todo = batch.join(known, "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
        path = scratch(spark, "answers")
        # written, not recomputed: a second reader must not ask again
        todo.select(F.col("key").alias("failure_id"), "prompt").mapInPandas(provider, COLUMNS + ", error string").withColumnRenamed("failure_id", "key").write.parquet(path)
        new = spark.read.parquet(path)
        asked = asked.unionByName(new)
        if limit is None:
            break
        told = cached.unionByName(asked).where("error is null").select("key")
        done = keyed.where(F.col("failure_id") <= last).join(told, "key", "left_semi").count()
        if done >= limit:
            break
        size = max(limit - done, 2 * size)
    seen = keyed if limit is None else keyed.where(F.col("failure_id") <= F.lit(last))
    found = seen.join(cached.unionByName(asked), "key")
    out = found.where("error is null").select("failure_id", "failure_type", "component", "severity", "summary", F.lit(analyzer).alias("analyzer"), F.lit(version).alias("prompt_version"))
    out = out if limit is None else out.orderBy("failure_id").limit(limit)
    return Produced(out, asked.where("error is null").select(*names), found.where("error is not null").select("failure_id", "error"))


def each(describe: Callable[[str], dict[str, str]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A provider of a function of one prompt; what it raises is the item's error."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [c.split(" ")[0] for c in COLUMNS.split(", ")[1:]]
        for part in batches:
            out = []
            for key, prompt in zip(part["failure_id"], part["prompt"]):
                try:
                    said = describe(prompt)
                    out.append({"failure_id": key, **{c: said.get(c) for c in fields}, "error": None})
                except Exception as e:
                    out.append({"failure_id": key, **dict.fromkeys(fields), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=["failure_id", *fields, "error"])

    return go


def stub(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The offline provider."""
    for part in batches:
        yield pd.DataFrame({"failure_id": part["failure_id"], "failure_type": "other", "component": "unknown", "severity": "medium", "summary": "[stub] " + part["prompt"]})


def label(analyses: DataFrame, rows: DataFrame) -> DataFrame:
    """Manual descriptions (failure_id, failure_type, component, severity, summary) replace all others."""
    manual = rows.withColumns({"analyzer": F.lit("manual"), "prompt_version": F.lit(0)}).select(*analyses.columns)
    return upsert(analyses, manual, "failure_id")


def embedded(texts: DataFrame, cache: DataFrame, embed, identity: str) -> tuple[DataFrame, DataFrame]:
    """(rows with vector, new cache rows) of rows with ``text``: equal texts are embedded once."""
    keyed = texts.withColumn("key", cache_key(F.lit(identity), F.col("text")))
    fresh = keyed.select("key", "text").dropDuplicates(["key"]).join(cache, "key", "left_anti").select("key", embed(F.col("text")).alias("vector"))
    return keyed.join(cache.unionByName(fresh), "key").drop("key"), fresh
