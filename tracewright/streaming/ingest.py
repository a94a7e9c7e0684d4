"""Structured Streaming front end: files of traces as they arrive, and spans closed into traces.

A stream of files carries their names only; every batch reads its files as :func:`operators.ingest.ingest` does.  So
a file gives the same traces and the same issues, with line numbers, whichever way it comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators import ingest as batches
from tracewright.shared import cut
from tracewright.sources import spans
from tracewright.sources.adapters import adapter, records
from tracewright.streaming import closing

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Files of a batch at most.
MOST_FILES = 1_000


def _add(valid: DataFrame, issues: DataFrame, out: str, number: int, salt: bytes | None) -> None:
    _, issues, _ = batches.settled(cut(valid), issues, out, batches.Mode.STORE, salt)
    issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, salt: bytes | None = None, format: str = "jsonl") -> StreamingQuery:
    """Each batch of files goes the way of a file: validated, redacted, classified against the store ``out``, added where it is new.

    A batch that is run again finds its traces stored, and writes its issues again.
    """
    read = adapter(format)
    # the content is not selected, so it is not read here
    names = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", MOST_FILES).load(path).select("path")

    def write(batch: DataFrame, number: int) -> None:
        files = sorted(r["path"] for r in batch.collect())
        if files:
            _add(*read(spark, files), out, number, salt)

    return names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_issues(late: DataFrame, place: str) -> DataFrame:
    """An issue for each span that came after its trace was closed."""
    none = F.lit(None).cast("string")
    return late.select(
        F.concat(F.lit(f"{place}#"), F.col("trace_id")).alias("file"), F.lit(1).alias("line"), "trace_id", F.lit("late_span").alias("kind"),
        F.concat(F.lit("a span came after its trace was closed: "), F.coalesce("span_id", F.lit("?"))).alias("message"), none.alias("field"),
    )


def ingest_spans(
    spark: SparkSession, path: str, out: str, checkpoint: str, gap: str = "10 minutes", late: str = "5 minutes", memory: str = "1 day", salt: bytes | None = None
) -> StreamingQuery:
    """OTLP documents as they arrive: spans wait until their trace is closed, then it is assembled and goes the way of a file.

    A span that comes after that is an issue.
    """
    closed = closing.close(spans.read_otlp(spark, path, stream=True), "ended", gap, late, memory)

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        if batch.isEmpty():
            return
        valid, issues = records(spans.assemble(batch.where("not late").drop("late")), "opentelemetry", path)
        _add(valid, issues.unionByName(late_issues(batch.where("late"), path)), out, number, salt)

    with closing.in_rocks(spark):
        return closed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
