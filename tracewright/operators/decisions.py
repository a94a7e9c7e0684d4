"""What people decide about failures, and how detection meets it.

Decisions are rows of the stored table ``failures``: a status other than ``candidate``, with who said so and
why.  Detection never undoes them: it refreshes signals, adds candidates, and withdraws candidates of detectors
that nothing speaks for any more, but a reviewed failure or one added by hand stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.identity import failure_id
from tracewright.functions.redaction import pseudonym
from tracewright.operators import evidence, store
from tracewright.operators.versions import Changes, Store, transact

STATUSES = ("candidate", "confirmed", "dismissed")
FAILURE = f"failure_id string, trace_id string, status string, origin string, signals array<{evidence.SIGNAL}>, kinds array<string>, reviewer string, reason string, reviewed_at timestamp"
REVIEW = ("reviewer", "reason", "reviewed_at")


class DecisionError(ValueError):
    """A decision about something that is not there, or that is there already."""


def merged(stored: DataFrame | None, found: DataFrame) -> DataFrame:
    """Detected failures met with the stored ones: all rows, withdrawn ones too, with ``action``."""
    old = found.sparkSession.createDataFrame([], FAILURE) if stored is None else stored
    rows = store.merge_failures(old, found)
    kinds = F.array_distinct(F.transform("signals", lambda s: s["kind"]))
    return rows.withColumn("kinds", kinds).join(old.select("failure_id", *REVIEW), "failure_id", "left").select("failure_id", "trace_id", "status", "origin", "signals", "kinds", *REVIEW, "action")


def next_failures(stored: DataFrame | None, found: DataFrame) -> DataFrame:
    """The next snapshot of failures."""
    return merged(stored, found).where("action <> 'withdrawn'").drop("action")


def spellings(named: DataFrame, salt: bytes | None = None) -> DataFrame:
    """``named`` (name) with every stored id that a name can stand for: (name, rank, candidate, kind).

    A failure's id itself; a trace id as typed or, where trace ids are made pseudonyms, its pseudonym; the
    failure that is derived from either.  Smaller ranks go first.
    """
    from pyspark.sql.functions import udf

    name = F.btrim("name")
    hidden = udf(lambda x: None if x is None else pseudonym(x, "trace_id", salt), "string")(name) if salt else F.lit(None).cast("string")
    ways = F.array(
        F.struct(F.lit(0).alias("rank"), name.alias("candidate"), F.lit("failure").alias("kind")),
        F.struct(F.lit(1).alias("rank"), name.alias("candidate"), F.lit("trace").alias("kind")),
        F.struct(F.lit(2).alias("rank"), hidden.alias("candidate"), F.lit("trace").alias("kind")),
        F.struct(F.lit(3).alias("rank"), failure_id(name).alias("candidate"), F.lit("failure").alias("kind")),
        F.struct(F.lit(4).alias("rank"), failure_id(hidden).alias("candidate"), F.lit("failure").alias("kind")),
        F.struct(F.lit(5).alias("rank"), name.alias("candidate"), F.lit("prefix").alias("kind")),
    )
    return named.select("name", F.explode(ways).alias("w")).select("name", "w.*").where("candidate <> ''")


def resolve(failures: DataFrame, named: DataFrame, salt: bytes | None = None) -> DataFrame:
    """(name, failure_id, ambiguous) for many names in one plan: one row for each name.

    Every way to read a name is looked up at once by a join of its kind; the way with the smallest rank counts.
    A prefix of failure ids (``fail-`` and a digit at least) counts last, and only if one failure has it; otherwise the
    name is ambiguous.  A name that nothing matches has no failure_id.
    """
    ways = spellings(named.select("name").distinct(), salt)
    of = failures.select("failure_id", "trace_id")
    by_id = ways.where("kind = 'failure'").join(of, F.col("candidate") == F.col("failure_id")).select("name", "rank", "failure_id")
    by_trace = ways.where("kind = 'trace'").join(of, F.col("candidate") == F.col("trace_id")).select("name", "rank", "failure_id")
    # prefixes meet by their own length: an equi-join for each of the few lengths there can be
    size = F.char_length("candidate")
    short = ways.where((F.col("kind") == "prefix") & F.col("candidate").startswith("fail-") & size.between(6, 16)).select("name", "rank", "candidate", size.alias("n"))
    starts = of.select("failure_id", F.explode(F.sequence(F.lit(6), F.lit(16))).alias("n")).withColumn("start", F.col("failure_id").substr(F.lit(1), F.col("n")))
    by_prefix = short.join(starts.join(short.select("n").distinct(), "n", "left_semi").withColumnRenamed("n", "m"), (F.col("n") == F.col("m")) & (F.col("candidate") == F.col("start"))).select("name", "rank", "failure_id")
    found = by_id.unionByName(by_trace).unionByName(by_prefix).groupBy("name", "rank").agg(F.min("failure_id").alias("failure_id"), F.count_distinct("failure_id").alias("n"))
    best = found.groupBy("name").agg(F.min_by(F.struct("failure_id", "n"), "rank").alias("b"))
    out = named.select("name").distinct().join(best, "name", "left")
    return out.select("name", F.when(F.col("b.n") == 1, F.col("b.failure_id")).alias("failure_id"), F.coalesce(F.col("b.n") > 1, F.lit(False)).alias("ambiguous"))


def find(failures: DataFrame, name: str, salt: bytes | None = None) -> Row:
    """The failure that a name stands for."""
    told = resolve(failures, failures.sparkSession.createDataFrame([(name,)], "name string"), salt).first()
    if told["ambiguous"]:
        raise DecisionError(f"{name!r} is ambiguous; use more characters")
    row = failures.where(F.col("failure_id") == told["failure_id"]).first() if told["failure_id"] else None
    if row is None:
        raise DecisionError(f"no failure matches {name!r}")
    return row


def _put(rows: DataFrame) -> Changes:
    return Changes(put={"failures": ("failure_id", rows.select(*[c.split(" ")[0] for c in FAILURE.split(", ")]))})


def decide(spark: SparkSession, folder: str, name: str, status: str, reviewer: str, reason: str | None = None, salt: bytes | None = None) -> str:
    """Confirms or dismisses (or reopens) a failure; its id."""
    if status not in STATUSES:
        raise DecisionError(f"unknown status {status!r}; one of: {', '.join(STATUSES)}")
    at, chosen = Store(spark, folder), []

    def change(base: int) -> Changes:
        failures = at.read("failures", base)
        if failures is None:
            raise DecisionError("no failures are stored")
        row = find(failures, name, salt)
        chosen.append(row["failure_id"])
        new = failures.where(F.col("failure_id") == row["failure_id"]).withColumns(
            {"status": F.lit(status), "reviewer": F.lit(reviewer), "reason": F.lit(reason).cast("string"), "reviewed_at": F.current_timestamp()}
        )
        return _put(new)

    transact(at, change)
    return chosen[-1]


def add(spark: SparkSession, folder: str, trace: str, reviewer: str, reason: str | None = None, salt: bytes | None = None) -> str:
    """Makes a stored trace a confirmed failure by hand, without evidence; its id."""
    at, chosen = Store(spark, folder), []

    def change(base: int) -> Changes:
        traces, failures = at.read("traces", base), at.read("failures", base)
        names = [trace.strip(), *([pseudonym(trace.strip(), "trace_id", salt)] if salt else [])]
        known = {r["trace_id"] for r in traces.where(F.col("trace_id").isin(names)).select("trace_id").limit(2).collect()} if traces is not None else set()
        trace_id = next((n for n in names if n in known), None)
        if trace_id is None:
            raise DecisionError(f"no stored trace has the id {trace.strip()!r}")
        there = failures.where(F.col("trace_id") == trace_id).first() if failures is not None else None
        if there is not None:
            raise DecisionError(f"{trace.strip()!r} is failure {there['failure_id']} ({there['status']}) already")
        row = spark.createDataFrame([(trace_id, "confirmed", "manual", [], [], reviewer, reason)], "trace_id string, status string, origin string, signals array<" + evidence.SIGNAL + ">, kinds array<string>, reviewer string, reason string")
        new = row.withColumns({"failure_id": failure_id(F.col("trace_id")), "reviewed_at": F.current_timestamp()})
        chosen.append(new.first()["failure_id"])
        return _put(new)

    transact(at, change)
    return chosen[-1]
