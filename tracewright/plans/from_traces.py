"""From a file of traces to families and drafted tests, in one pass of plans.

Stages: read and validate, redact, classify against the store and add, detect, gather (described failures by their
analysis, the others by what was observed), embed and cluster, choose representatives, draft expectations.  Each
stage is a function of DataFrames.  ``run`` commits one version of the store ``out`` for the traces and one for all that
follows from them, and meets what people did meanwhile: a decision about a failure, a family's name or dismissal, and a
reviewed test stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import identity
from tracewright.operators import decisions, discovery, edits, evidence, expectations, families
from tracewright.operators import ingest as batches
from tracewright.operators.versions import Changes, Store, transact
from tracewright.shared import cut

TABLES = ("traces", "occurrences", "failures", "analyses", "families", "members", "tests")
ANALYSIS = "failure_id string, failure_type string, component string, severity string, summary string"
THRESHOLDS = {"described": families.DESCRIBED, "undescribed": families.UNDESCRIBED}
GENERATOR = 1


@dataclass(frozen=True)
class Report:
    read: int
    issues: int
    failures: int
    families: int
    drafts: int


def calls_of(rows: DataFrame) -> DataFrame:
    """Adds ``calls`` (tool and JSON arguments in order) and ``flat`` of the last call."""
    made = F.from_json(F.get_json_object("text", "$.events"), "array<struct<type:string,tool:string,arguments:string>>")
    calls = F.transform(F.filter(F.coalesce(made, F.array().cast("array<struct<type:string,tool:string,arguments:string>>")), lambda e: e["type"] == "tool_call"), lambda e: F.struct(e["tool"].alias("tool"), F.coalesce(e["arguments"], F.lit("{}")).alias("arguments")))
    rows = rows.withColumn("calls", calls)
    return rows.withColumn("flat", expectations.flatten_json(F.try_element_at("calls", F.lit(-1))["arguments"]))


def grouped(failures: DataFrame, kept: DataFrame, analyses: DataFrame | None = None, thresholds: dict[str, float] = THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(members with distance and roles, families with label) of open failures; described and undescribed ones never mix."""
    told = failures.sparkSession.createDataFrame([], ANALYSIS) if analyses is None else analyses
    calls = kept.select("trace_id", F.transform("calls", lambda c: c["tool"]).alias("tools"))
    rows = discovery.gather(failures, told, calls, undescribed=True)
    rows = cut(rows.withColumn("vector", families.embedder()(F.col("text"))))
    found = families.cluster(rows, thresholds).drop("population")
    placed = families.member_distances(rows.join(found, "failure_id"))
    members = families.roles(placed)
    return members, families.labels(members)


def fixtures_of(text: Column) -> Column:
    """array<tool, arguments, result, error, call_id>: the results the agent saw, with the arguments of their call; of
    repeated call ids the last counts."""
    kind = "array<struct<type:string,tool:string,call_id:string,arguments:string,result:string,error:string>>"
    events = F.coalesce(F.from_json(F.get_json_object(text, "$.events"), kind), F.array().cast(kind))
    calls = F.filter(events, lambda e: (e["type"] == "tool_call") & e["call_id"].isNotNull())
    mine = lambda r: F.try_element_at(F.filter(calls, lambda c: c["call_id"] == r["call_id"]), F.lit(-1))["arguments"]
    results = F.filter(events, lambda e: e["type"] == "tool_result")
    return F.transform(results, lambda r: F.struct(r["tool"].alias("tool"), F.coalesce(mine(r), F.lit("{}")).alias("arguments"), r["result"].alias("result"), r["error"].alias("error"), r["call_id"].alias("call_id")))


def warnings_of(es: Column) -> Column:
    """What a reviewer should know of a draft's expectations."""
    bad = F.transform(F.filter(es, lambda e: expectations.invalid(e).isNotNull()), lambda e: F.concat(F.lit("invalid expectation ("), F.coalesce(expectations.describe(e), F.lit("?")), F.lit("): "), expectations.invalid(e)))
    pairs = F.transform(expectations.contradictions(es), lambda c: F.concat(F.lit("contradictory expectations: "), c["reason"]))
    positive = F.exists(es, lambda e: e["type"].isin(*expectations.POSITIVE))
    return F.concat(bad, pairs, F.when(positive, F.array().cast("array<string>")).otherwise(F.array(F.lit("no expectation says what the agent should do"))))


def targets(failures: DataFrame, members: DataFrame, representatives: bool = True) -> DataFrame:
    """Failures that get a test, with their family: representatives only, or all; never dismissed ones."""
    rows = failures.where("status <> 'dismissed'").select("failure_id", "trace_id", "kinds")
    context = members.select("failure_id", "cluster_id", "roles")
    if representatives:
        return rows.join(context.where(F.size("roles") > 0), "failure_id")
    return rows.join(context, "failure_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def drafts(members: DataFrame, failures: DataFrame, kept: DataFrame, labels: DataFrame | None = None, representatives: bool = True) -> DataFrame:
    """A draft for each target: input, fixtures, expectations, warnings, and where it comes from."""
    failed = F.filter("evaluations", lambda e: (e["passed"] == F.lit(False)) & (F.coalesce(e["reason"], F.lit("")) != ""))
    said = F.coalesce(F.nullif(F.col("comment"), F.lit("")), F.try_element_at(failed, F.lit(1))["reason"])
    rows = targets(failures, members, representatives).join(kept, "trace_id")
    named = labels if labels is not None else members.select("cluster_id").distinct().withColumn("label", F.lit(None).cast("string"))
    rows = rows.join(named.select("cluster_id", F.col("label").alias("cluster_label")), "cluster_id", "left")
    rows = rows.withColumns({"failure_type": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "evidence": said})
    out = expectations.derive(rows).withColumn("contradictions", expectations.contradictions(F.col("expectations")))
    asked = F.coalesce("input_text", F.try_element_at(F.filter("input_messages", lambda m: m["role"] == "user"), F.lit(1))["content"], F.try_element_at("input_messages", F.lit(1))["content"])
    unfit = F.exists("expectations", lambda e: expectations.invalid(e).isNotNull())
    provenance = F.struct("trace_id", "failure_id", "content_hash", "cluster_id", "cluster_label", F.col("roles").alias("representative_roles"), "failure_type", F.col("kinds").alias("evidence"), F.lit(GENERATOR).alias("generator_version"))
    return out.select(
        identity.test_id(F.col("trace_id"), asked).alias("test_id"), "failure_id", "cluster_id", F.lit("draft").alias("status"),
        F.struct(F.col("input_text").alias("text"), F.col("input_messages").alias("messages")).alias("input"), fixtures_of(F.col("text")).alias("fixtures"),
        "expectations", "contradictions", warnings_of(F.col("expectations")).alias("warnings"), provenance.alias("provenance"),
        ((F.size("contradictions") > 0) | (F.size("expectations") == 0) | unfit).alias("blocking"),
    )


def rebuilt(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """The next snapshot of tests: reviewed and edited ones stay as they are, other drafts are made anew."""
    if stored is None:
        return new
    reviewed = stored.where("status <> 'draft' or edited" if "edited" in stored.columns else "status <> 'draft'")
    return reviewed.unionByName(new.join(reviewed.select("failure_id"), "failure_id", "left_anti"), allowMissingColumns=True)


def next_families(old: DataFrame | None, labels: DataFrame, force: bool = False) -> DataFrame:
    """New families with the names and dismissals that people gave to the old ones of the same members."""
    new = labels.withColumns({"labelled_by": F.lit(None).cast("string"), "dismissed": F.lit(False)})
    return new if old is None else edits.carry_over(old, new, force)


def follow(at: Store, base: int, force: bool = False) -> dict[str, DataFrame]:
    """All tables that follow from the stored traces of a version and from what people decided."""
    traces = at.read("traces", base)
    if traces is None:
        return {}
    kept = calls_of(traces)
    failures = cut(decisions.next_failures(at.read("failures", base), evidence.failures(kept)))
    members, labels = grouped(failures, kept, at.read("analyses", base))
    members, labels = cut(members), cut(next_families(at.read("families", base), labels, force))
    open_ = members.join(discovery.open_clusters(labels).select("cluster_id"), "cluster_id", "left_semi")
    tests = cut(rebuilt(at.read("tests", base), drafts(open_, failures, kept, labels)))
    return {"failures": failures, "members": members, "families": labels, "tests": tests}


def run(spark: SparkSession, path: str, out: str, salt: bytes | None = None, format: str = "jsonl", force: bool = False) -> Report:
    """``force``: edits of families that have no counterpart any more are given up."""
    told = batches.ingest(spark, path, out, salt=salt, format=format, errors=f"{out}/issues")
    at, last = Store(spark, out), {}

    def change(base: int) -> Changes:
        last.clear()
        last.update(follow(at, base, force))
        return Changes(replace=dict(last))

    transact(at, change)
    n = lambda name: last[name].count() if name in last else 0
    return Report(told.valid, told.issues, n("failures"), n("families"), n("tests"))
