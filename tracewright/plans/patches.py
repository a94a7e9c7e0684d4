"""Edits of drafted tests as patches: JSON objects that replace a test's input, its expectations, or both.

A field that a patch does not name stays; null removes it, which neither field allows.  A batch is applied as a whole or not
at all: one problem in any patch leaves every stored test as it was.  Warnings and contradictions are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import expectations
from tracewright.operators.versions import Changes, Store, transact
from tracewright.plans.from_traces import warnings_of
from tracewright.shared import cut

EDITABLE = ("input", "expectations")
MAP = "map<string,variant>"


class EditRefused(ValueError):
    """Problems of a batch of patches; nothing was applied."""


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _said(v: Column) -> Column:
    """Whether a variant is there and not null."""
    return v.isNotNull() & ~F.is_variant_null(v)


def _one(problem: Column | str) -> Column:
    return F.array(F.lit(problem) if isinstance(problem, str) else problem)


def _input_problem(given: Column) -> Column:
    m = given.try_cast(MAP)
    text, messages = m["text"], m["messages"]
    listed = messages.try_cast("array<variant>")
    lacking = F.transform(listed, lambda x, i: F.when(F.coalesce(_said(x.try_cast(MAP)["role"]) & _said(x.try_cast(MAP)["content"]), F.lit(False)), F.lit(None)).otherwise(i))
    first = F.get(F.filter(lacking, lambda i: i.isNotNull()), F.lit(0))
    blank = F.trim(F.coalesce(text.try_cast("string"), F.lit(""))) == ""
    return (
        F.when(F.is_variant_null(given), "input is required")
        .when(_kind(given) != "OBJECT", "input must be a mapping")
        .when(_said(text) & (_kind(text) != "STRING"), "input.text must be text")
        .when(_said(messages) & (_kind(messages) != "ARRAY"), "input.messages must be a list")
        .when(first.isNotNull(), F.concat(F.lit("input.messages["), first.cast("string"), F.lit("] needs a role and content")))
        .when(blank & (F.coalesce(F.size(listed), F.lit(0)) <= 0), "input needs text or a message")
    )


def _expectation(x: Column) -> Column:
    m = x.try_cast(MAP)
    return F.struct(
        m["type"].try_cast("string").alias("type"), m["tool"].try_cast("string").alias("tool"), m["path"].try_cast("string").alias("path"), F.to_json(m["value"]).alias("value")
    ).cast(expectations.EXPECTATION)


def _expectation_problems(given: Column, read: Column) -> Column:
    def problem(e: Column, i: Column) -> Column:
        at = F.concat(F.lit("expectations["), i.cast("string"), F.lit("]"))
        unknown = ~F.coalesce(e["type"].isin(*expectations.TYPES), F.lit(False))
        return (
            F.when(e.isNull(), F.concat(at, F.lit(" must be a mapping")))
            .when(unknown, F.concat(at, F.lit(": unknown type "), F.coalesce(e["type"], F.lit("null"))))
            .otherwise(F.concat(at, F.lit(": "), expectations.invalid(e)))
        )

    return (
        F.when(F.is_variant_null(given), _one("a test needs at least one expectation"))
        .when(_kind(given) != "ARRAY", _one("expectations must be a list"))
        .when(F.size(read) == 0, _one("a test needs at least one expectation"))
        .otherwise(F.filter(F.transform(read, problem), lambda p: p.isNotNull()))
    )


def checked(patches: DataFrame) -> DataFrame:
    """Rows (test_id, patch, editor) with the JSON ``new_input``, ``new_expectations`` (null: not named) and ``problems``."""
    rows = patches.select("test_id", "editor", "patch", F.try_parse_json("patch").alias("doc"))
    rows = rows.withColumn("m", F.col("doc").try_cast(MAP)).withColumns({"input": F.col("m")["input"], "given": F.col("m")["expectations"]})
    items = F.col("given").try_cast("array<variant>")
    read = F.transform(items, lambda x: F.when(_kind(x) == "OBJECT", _expectation(x)))
    rows = rows.withColumn("read", read)
    strange = F.array_sort(F.filter(F.map_keys("m"), lambda k: ~k.isin(*EDITABLE)))
    none = F.array().cast("array<string>")
    fields = F.concat(
        F.when(F.col("input").isNull(), none).otherwise(F.array_compact(_one(_input_problem(F.col("input"))))),
        F.when(F.col("given").isNull(), none).otherwise(_expectation_problems(F.col("given"), F.col("read"))),
    )
    whole = (
        F.when(F.trim(F.coalesce("patch", F.lit(""))) == "", _one("the document is empty"))
        .when(F.col("doc").isNull(), _one("the document is not JSON"))
        .when(F.col("m").isNull() | (_kind(F.col("doc")) != "OBJECT"), _one("a mapping is needed"))
        .when(F.size(strange) > 0, _one(F.concat(F.lit("only input and expectations can be edited; remove: "), F.array_join(strange, ", "))))
        .when(F.size("m") == 0, _one("the document is empty"))
        .otherwise(fields)
    )
    rows = rows.withColumn("found", whole)
    clash = F.when((F.size("found") == 0) & F.col("read").isNotNull(), F.transform(expectations.contradictions(F.col("read")), lambda c: F.concat(F.lit("contradictory expectations: "), c["reason"]))).otherwise(none)
    return rows.select("test_id", "editor", F.to_json("input").alias("new_input"), F.col("read").alias("new_expectations"), F.concat("found", clash).alias("problems"))


def problems(tests: DataFrame, read: DataFrame) -> DataFrame:
    """(test_id, problem) of checked patches: their own, of tests that are not there, and of tests with two patches."""
    own = read.select("test_id", F.explode("problems").alias("problem"))
    lost = read.join(tests, "test_id", "left_anti").select("test_id", F.lit("no such test").alias("problem"))
    twice = read.groupBy("test_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("test_id", F.lit("more than one patch").alias("problem"))
    return own.unionByName(lost).unionByName(twice)


def patched(tests: DataFrame, read: DataFrame) -> DataFrame:
    """``tests`` after checked patches without problems; ``edited``, ``edited_by`` tell which were changed."""
    for name, kind in (("edited", "boolean"), ("edited_by", "string")):
        if name not in tests.columns:
            tests = tests.withColumn(name, F.lit(None).cast(kind))
    given = read.select("test_id", "editor", "new_input", "new_expectations")
    rows = tests.join(given, "test_id", "left")
    es = F.coalesce("new_expectations", "expectations")
    input_ = F.coalesce(F.from_json("new_input", tests.schema["input"].dataType), F.col("input"))
    named = F.col("new_input").isNotNull() | F.col("new_expectations").isNotNull()
    rows = rows.withColumns({"input": input_, "expectations": es, "edited": F.coalesce("edited", F.lit(False)) | named, "edited_by": F.when(named, F.col("editor")).otherwise(F.col("edited_by"))})
    if "contradictions" in tests.columns:
        rows = rows.withColumn("contradictions", F.when(named, expectations.contradictions(F.col("expectations"))).otherwise(F.col("contradictions")))
    if "warnings" in tests.columns:
        rows = rows.withColumn("warnings", F.when(named, warnings_of(F.col("expectations"))).otherwise(F.col("warnings")))
    if "blocking" in tests.columns:
        # patches name valid expectations without contradiction; of others the old verdict stands
        rows = rows.withColumn("blocking", F.when(F.col("new_expectations").isNotNull(), F.lit(False)).otherwise(F.col("blocking")))
    return rows.select(*tests.columns)


def edit(spark: SparkSession, folder: str, patches: DataFrame, shown: int = 20) -> int:
    """Applies patches (test_id, patch, editor) to the tests of a store as one version; its number."""
    at, read = Store(spark, folder), cut(checked(patches))

    def change(base: int) -> Changes:
        tests = at.read("tests", base)
        if tests is None:
            raise EditRefused("no tests are stored")
        if bad := problems(tests, read).orderBy("test_id", "problem").limit(shown).collect():
            raise EditRefused("; ".join(f"{r['test_id']}: {r['problem']}" for r in bad))
        return Changes(replace={"tests": patched(tests, read)})

    return transact(at, change)
