"""Analyses that may fail, produced limits, and edits of tests as patches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewright.operators import analysis
from tracewright.operators.versions import Changes, Store
from tracewright.plans import from_traces, patches

CACHE = analysis.COLUMNS.replace("failure_id", "key")


def provider(log):
    """Fails for every third prompt; writes down what it is asked."""

    def describe(prompt):
        open(os.path.join(log, f"{prompt}.{os.urandom(4).hex()}"), "w").close()
        if int(prompt[1:]) % 3 == 0:
            raise ValueError("third")
        return {"failure_type": "other", "component": "c", "severity": "low", "summary": prompt}

    return analysis.each(describe)


def rows_of(spark, n):
    return spark.createDataFrame([(f"f{k:03d}", f"p{k}") for k in range(n)], "failure_id string, prompt string")


@pytest.mark.parametrize("limit,want", [(None, 40), (10, 10), (40, 40), (1000, 40), (0, 0)])
def test_failed_items_do_not_count_and_nothing_is_asked_twice(spark, tmp_path, limit, want):
    got = analysis.produce(rows_of(spark, 60), spark.createDataFrame([], CACHE), provider(str(tmp_path)), "a", 1, limit)
    good = [f"f{k:03d}" for k in range(60) if k % 3][:want]
    assert sorted(r.failure_id for r in got.analyses.collect()) == good
    errors = {r.failure_id: r.error for r in got.errors.collect()}
    assert all(int(k[1:]) % 3 == 0 and e == "ValueError: third" for k, e in errors.items())
    assert limit is not None or len(errors) == 20
    got.fresh.count()
    asked = [name.split(".")[0] for name in os.listdir(tmp_path)]
    assert len(asked) == len(set(asked)) and (limit != 10 or len(asked) <= 30)
    # what was answered beyond the limit is not asked again, and cached items count
    again = analysis.produce(rows_of(spark, 60), got.fresh, provider(str(tmp_path)), "a", 1, limit)
    assert sorted(r.failure_id for r in again.analyses.collect()) == good
    repeated = [name.split(".")[0] for name in os.listdir(tmp_path)]
    assert all(int(p[1:]) % 3 == 0 for p in repeated if repeated.count(p) > 1)


def test_equal_prompts_are_one_question(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p3"), ("d", "p3")], "failure_id string, prompt string")
    got = analysis.produce(rows, spark.createDataFrame([], CACHE), provider(str(tmp_path)), "a", 1)
    assert sorted(r.failure_id for r in got.analyses.collect()) == ["a", "b"] and sorted(r.failure_id for r in got.errors.collect()) == ["c", "d"]
    assert len(os.listdir(tmp_path)) == 2


TEST = "test_id string, failure_id string, status string, input struct<text:string,messages:array<struct<role:string,content:string>>>, expectations array<struct<type:string,tool:string,path:string,value:string>>, contradictions array<struct<first:int,second:int,reason:string>>, warnings array<string>, blocking boolean"


def drafted(spark):
    e = [("tool_not_called", "t", None, None)]
    return spark.createDataFrame([(f"t{k}", f"f{k}", "draft", ("x", []), e, [], ["old"], True) for k in range(3)], TEST)


def given(spark, *rows):
    return spark.createDataFrame([(t, p if isinstance(p, str) or p is None else json.dumps(p), "me") for t, p in rows], "test_id string, patch string, editor string")


GOOD = {"expectations": [{"type": "tool_argument_equals", "tool": "t", "path": "a.b", "value": 1}]}


def test_a_patch_replaces_what_it_names(spark, tmp_path):
    at = Store(spark, str(tmp_path))
    at.commit(0, Changes(replace={"tests": drafted(spark)}))
    patches.edit(spark, str(tmp_path), given(spark, ("t0", GOOD), ("t1", {"input": {"messages": [{"role": "user", "content": "hi"}]}})))
    got = {r.test_id: r for r in at.read("tests").collect()}
    assert got["t0"].expectations[0][:] == ("tool_argument_equals", "t", "a.b", "1") and got["t0"].input.text == "x"
    assert (got["t0"].warnings, got["t0"].blocking, got["t0"].edited, got["t0"].edited_by) == ([], False, True, "me")
    assert got["t1"].input.text is None and got["t1"].input.messages[0].content == "hi" and got["t1"].expectations[0].type == "tool_not_called"
    assert (got["t2"].edited, got["t2"].edited_by, got["t2"].warnings) == (False, None, ["old"])
    # an edited draft is not made anew
    new = drafted(spark).withColumn("warnings", F.array(F.lit("new")))
    assert {r.test_id: r.warnings for r in from_traces.rebuilt(at.read("tests"), new).collect()}["t0"] == []
    # a second edit of one field keeps the other
    patches.edit(spark, str(tmp_path), given(spark, ("t0", {"input": {"text": "y"}})))
    again = {r.test_id: r for r in at.read("tests").collect()}["t0"]
    assert again.input.text == "y" and again.expectations[0].type == "tool_argument_equals" and again.blocking is False


@pytest.mark.parametrize(
    "test,patch,problem",
    [
        ("t1", "{", "the document is not JSON"),
        ("t1", "  ", "the document is empty"),
        ("t1", None, "the document is empty"),
        ("t1", {}, "the document is empty"),
        ("t1", [1], "a mapping is needed"),
        ("t1", {"status": "approved"}, "remove: status"),
        ("t1", {"input": None}, "input is required"),
        ("t1", {"input": "x"}, "input must be a mapping"),
        ("t1", {"input": {"text": 5}}, "input.text must be text"),
        ("t1", {"input": {"messages": "x"}}, "input.messages must be a list"),
        ("t1", {"input": {"messages": ["x"]}}, "input.messages[0] needs a role and content"),
        ("t1", {"input": {"text": "  "}}, "input needs text or a message"),
        ("t1", {"expectations": []}, "at least one expectation"),
        ("t1", {"expectations": "x"}, "expectations must be a list"),
        ("t1", {"expectations": [{"type": "max_tool_calls", "value": "two"}]}, "expectations[0]: needs a whole number"),
        ("t1", {"expectations": [{"value": 1}]}, "expectations[0]: unknown type null"),
        ("t1", {"expectations": [{"type": "tool_called", "tool": "t"}, {"type": "tool_not_called", "tool": "t"}]}, "contradictory expectations"),
        ("t9", GOOD, "no such test"),
        ("t0", GOOD, "more than one patch"),
    ],
)
def test_one_problem_refuses_the_batch(spark, test, patch, problem):
    read = patches.checked(given(spark, ("t0", GOOD), (test, patch)))
    assert any(r.test_id == test and problem in r.problem for r in patches.problems(drafted(spark), read).collect())


def test_a_refused_batch_changes_nothing(spark, tmp_path):
    at = Store(spark, str(tmp_path))
    n = at.commit(0, Changes(replace={"tests": drafted(spark)}))
    with pytest.raises(patches.EditRefused, match="t1: input is required"):
        patches.edit(spark, str(tmp_path), given(spark, ("t0", GOOD), ("t1", {"input": None})))
    assert at.version() == n
