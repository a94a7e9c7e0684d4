"""Edits and their carry-over, analysis with its cache, span and run-tree assembly."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import analysis, edits, families
from tracewright.sources import spans as S

FAMILY = "cluster_id string, label string, labelled_by string, dismissed boolean"


def test_carry_over(spark):
    old = spark.createDataFrame([("a", "mine", "me", False), ("b", "x", None, True), ("c", "y", None, False)], FAMILY)
    new = spark.createDataFrame([("a", "derived", None, False), ("b", "z", None, False), ("d", "w", None, False)], FAMILY)
    got = sorted(map(tuple, edits.carry_over(old, new).collect()))
    assert got == [("a", "mine", "me", False), ("b", "z", None, True), ("d", "w", None, False)]
    with pytest.raises(edits.EditsWouldBeLost):
        edits.carry_over(old, new.where("cluster_id = 'd'"))
    assert edits.carry_over(old, new.where("cluster_id = 'd'"), force=True).count() == 1
    assert edits.dismiss(edits.rename(new, "d", "q", "me"), "d").where("cluster_id = 'd'").first()[1:] == ("q", "me", True)


def test_merge_and_split(spark):
    rows = [("f1", "a", 0.1, "low"), ("f2", "a", 0.2, None), ("f3", "b", 0.0, "high")]
    members = families.roles(spark.createDataFrame(rows, "failure_id string, cluster_id string, distance double, severity string"))
    one = edits.merge(members, ["a", "b"]).collect()
    assert len({r.cluster_id for r in one}) == 1
    assert {r.failure_id: r.roles for r in one} == {"f1": [], "f2": ["boundary"], "f3": ["central", "high_severity"]}
    two = edits.split(members, "a", ["f2"]).collect()
    assert len({r.cluster_id for r in two}) == 3 and {r.failure_id: r.roles for r in two}["f2"] == ["central"]
    with pytest.raises(LookupError):
        edits.split(members, "a", ["f3"])


def test_analysis_pass(spark):
    failures = spark.createDataFrame([(f"f{k}", s) for k, s in enumerate(("candidate", "confirmed", "dismissed", "candidate", "candidate"))], "failure_id string, status string")
    done = spark.createDataFrame([("f0", "other", "c", "low", "s", "stub", 1), ("f3", "other", "c", "low", "s", "manual", 0), ("f4", "other", "c", "low", "s", "stub", 0)], analysis.COLUMNS + ", analyzer string, prompt_version int")
    todo = analysis.needed(failures, done, "stub", 1)
    assert sorted(r.failure_id for r in todo.collect()) == ["f1", "f4"]
    assert sorted(r.failure_id for r in analysis.needed(failures, done, "stub", 1, force=True).collect()) == ["f0", "f1", "f4"]
    cache = spark.createDataFrame([], analysis.COLUMNS.replace("failure_id", "key"))
    rows, fresh = analysis.described(todo.select("failure_id", F.lit("same").alias("prompt")), cache, analysis.stub, "stub", 1)
    assert fresh.count() == 1 and [r.summary for r in rows.collect()] == ["[stub] same"] * 2
    assert analysis.described(todo.select("failure_id", F.lit("same").alias("prompt")), fresh, analysis.stub, "stub", 1)[1].count() == 0
    named = analysis.label(done, spark.createDataFrame([("f0", "hallucination", "c", "high", "m")], analysis.COLUMNS))
    assert {r.failure_id: r.analyzer for r in named.collect()} == {"f0": "manual", "f3": "manual", "f4": "stub"}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z")], "failure_id string, text string")
    none = spark.createDataFrame([], "key string, vector array<double>")
    rows, fresh = analysis.embedded(texts, none, families.embedder(), "hashing:512:0")
    assert fresh.count() == 2 and rows.count() == 3
    assert analysis.embedded(texts, fresh, families.embedder(), "hashing:512:0")[1].count() == 0


def test_span_assembly(spark, tmp_path):
    def span(s, p, start, name, code=0, **a):
        return {"traceId": "t", "spanId": s, "parentSpanId": p, "name": name, "startTimeUnixNano": str(start * 10**9), "endTimeUnixNano": str((start + 3) * 10**9), "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in a.items()], "status": {"code": code, "message": "boom" if code else ""}}

    attrs = {"openinference.span.kind": "TOOL"}
    rows = [span("a", "", 1, "root", **{"output.value": "done", "llm.model_name": "m"}), span("b", "a", 2, "look up", **attrs, **{"input.value": '{"q": 1}', "output.value": "r"}), span("c", "a", 3, "pay", 2, **attrs, **{"tool.parameters": "{}", "tool.name": "pay-now"})]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": rows}]}]}))
    t = S.assemble(S.read_otlp(spark, str(tmp_path))).first()
    assert (t.input_text, t.output_text, t.status, t.model, t.agent, t.n_spans) == ('{"q": 1}', "done", "error", "m", "svc", 3)
    assert [(e.type, e.tool) for e in t.events] == [("tool_call", "look_up"), ("tool_call", "pay_now"), ("tool_result", "look_up"), ("tool_result", "pay_now")]
    assert t.events[0].body == '{"q": 1}' and t.events[1].body == "{}" and t.events[3].error == "boom"
    assert [(e.name, e.passed, e.reason) for e in t.evaluations] == [("pay", False, "boom")]


def test_run_assembly(spark, tmp_path):
    runs = [
        {"id": "1", "name": "chain", "run_type": "chain", "start_time": "2024-01-01T00:00:00Z", "inputs": {"messages": [[{"type": "human", "content": "hi"}, {"role": "ai", "content": ""}]]}, "outputs": {"output": "bye"}, "feedback": [{"value": "bad"}]},
        {"id": "2", "trace_id": "1", "parent_run_id": "1", "name": "get it", "run_type": "tool", "start_time": "2024-01-01T00:00:01Z", "inputs": {"x": 1}, "outputs": {}},
        {"id": "3", "name": "c", "run_type": "chain", "start_time": "2024-01-01T00:00:00Z", "inputs": {"question": "why"}, "error": "e"},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, runs)))
    got = {r.trace_id: r for r in S.assemble_runs(S.read_runs(spark, str(tmp_path))).collect()}
    assert [tuple(m) for m in got["1"].input_messages] == [("user", "hi")]
    assert (got["1"].output_text, got["1"].status, got["1"].rating, [t.tool for t in got["1"].tools]) == ("bye", "failure", "negative", ["get_it"])
    assert (got["3"].input_text, got["3"].status) == ("why", "error")
