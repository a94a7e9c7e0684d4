"""The whole way from a file of traces to drafted tests, and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracewright.__main__ import main
from tracewright.operators import ingest, runs
from tracewright.operators.versions import Changes, Store
from tracewright.plans import from_traces
from tracewright.sources import adapters


def trace(k, tool, status="failure", **more):
    call = {"type": "tool_call", "event_id": "1", "tool": tool, "call_id": "c", "arguments": {"order": {"id": k}}}
    result = {"type": "tool_result", "event_id": "2", "tool": tool, "call_id": "c", "result": {"ok": True}}
    return {"trace_id": f"t{k}", "input": {"text": f"request {k} from user{k}@mail.example.org"}, "events": [call, result], "outcome": {"status": status}} | more


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")


def test_from_traces(spark, tmp_path):
    rows = [trace(k, "refund") for k in range(4)] + [trace(k, "search_flights") for k in range(4, 6)] + [trace(9, "refund", "success")]
    # the address goes before the content is hashed, so these two are one interaction
    rows += [trace(10, "pay", input={"text": "mail a@x.example.org"}), trace(11, "pay", input={"text": "mail b@y.example.org"})]
    for r in rows[-2:]:
        r["events"] = []
    write(tmp_path / "in.jsonl", rows)
    report = from_traces.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    assert (report.read, report.issues) == (9, 1)
    kept = {r.trace_id for r in Store(spark, str(tmp_path / "out")).read("traces").collect()}
    # refunds of different orders are different interactions: arguments count
    assert kept == {f"t{k}" for k in (0, 1, 2, 3, 4, 5, 9, 10)}
    assert report.failures == 7 and report.drafts >= report.families >= 2
    tests = Store(spark, str(tmp_path / "out")).read("tests").collect()
    assert all(e.type in ("tool_argument_not_equals", "human_rubric") for t in tests for e in t.expectations) and not any(t.blocking for t in tests)
    # nothing unredacted in any written file
    raw = b"".join(open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(tmp_path / "out") for f in fs)
    assert b"mail.example.org" not in raw and b"x.example.org" not in raw
    one = next(t for t in tests if t.provenance.trace_id == "t0" or t.expectations[0].type == "tool_argument_not_equals")
    assert one.input.text.startswith("request ") and one.fixtures[0].result == '{"ok":true}' and '"order"' in one.fixtures[0].arguments
    assert "no expectation says what the agent should do" in one.warnings and one.provenance.content_hash.startswith("sha256:")
    # a reviewed test stays as it is; the others are made anew
    at, first = Store(spark, str(tmp_path / "out")), tests[0].test_id
    marked = spark.createDataFrame(tests, at.read("tests").schema).withColumn("status", F.when(F.col("test_id") == first, "approved").otherwise(F.col("status"))).withColumn("warnings", F.when(F.col("test_id") == first, F.array(F.lit("mine"))).otherwise(F.col("warnings")))
    at.commit(at.version(), Changes(replace={"tests": marked}))
    assert from_traces.run(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out")) == report
    again = {t.test_id: t for t in at.read("tests").collect()}
    assert len(again) == len(tests) and again[first].status == "approved" and again[first].warnings == ["mine"]
    assert Store(spark, str(tmp_path / "out")).read("traces").count() == 8


def test_ingest_against_the_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    write(tmp_path / "a.jsonl", [trace(1, "pay"), trace(2, "pay", input={"text": "call (415) 555-2671"}), trace(1, "pay")])
    dry = ingest.ingest(spark, str(tmp_path / "a.jsonl"), folder, ingest.Mode.DRY_RUN)
    assert (dry.mode, dry.stored, dry.occurrences) == ("dry-run", 2, 0) and not os.path.exists(folder)
    got = ingest.ingest(spark, str(tmp_path / "a.jsonl"), folder, errors=str(tmp_path / "errors"))
    assert (got.records, got.valid, got.invalid, got.issues, got.duplicate_ids, got.stored, got.occurrences) == (4, 2, 2, 2, 1, 2, 2)
    assert got.by_rule == {"email": 1, "phone": 1} and (got.redactions, got.redacted_traces) == (2, 2) and not got.ok
    kinds = sorted(json.loads(line)["kind"] for f in os.listdir(tmp_path / "errors") if f.startswith("part") for line in open(tmp_path / "errors" / f))
    assert kinds == ["duplicate_id", "json"] and [x[3] for x in got.sample] == ["duplicate_id", "json"]
    # again, under another id, and with other arguments under a known id
    other = trace(2, "pay", input={"text": "call (415) 555-9999"})
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in (trace(1, "pay"), other | {"trace_id": "x@y.example.org"}, trace(1, "pay") | {"trace_id": "t2"}, trace(7, "pay"))))
    got = ingest.ingest(spark, str(tmp_path / "b.jsonl"), folder)
    assert (got.stored, got.already_stored, got.content_duplicates, got.id_conflicts, got.occurrences) == (1, 1, 1, 1, 2)
    assert got.identifier_risks == 1 and got.notices == ("a trace id looks like an email address",) and not got.ok
    assert sorted(r.trace_id for r in Store(spark, folder).read("traces").collect()) == ["t1", "t2", "t7"]
    assert ingest.ingest(spark, str(tmp_path / "b.jsonl"), folder).stored == 0
    assert ingest.ingest(spark, str(tmp_path / "b.jsonl")).mode == "validate"


def test_interactions_differ_by_arguments_and_results(spark):
    from tracewright.sources import traces

    call = lambda amount, **more: {"type": "tool_call", "tool": "pay", "event_id": "e", "call_id": "c", "arguments": {"amount": amount}} | more
    one = lambda *events: json.dumps({"trace_id": "t", "input": {"text": "x"}, "events": events})
    result = lambda r: {"type": "tool_result", "tool": "pay", "call_id": "c", "result": r}
    texts = [one(call(1), result("ok")), one(call(999), result("boom")), one(call(1, event_id="other", timestamp="2024-01-01T00:00:00Z"), result("ok")), one(call("1"), result("ok")), one(call(1), result({"ok": 1})), one(call(1), result(None))]
    rows = spark.createDataFrame([("f", k, True, t) for k, t in enumerate(texts)], "file string, line int, utf8 boolean, text string")
    got = [r.content_hash for r in ingest.with_hash(traces.parse(rows)).orderBy("line").collect()]
    assert got[0] == got[2] and len(set(got)) == 5


def test_formats(spark, tmp_path):
    span = lambda s, p, name, start, a: {"traceId": "t", "spanId": s, "parentSpanId": p, "name": name, "startTimeUnixNano": str(start * 10**9), "endTimeUnixNano": str((start + 1) * 10**9), "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in a.items()]}
    asks = {"llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "refund me", "llm.output_messages.0.message.role": "assistant", "llm.output_messages.0.message.content": "done"}
    for j, (name, arguments) in enumerate((("refund", '{"id": 1}'), ("refund", '{"id": 1}'), ("look up", "{}"))):
        asks |= {f"llm.output_messages.0.message.tool_calls.{j}.tool_call.function.name": name, f"llm.output_messages.0.message.tool_calls.{j}.tool_call.function.arguments": arguments}
    spans = [span("a", "", "agent", 1, asks), span("b", "a", "refund", 3, {"openinference.span.kind": "TOOL", "tool.parameters": '{"id":1}', "output.value": '{"ok": true}'})]
    (tmp_path / "x.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}) + "\n{broken\n")
    valid, issues = adapters.adapter("otlp")(spark, str(tmp_path / "x.json"))
    (t,) = valid.collect()
    assert [tuple(m) for m in t.input_messages] == [("user", "refund me")] and [tuple(m) for m in t.output_messages] == [("assistant", "done")] and t.status == "unknown"
    # two of three declared calls were the same: one of them was run
    assert sorted(((e.type, e.tool, e.call_id) for e in t.events), key=str) == [("tool_call", "look_up", None), ("tool_call", "refund", "b"), ("tool_call", "refund", None), ("tool_result", "refund", "b")]
    assert [(i.kind, i.line) for i in issues.collect()] == [("json", 2)]
    runs_ = [
        {"id": "1", "name": "chain", "run_type": "chain", "start_time": "2024-01-01T00:00:00Z", "inputs": {"messages": [[{"type": "human", "content": "hi"}]]}, "outputs": {"generations": [[{"message": {"kwargs": {"tool_calls": [{"name": "get", "args": {"x": 1}}, {"function": {"name": "put", "arguments": "not json"}}]}}}]]}, "tags": ["a"], "extra": {"metadata": {"ls_model_name": "m", "ls_project_name": "p"}}},
        {"id": "2", "trace_id": "1", "parent_run_id": "1", "name": "get", "run_type": "tool", "start_time": "2024-01-01T00:00:01Z", "inputs": {"x": 1}, "outputs": {"y": 2}, "feedback": [{"score": 0, "comment": "no"}]},
    ]
    (tmp_path / "r.json").write_text(json.dumps(runs_))
    valid, issues = adapters.adapter("run-tree")(spark, str(tmp_path / "r.json"))
    (t,) = valid.collect()
    assert issues.count() == 0 and (t.status, t.rating, t.comment, t.model, t.agent) == ("failure", "negative", "no", "m", "p")
    assert [tuple(m) for m in t.input_messages] == [("user", "hi")] and sorted((e.type, e.tool) for e in t.events) == [("tool_call", "get"), ("tool_call", "put"), ("tool_result", "get")]
    try:
        adapters.adapter("other")
        raise AssertionError
    except adapters.UnknownFormat:
        pass


def test_runs_are_saved_promoted_and_compared(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for k, (run, target, outcomes) in enumerate((("aa1", "baseline", "pass fail fail"), ("aa2", "candidate", "pass pass error"), ("bb3", "baseline", "fail pass pass"))):
        row = spark.createDataFrame([(run, target, "sha256:1", 3, 1, "finished")], "run_id string, target_id string, suite_hash string, tests int, repetitions int, status string")
        row = row.withColumns({"started_at": F.lit(f"2024-01-0{k + 1}").cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")})
        cases = spark.createDataFrame([(run, f"t{i}", 0, o, "timeout" if o == "error" else None, 1) for i, o in enumerate(outcomes.split())], "run_id string, test_id string, repetition int, outcome string, error_kind string, latency int")
        for _ in range(2):
            runs.save(folder, row, cases)
    assert [(r.run_id, r.passed, r.errored, r.is_baseline) for r in runs.recent(spark, folder).collect()] == [("bb3", 2, 0, False), ("aa2", 2, 1, False), ("aa1", 1, 0, False)]
    with pytest.raises(runs.RunError):
        runs.find(spark, folder, "aa")
    with pytest.raises(runs.RunError):
        runs.promote(spark, folder, "aa2", "me")
    assert runs.promote(spark, folder, "aa1", "me", "why") == "aa1" and runs.baseline(spark, folder)["reviewer"] == "me"
    got = {r.test_id: (r.classification, r.reason) for r in runs.compare(spark, folder).collect()}
    assert got == {"t0": ("unchanged_pass", ""), "t1": ("fixed", ""), "t2": ("not_comparable", "candidate timeout")}
    with pytest.raises(runs.RunError):
        runs.compare(spark, folder, "bb3", "bb")


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "in.jsonl", [trace(1, "a")])
    assert main(["ingest", str(tmp_path / "in.jsonl")]) == 1
    assert "1 valid, 1 issues" in capsys.readouterr().out
    assert main(["query", "nothing", "/tmp"]) == 2
    assert main(["query", "status_counts", "/root/testdata/sf0.001"]) == 0
    rows = [(r, "t", 0, o, 1.0) for r, o in (("a", "pass"), ("b", "fail"))]
    spark.createDataFrame(rows, "run_id string, test_id string, repetition int, outcome string, latency double").write.parquet(str(tmp_path / "r"))
    assert main(["compare", str(tmp_path / "r"), "a", "b"]) == 1
    assert main(["compare", str(tmp_path / "r"), "b", "a"]) == 0
