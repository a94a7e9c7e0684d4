"""Units of the engine: identifiers, redaction, statistics, sources, store, families, expectations."""

import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import identity, redaction, statistics
from tracewright.operators import comparison, evidence, expectations, families, linkage, store
from tracewright.sources import results as result_source
from tracewright.sources import spans as span_source
from tracewright.sources import traces


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_identifiers(spark):
    lit = F.lit
    r = one(spark, *[identity.failure_id(lit(t)) for t in ("trace-1042", "trace-1043", "trace-1051")], identity.test_id(lit("trace-1042"), lit("Refund my latest order.")), identity.test_id(lit("x"), lit("[REDACTED:email] ??")))
    assert tuple(r)[:4] == ("fail-2e46a1eacb06", "fail-7750e47c4166", "fail-2bd46f02ea70", "refund_my_latest_order_2e46a1ea")
    assert r[4].startswith("test_")
    r = one(spark, identity.cluster_id(F.array(lit("b"), lit("a"))).alias("x"), identity.cluster_id(F.array(lit("a"), lit("b"))).alias("y"))
    assert r.x == r.y
    same = one(spark, identity.canonical_json(lit('{"b":1, "a":[true]}')).alias("x"), identity.canonical_json(lit('{"a":[true],"b":1}')).alias("y"))
    assert same.x == same.y


@pytest.mark.parametrize(
    "text,want",
    [
        ("(415) 555-2671 4111 1111 1111 1111", "[REDACTED:phone] [REDACTED:payment_card]"),
        ("order 1234567890123", "order 1234567890123"),
        ("order-4155552671", "order-4155552671"),
        ("write to ann.b@mail.example.org now", "write to [REDACTED:email] now"),
        ("+4915112345678", "[REDACTED:phone]"),
        ("key sk-abcdefghijklmnop1234", "key [REDACTED:token]"),
        ("Bearer abcdefghijklmnopqrstuvwx", "[REDACTED:token]"),
        ("4111-1111-1111-1111 and 5500 0000 0000 0004", "[REDACTED:payment_card] and [REDACTED:payment_card]"),
        ("", ""),
        (None, None),
    ],
)
def test_redaction(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(redaction.redact_text(F.col("t")).alias("r")).first().r
    assert got == want
    if text is not None:
        assert redaction.redact_value(text, {}) == want


def test_secret_fields(spark):
    yes, no = ("apiKey", "user_password", "X-Auth-Token", "creditCardNumber", "clientSecret"), ("tokens_used", "name", "pinned", "author")
    df = spark.createDataFrame([(k,) for k in yes + no], "k string").select("k", redaction.secret_field(F.col("k")).alias("s"))
    got = {r.k: r.s for r in df.collect()}
    assert [k for k in yes if not got[k]] == [] and [k for k in no if got[k]] == []
    assert all(redaction.is_secret(k) == got[k] for k in got)


def test_record_redaction():
    raw = {"trace_id": "a@b.example.com", "input": {"text": "mail c@d.example.com"}, "args": {"password": "x", "name": "e@f.example.com", "count": 3, "list": ["g@h.example.com"], "apiKey": {"v": 1}, "token": 5}}
    text, counts = redaction.redact_json(json.dumps(raw), salt=b"0123456789abcdef")
    out = json.loads(text)
    assert out["trace_id"].startswith("trace-") and out["args"]["name"] == "e@f.example.com"
    assert out["args"]["password"] == out["args"]["apiKey"] == "[REDACTED:secret_field]" and out["args"]["token"] == 5
    assert out["args"]["list"] == ["[REDACTED:email]"]
    assert counts == {"pseudonym": 1, "email": 2, "secret_field": 2}


def test_risky_identifiers(spark):
    df = spark.createDataFrame([("customer-(415) 555-2671",), ("a@b.example.com",), ("order-4155552671",), ("t-1",)], "k string")
    assert [r[0] for r in df.select(redaction.risky_identifier(F.col("k"))).collect()] == ["a phone number", "an email address", None, None]


@pytest.mark.parametrize("k,n,want", [(3, 3, 0.25), (12, 14, 0.012939453125), (36, 38, 5.398760549724102e-09), (5, 10, 1.0), (0, 0, 1.0)])
def test_exact_binomial(spark, k, n, want):
    assert math.isclose(one(spark, statistics.exact_binomial(F.lit(k), F.lit(n)).alias("p")).p, want, rel_tol=1e-10)


def test_exact_binomial_against_rationals(spark):
    pairs = [(k, n) for n in range(1, 31) for k in range(n + 1)]
    df = spark.createDataFrame(pairs, "k int, n int").select("k", "n", statistics.exact_binomial(F.col("k"), F.col("n")).alias("p"))
    for r in df.collect():
        want = min(Fraction(1), 2 * sum(Fraction(math.comb(r.n, i), 2**r.n) for i in range(min(r.k, r.n - r.k) + 1)))
        assert abs(r.p - float(want)) < 1e-12


def test_intervals(spark):
    w = one(spark, *[statistics.wilson(F.lit(p), F.lit(n)).alias(f"w{p}_{n}") for p, n in ((16, 20), (11, 20), (2, 3))], statistics.paired_wald(F.lit(36), F.lit(2), F.lit(89)).alias("p"), statistics.wilson(F.lit(0), F.lit(0)).alias("none"))
    assert [round(x, 8) for x in w.w16_20] == [0.58398257, 0.91934234]
    assert [round(x, 8) for x in w.w11_20] == [0.34208534, 0.74180214]
    assert [round(x, 6) for x in w.w2_3] == [0.20766, 0.938508]
    assert [round(x, 8) for x in w.p] == [0.27188739, 0.49215755] and w.none is None


@pytest.mark.parametrize(
    "before,after,want",
    [((0, 20), (16, 20), "likely_fixed"), ((0, 20), (11, 20), "unchanged_failure"), ((17, 20), (4, 20), "regression"), ((10, 20), (10, 20), "unchanged_failure"), ((20, 20), (18, 20), "regression"), ((0, 1), (1, 1), "fixed"), ((1, 1), (0, 1), "regression"), ((3, 20), (20, 20), "fixed"), ((0, 3), (2, 3), "unchanged_failure")],
)
def test_directions(spark, before, after, want):
    rows = [(run, "t", k, "pass" if k < p else "fail", 1.0) for run, (p, n) in (("baseline", before), ("candidate", after)) for k in range(n)]
    df = spark.createDataFrame(rows, "run_id string, test_id string, repetition int, outcome string, latency double")
    assert comparison.compare(df).first().classification == want


def test_verdict_ignores_errors(spark):
    rows = [("baseline", "t", k, "pass" if k < 8 else "fail" if k < 10 else "error", 1.0) for k in range(20)]
    s = comparison.summaries(spark.createDataFrame(rows, "run_id string, test_id string, repetition int, outcome string, latency double")).first()
    assert (s.verdict, s.evaluated, s.pass_rate, s.repetitions) == ("flaky", 10, 0.8, 20)
    with pytest.raises(ValueError):
        comparison.suite_compatible("a", "b")


LINES = [
    b'\xef\xbb\xbf{"trace_id": "a", "input": {"text": "hi"}, "outcome": {"status": "failure", "feedback": {"rating": "negative", "comment": "bad"}, "evaluations": [{"name": "q", "passed": false, "reason": "wrong"}]}}',
    b"",
    b"{broken",
    b"[1]",
    b'{"trace_id": "b", "input": {"text": "x"}, "extra": 1}',
    b'{"trace_id": "c", "input": {"text": "\xff"}}',
    b'{"trace_id": "a", "input": {"text": "again"}}',
    b'{"trace_id": "d", "input": {"messages": [{"role": "user", "content": "m"}]}, "events": [{"type": "tool_call", "event_id": "1", "tool": "9bad"}]}',
    b'{"trace_id": "e", "input": {"text": "y"}, "events": [{"type": "tool_result", "event_id": "1", "tool": "t", "call_id": "c"}, {"type": "message", "event_id": "1", "role": "user", "content": "z"}]}',
    b'{"trace_id": 5, "input": {"text": "y"}}',
    b'{"trace_id": "f", "input": {"text": "ok"}, "metadata": {"recorded_at": "2024-01-01T00:00:00Z", "agent": "g"}}',
]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_bytes(b"\n".join(LINES))
    valid, issues = traces.read(spark, str(path))
    assert sorted(r.trace_id for r in valid.collect()) == ["a", "f"]
    got = {(r.line, r.kind, r.field) for r in issues.collect()}
    assert got == {(3, "json", None), (4, "json", None), (5, "schema", "extra"), (6, "encoding", None), (7, "duplicate_id", "trace_id"), (8, "schema", "events.0.tool"), (9, "schema", "events.0"), (9, "schema", "events.1"), (10, "schema", "trace_id")}
    kinds = evidence.signals(valid).select("trace_id", "kind", "source", "summary").collect()
    assert [tuple(r) for r in kinds] == [("a", "explicit_status", "outcome.status", "the trace is explicitly marked as failed"), ("a", "negative_feedback", "outcome.feedback", "bad"), ("a", "failed_evaluator", "outcome.evaluations.0", "wrong")]


def attr(key, **value):
    return {"key": key, "value": value}


def test_otlp(spark, tmp_path):
    span = lambda t, s, p, start, code=0, **a: {"traceId": t, "spanId": s, "parentSpanId": p, "name": "n", "startTimeUnixNano": str(start), "endTimeUnixNano": str(start + 5000), "attributes": [attr(k, **v) for k, v in a.items()], "status": {"code": code}}
    doc = {"resourceSpans": [{"resource": {"attributes": [attr("service.name", stringValue="svc")]}, "scopeSpans": [{"spans": [span("t1", "b", "a", 2000, 2), span("t1", "a", "", 1000, x={"intValue": "7"}, y={"arrayValue": {"values": [{"boolValue": True}]}}), span("", "z", "", 1), span("t2", "c", "gone", 5000)]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(doc).replace("t1", "u1").replace("t2", "u2") + "\n{broken\n")
    rows = span_source.read_otlp(spark, str(tmp_path))
    got = rows.collect()
    assert sorted((r.trace_id, r.span_id) for r in got) == sorted([("t1", "a"), ("t1", "b"), ("t2", "c"), ("u1", "a"), ("u1", "b"), ("u2", "c")])
    a = next(r for r in got if (r.trace_id, r.span_id) == ("t1", "a"))
    assert a.attributes == {"x": "7", "y": "[true]"} and a.resource == {"service.name": "svc"} and not a.errored
    assert {(r.trace_id, r.span_id) for r in span_source.roots(rows, "start_nanos", "span_id").collect()} == {("t1", "a"), ("t2", "c"), ("u1", "a"), ("u2", "c")}


def test_indexed_attributes_and_tool_names(spark):
    m = {f"llm.input_messages.{i}.message.role": f"r{i}" for i in range(12)} | {"llm.input_messages.2.message.content": "c"}
    df = spark.createDataFrame([("t", "s", m)], "trace_id string, span_id string, attributes map<string,string>")
    items = span_source.indexed(df, "llm.input_messages").first()["items"]
    assert [x["message.role"] for x in items] == [f"r{i}" for i in range(12)] and items[2]["message.content"] == "c"
    assert tuple(one(spark, *[span_source.safe_tool_name(F.lit(x)) for x in ("a b/c", "9x", "ok.é")])) == ("a_b_c", "_9x", "ok_é")


def test_run_tree(spark, tmp_path):
    runs = [{"id": "1", "run_type": "chain", "start_time": "2024-01-01T00:00:00Z", "feedback": [{"score": 0}]}, {"id": "2", "trace_id": "1", "parent_run_id": "1", "run_type": "tool", "start_time": "2024-01-01T00:00:01", "error": "boom", "feedback": [{"value": "thumbs_down"}]}, {"id": "3", "feedback": [{"score": 1}, {"score": None, "value": "good"}]}, {"run_type": "llm"}]
    (tmp_path / "a.json").write_text(json.dumps(runs))
    rows = span_source.read_runs(spark, str(tmp_path)).withColumn("bad", span_source.negative(F.col("feedback"))).collect()
    assert {(r.trace_id, r.span_id, r.parent_id, r.bad) for r in rows} == {("1", "1", None, True), ("1", "2", "1", True), ("3", "3", None, False)}


def test_result_import(spark, tmp_path):
    case = lambda i, **k: {"testCase": {"description": i, "metadata": {"test_id": i}}, **k}
    doc = {"results": {"results": [case("a", success=True, latencyMs=5, response={"output": {"b": 1}}), case("a", success=False, failureReason=1, gradingResult={"pass": False, "reason": "r", "componentResults": [{"pass": False, "reason": " x "}, {"pass": True, "reason": "y"}]}), case("a", success=False, failureReason=2, error="Request timed out"), case("b", success=False, failureReason=99), case("", success=True), case("b", success=False, failureReason=1, gradingResult={"pass": False, "reason": "r"})]}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    got = {(r.test_id, r.repetition): (r.outcome, r.error_kind, r.failed_assertions) for r in result_source.read_results(spark, str(tmp_path / "r.json"), "run").collect()}
    assert got == {("a", 0): ("pass", None, []), ("a", 1): ("fail", None, ["x"]), ("a", 2): ("error", "timeout", []), ("b", 0): ("error", "execution_error", []), ("b", 1): ("fail", None, ["r"])}


def test_store_merges_are_idempotent(spark):
    new = spark.createDataFrame([("a", "h1", 1), ("b", "h1", 2), ("c", "h2", 3), ("c", "h2", 4), ("c", "h3", 5)], "trace_id string, content_hash string, line int")
    none = new.where("false").drop("line")
    first = {(r.line, r.result, r.canonical_id) for r in store.classify(new, none).collect()}
    assert first == {(1, "stored", "a"), (2, "content_duplicate", "a"), (3, "stored", "c"), (4, "already_stored", "c"), (5, "id_conflict", None)}
    kept = store.add_traces(none, new)
    again = store.add_traces(kept, new)
    assert sorted(kept.collect()) == sorted(again.collect()) == [("a", "h1"), ("c", "h2")]
    up = store.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, created int, v string"), spark.createDataFrame([("a", 9, "z"), ("c", 9, "w")], "k string, created int, v string"), "k", keep=("created",))
    assert sorted(map(tuple, up.collect())) == [("a", 1, "z"), ("b", 1, "y"), ("c", 9, "w")]
    runs = spark.createDataFrame([("ab",), ("abc",), ("b",)], "k string")
    assert store.by_prefix(runs, "k", "ab").first().k == "ab" and store.by_prefix(runs, "k", "abc").first().k == "abc"
    with pytest.raises(LookupError):
        store.by_prefix(runs, "k", "a")
    parent, child = store.delete_with_children(runs, runs.where("k = 'b'"), "k", runs)
    assert parent.count() == child.count() == 2


def test_reviews(spark):
    drafts = spark.createDataFrame([("t1", "draft", False, None, None), ("t2", "draft", True, None, None), ("t3", "draft", False, None, None)], "test_id string, status string, blocking boolean, reviewer string, reason string")
    marks = spark.createDataFrame([("t1", "rejected", 1, "r", "x"), ("t1", "approved", 2, "r", "y"), ("t2", "approved", 1, "r", None)], "test_id string, decision string, reviewed_at int, reviewer string, reason string")
    assert {r.test_id: r.status for r in store.apply_reviews(drafts, marks).collect()} == {"t1": "approved", "t2": "draft", "t3": "draft"}


def test_embedding_distances():
    a, b = families.hashed_vector("wrong_tool_argument in tools: refunded the wrong order"), families.hashed_vector("wrong_tool_argument in tools: refunded a wrong order")
    c = families.hashed_vector("hallucination in planner: invented a policy")
    assert math.isclose(np.dot(a, a), 1) and np.dot(a, b) > np.dot(a, c)
    assert families.hashed_vector("") == [0.0] * 512


def naive_linkage(x, t):
    groups = [[k] for k in range(len(x))]
    d = np.clip(1 - x @ x.T, 0, 2)
    while len(groups) > 1:
        best = min(((d[np.ix_(g, h)].mean(), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j))
        if not best[0] < t:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


def test_average_linkage_is_exact():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 40):
        for t in (0.2, 0.5, 0.9):
            x = rng.normal(size=(n, 4))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            assert sorted(linkage.average_linkage(x, t)) == naive_linkage(x, t)


def test_clusters_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(("described", "undescribed")[k % 2], f"f{k:03d}", x[k].tolist()) for k in range(60)]
    got = families.cluster(spark.createDataFrame(rows, "population string, failure_id string, vector array<double>"), {"described": 0.2, "undescribed": 0.1}).collect()
    for p, t in (("described", 0.2), ("undescribed", 0.1)):
        own = [r for r in rows if r[0] == p]
        want = {tuple(own[k][1] for k in g) for g in naive_linkage(np.array([r[2] for r in own]), t)}
        mine: dict = {}
        for r in got:
            if r.population == p:
                mine.setdefault(r.cluster_id, []).append(r.failure_id)
        assert {tuple(sorted(v)) for v in mine.values()} == want


E = lambda kind, tool=None, path=None, value=None: (kind, tool, path, value)


@pytest.mark.parametrize(
    "a,b,bad",
    [
        (E("tool_called", "t"), E("tool_not_called", "t"), True),
        (E("tool_not_called", "t"), E("tool_argument_equals", "t", "p", "1"), True),
        (E("tool_called", "t"), E("max_tool_calls", None, None, "0"), True),
        (E("tool_argument_equals", "t", "p", "1"), E("tool_argument_not_equals", "t", "p", "1"), True),
        (E("tool_argument_equals", "t", "p", "1"), E("tool_argument_equals", "t", "p", '"1"'), True),
        (E("output_contains", value='"x"'), E("output_not_contains", value='"x"'), True),
        (E("max_tool_calls", "t", None, "1"), E("max_tool_calls", "t", None, "2"), True),
        (E("tool_called", "t"), E("tool_not_called", "u"), False),
        (E("max_tool_calls", "t", None, "1"), E("max_tool_calls", None, None, "2"), False),
    ],
)
def test_contradictions(spark, a, b, bad):
    df = spark.createDataFrame([([a, b],), ([b, a],)], f"es array<{expectations.EXPECTATION}>")
    assert [len(r[0]) for r in df.select(expectations.contradictions(F.col("es"))).collect()] == [int(bad)] * 2


def test_validation_and_evaluation(spark):
    bad = [E("tool_called"), E("tool_argument_equals", "t"), E("max_tool_calls", value='"x"'), E("max_tool_calls", value="-1"), E("output_contains", value='" "'), E("output_matches", value="3"), E("human_rubric")]
    good = [E("tool_called", "t"), E("max_tool_calls", value="0"), E("output_contains", value='"a"')]
    df = spark.createDataFrame([(e,) for e in bad + good], f"e {expectations.EXPECTATION}")
    assert [r[0] is not None for r in df.select(expectations.invalid(F.col("e"))).collect()] == [True] * len(bad) + [False] * len(good)
    cases = [(E("output_contains", value='"or"'), "pass"), (E("output_matches", value='"^w.r"'), "pass"), (E("output_not_contains", value='"W"'), "pass"), (E("tool_argument_equals", "t", "a.b", "1"), "pass"), (E("tool_argument_not_equals", "t", "a.b", "2"), "pass"), (E("tool_argument_equals", "t", "zz", "1"), "fail"), (E("max_tool_calls", None, None, "1"), "fail"), (E("human_rubric", value='"x"'), "error")]
    df = spark.createDataFrame([(e, "words", [("t", '{"a":{"b":1}}'), ("u", "{}")]) for e, _ in cases], f"e {expectations.EXPECTATION}, out string, calls array<struct<tool:string,arguments:string>>")
    assert [r[0] for r in df.select(expectations.evaluate(F.col("e"), F.col("out"), F.col("calls"))).collect()] == [w for _, w in cases]


def test_derivation(spark):
    calls = [("look", '{"id":"7"}'), ("pay", '{"to":{"iban":"x"},"why":"' + "long words " * 12 + '","n":null,"l":[1]}')]
    rows = [("wrong_tool_argument", calls), (None, calls), ("wrong_tool_selection", calls), ("unnecessary_action", calls + [("look", "{}")]), ("hallucination", calls), ("wrong_tool_argument", [])]
    df = spark.createDataFrame([(k, "s", None, c) for k, c in rows], "failure_type string, summary string, evidence string, calls array<struct<tool:string,arguments:string>>")
    df = df.withColumn("flat", expectations.flatten_json(F.try_element_at("calls", F.lit(-1))["arguments"]))
    got = [[(e.type, e.tool, e.path, e.value) for e in r.expectations] for r in expectations.derive(df).collect()]
    args = [("tool_argument_not_equals", "pay", "to.iban", '"x"'), ("tool_argument_not_equals", "pay", "n", "null")]
    assert got[0] == got[1] == args
    assert got[2] == [("tool_not_called", "pay", None, None)] and got[3] == [("max_tool_calls", "look", None, "1")]
    assert [e[0] for e in got[4] + got[5]] == ["human_rubric"] * 2
