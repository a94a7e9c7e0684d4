"""Every registered query of the engine, with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import identity, redaction, statistics
from tracewright.operators import comparison, evidence, expectations, families, ingest, linkage, store, validate
from tracewright.plans.views import doc_traces, results, spans, table
from tracewright.sources import traces
from tracewright.sources.spans import assemble, bag_difference, roots, safe_tool_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- views in SQL ------------------------------------------------------------------------------

DOCS = """docs AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS trace_id, d.text, d.source, d.lang, l.quality, l.toxic,
         CASE WHEN quality = 0 AND toxic = 1 THEN 'error' WHEN quality = 0 THEN 'failure' ELSE 'unknown' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
SIGNALS = (
    DOCS
    + """, raw AS (
  SELECT trace_id, 1 AS o, 'explicit_status' AS kind, 'outcome.status' AS source,
         CASE status WHEN 'failure' THEN 'the trace is explicitly marked as failed' ELSE 'the trace is explicitly marked as errored' END AS summary
  FROM docs WHERE status IN ('failure', 'error')
  UNION ALL SELECT trace_id, 2, 'negative_feedback', 'outcome.feedback', 'feedback was rated negative' FROM docs WHERE toxic = 1
  UNION ALL SELECT trace_id, 3, 'failed_evaluator', 'outcome.evaluations.0', 'evaluator ''quality'' reported a failure' FROM docs WHERE quality = 0),
signals AS (SELECT 'fail-' || left(sha256(trace_id), 12) AS failure_id, trace_id,
  row_number() OVER (PARTITION BY trace_id ORDER BY o) - 1 AS position, kind, source, summary, o FROM raw)"""
)
SPANS = """spans AS (
  SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, 's' || event_id AS span_id, event_id, ts,
         event_type AS tool, CAST(props->>'$.k' AS INT) AS k, event_type = 'error' AS errored, user_id, value, props
  FROM events)"""
RESULTS = (
    SPANS
    + """, results AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, test_id ORDER BY ts, event_id) - 1 AS repetition FROM (
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline' ELSE 'candidate' END AS run_id, 'u' || user_id || '-' || (k % 10) AS test_id,
           CASE tool WHEN 'error' THEN 'error' WHEN 'view' THEN 'fail' ELSE 'pass' END AS outcome, ts, event_id, value AS latency FROM spans))"""
)
CASES = (
    RESULTS
    + """, cases AS (
  SELECT *, passed + failed AS evaluated, CASE WHEN passed + failed > 0 THEN passed / (passed + failed) END AS pass_rate,
    CASE WHEN passed + failed = 0 THEN 'error' WHEN failed = 0 THEN 'pass' WHEN passed = 0 THEN 'fail' ELSE 'flaky' END AS verdict FROM (
    SELECT run_id, test_id, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed,
           count(*) FILTER (outcome = 'error') AS errored, count(*) AS repetitions FROM results GROUP BY ALL))"""
)
_Z = "1.959963984540054"
_LOW = f"(({{p}}/{{n}} + {_Z}*{_Z}/(2*{{n}})) - {_Z}*sqrt(({{p}}/{{n}})*(1-{{p}}/{{n}})/{{n}} + {_Z}*{_Z}/(4.0*{{n}}*{{n}}))) / (1 + {_Z}*{_Z}/{{n}})"
_HIGH = _LOW.replace("2*{n})) - ", "2*{n})) + ")
_MOSTLY = _LOW.format(p="c.passed", n="c.evaluated") + " > 0.5"
COMPARED = (
    CASES
    + f""", compared AS (
  SELECT coalesce(b.test_id, c.test_id) AS test_id, b.verdict AS b_verdict, c.verdict AS c_verdict, b.passed AS b_passed, c.passed AS c_passed,
    b.evaluated AS b_evaluated, c.evaluated AS c_evaluated,
    coalesce(b.verdict = 'flaky', false) OR coalesce(c.verdict = 'flaky', false) AS flaky,
    CASE WHEN b.verdict IS NULL OR c.verdict IS NULL THEN 'missing'
         WHEN b.verdict = 'error' OR c.verdict = 'error' THEN 'not_comparable'
         WHEN c.verdict = 'pass' THEN CASE WHEN b.verdict = 'pass' THEN 'unchanged_pass' ELSE 'fixed' END
         WHEN c.verdict = 'fail' THEN CASE WHEN b.verdict = 'fail' THEN 'unchanged_failure' ELSE 'regression' END
         WHEN b.verdict = 'pass' THEN 'regression'
         WHEN b.verdict = 'fail' OR c.pass_rate > b.pass_rate THEN CASE WHEN {_MOSTLY} THEN 'likely_fixed' ELSE 'unchanged_failure' END
         WHEN c.pass_rate < b.pass_rate THEN 'regression' ELSE 'unchanged_failure' END AS classification
  FROM (SELECT * FROM cases WHERE run_id = 'baseline') b FULL JOIN (SELECT * FROM cases WHERE run_id = 'candidate') c USING (test_id))"""
)
_COMPARABLE = "('fixed','likely_fixed','regression','unchanged_failure','unchanged_pass')"
MEMBERS = """members AS (
  SELECT 'v' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS failure_id, 'c' || label AS cluster_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS vector,
         CASE vec_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE NULL END AS severity, vec_id FROM embeddings),
cells AS (SELECT cluster_id, unnest(range(1, 65)) AS pos, vector FROM members),
centre AS (SELECT cluster_id, pos, avg(vector[pos]) AS x FROM cells GROUP BY ALL),
norm AS (SELECT cluster_id, sqrt(sum(x * x)) AS n FROM centre GROUP BY ALL),
placed AS (SELECT failure_id, m.cluster_id, severity, greatest(0, least(2, 1 - d)) AS distance FROM (
  SELECT m.failure_id, m.cluster_id, m.severity, sum(m.vector[c.pos] * c.x / n.n) AS d FROM members m JOIN centre c USING (cluster_id) JOIN norm n USING (cluster_id) GROUP BY ALL) m)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- detection --------------------------------------------------------------------------------


@query(f"WITH {SIGNALS} SELECT failure_id, trace_id, position, kind, source, summary FROM signals")
def detect_signals(spark, d):
    return evidence.signals(doc_traces(spark, d)).select("failure_id", "trace_id", "position", "kind", "source", "summary")


@query(f"WITH {SIGNALS} SELECT kind, count(*) AS n FROM signals GROUP BY kind")
def signal_kind_counts(spark, d):
    return evidence.signals(doc_traces(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIGNALS} SELECT failure_id, trace_id, count(*) AS n_signals, string_agg(kind, ',' ORDER BY o) AS kinds FROM signals GROUP BY ALL")
def failures_one_per_trace(spark, d):
    return evidence.failures(doc_traces(spark, d)).select("failure_id", "trace_id", F.size("signals").cast("long").alias("n_signals"), F.array_join("kinds", ",").alias("kinds"))


def _stored(spark, d):
    """An earlier snapshot: even documents, every tenth of them reviewed, and one of ten without evidence now."""
    found = evidence.failures(doc_traces(spark, d).where("doc_id % 2 = 0"))
    found = found.withColumn("status", F.when(F.pmod(F.regexp_extract("trace_id", "([0-9]+)", 1).cast("long"), F.lit(10)) == 0, "confirmed").otherwise("candidate"))
    extra = doc_traces(spark, d).where("doc_id % 10 in (0, 2) and status = 'unknown' and rating is null")
    gone = extra.select(
        identity.failure_id(F.col("trace_id")).alias("failure_id"), "trace_id", F.when(F.col("doc_id") % 10 == 0, "confirmed").otherwise("candidate").alias("status"),
        F.lit("detector").alias("origin"), F.array().cast(f"array<{evidence.SIGNAL}>").alias("signals"),
    )
    return found.drop("kinds").unionByName(gone)


@query(
    f"""WITH {SIGNALS}, found AS (SELECT DISTINCT failure_id, trace_id, CAST(substr(trace_id, 5) AS BIGINT) AS doc_id FROM signals),
    stored AS (SELECT failure_id, doc_id % 10 = 0 AS reviewed, true AS live FROM found WHERE doc_id % 2 = 0
      UNION ALL SELECT 'fail-' || left(sha256(trace_id), 12), doc_id % 10 = 0, false FROM docs WHERE doc_id % 10 IN (0, 2) AND status = 'unknown' AND toxic IS DISTINCT FROM 1)
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN s.failure_id IS NULL THEN 'created' WHEN f.failure_id IS NULL THEN CASE WHEN reviewed THEN 'preserved' ELSE 'withdrawn' END ELSE 'unchanged' END AS action
      FROM found f FULL JOIN stored s USING (failure_id)) GROUP BY action"""
)
def failure_upsert_plan(spark, d):
    merged = store.merge_failures(_stored(spark, d), evidence.failures(doc_traces(spark, d)).drop("kinds"))
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {DOCS} SELECT 'fail-' || left(sha256(trace_id), 12) AS failure_id FROM docs WHERE doc_id % 10 = 2 AND status = 'unknown' AND toxic IS DISTINCT FROM 1"
)
def failure_withdrawal(spark, d):
    return store.merge_failures(_stored(spark, d), evidence.failures(doc_traces(spark, d)).drop("kinds")).where("action = 'withdrawn'").select("failure_id")


@query(f"WITH {DOCS} SELECT status, count(*) AS n FROM docs GROUP BY status")
def status_counts(spark, d):
    return doc_traces(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SIGNALS}, f AS (SELECT DISTINCT failure_id, trace_id FROM signals) SELECT failure_id, trace_id FROM f ORDER BY failure_id LIMIT 50 OFFSET 10")
def failures_page(spark, d):
    return store.page(evidence.failures(doc_traces(spark, d)).select("failure_id", "trace_id"), ("failure_id",), offset=10)


@query(
    f"""WITH {SIGNALS}, f AS (SELECT DISTINCT failure_id, trace_id, CAST(substr(trace_id, 5) AS BIGINT) AS doc_id FROM signals)
    SELECT failure_id, trace_id, CASE WHEN doc_id % 3 = 0 THEN 'other' END AS failure_type, CASE WHEN doc_id % 3 = 0 THEN 'medium' END AS severity FROM f"""
)
def failures_left_join_analyses(spark, d):
    found = evidence.failures(doc_traces(spark, d)).select("failure_id", "trace_id")
    done = found.where(F.regexp_extract("trace_id", "([0-9]+)", 1).cast("long") % 3 == 0).select("failure_id", F.lit("other").alias("failure_type"), F.lit("medium").alias("severity"))
    return found.join(done, "failure_id", "left")


@query(f"WITH {SIGNALS} SELECT failure_id, '[stub] ' || string_agg(summary, '; ' ORDER BY position) AS summary FROM signals GROUP BY failure_id")
def stub_analysis(spark, d):
    """The offline analyser: all evidence in one line."""
    found = evidence.failures(doc_traces(spark, d))
    return found.select("failure_id", F.concat(F.lit("[stub] "), F.array_join(F.transform("signals", lambda s: s["summary"]), "; ")).alias("summary"))


# --- identity, dedupe, sightings -----------------------------------------------------------------

_HASH = "'sha256:' || sha256(source || '|' || text)"


def _hashed(spark, d):
    return doc_traces(spark, d).withColumn("content_hash", identity.content_hash(F.concat_ws("|", "source", "input_text")))


@query(f"WITH {DOCS}, h AS (SELECT trace_id, {_HASH} AS content_hash FROM docs) SELECT content_hash, min(trace_id) AS canonical_id, count(*) AS n FROM h GROUP BY content_hash")
def canonical_min_trace(spark, d):
    return _hashed(spark, d).groupBy("content_hash").agg(F.min("trace_id").alias("canonical_id"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DOCS}, h AS (SELECT doc_id, trace_id, {_HASH} AS content_hash FROM docs) SELECT trace_id, content_hash FROM h QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1")
def content_hash_dedupe(spark, d):
    first = Window.partitionBy("content_hash").orderBy("doc_id")
    return _hashed(spark, d).withColumn("n", F.row_number().over(first)).where("n = 1").select("trace_id", "content_hash")


@query(
    f"""WITH {DOCS}, h AS (SELECT doc_id, trace_id, sha256(text) AS content_hash FROM docs),
    stored AS (SELECT trace_id, CASE WHEN doc_id % 14 = 0 THEN 'other' ELSE content_hash END AS content_hash FROM h WHERE doc_id % 7 = 0),
    known AS (SELECT content_hash, min(trace_id) AS known_id FROM stored GROUP BY ALL),
    x AS (SELECT h.*, s.content_hash AS known_hash, k.known_id, first_value(CASE WHEN s.trace_id IS NULL THEN h.trace_id END) OVER (
            PARTITION BY h.content_hash ORDER BY CASE WHEN s.trace_id IS NULL THEN 0 ELSE 1 END, doc_id) AS owner
          FROM h LEFT JOIN stored s USING (trace_id) LEFT JOIN known k ON k.content_hash = h.content_hash)
    SELECT trace_id, CASE WHEN known_hash = content_hash THEN 'already_stored' WHEN known_hash IS NOT NULL THEN 'id_conflict'
      WHEN known_id IS NOT NULL OR owner <> trace_id THEN 'content_duplicate' ELSE 'stored' END AS result FROM x"""
)
def ingest_classification(spark, d):
    rows = doc_traces(spark, d).select("trace_id", F.sha2(F.col("input_text").cast("binary"), 256).alias("content_hash"), F.col("doc_id").alias("line"))
    known = rows.where("line % 7 = 0").select("trace_id", F.when(F.col("line") % 14 == 0, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return store.classify(rows, known).select("trace_id", "result")


@query(
    f"""WITH {SPANS} SELECT 'u' || user_id AS canonical_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, array_to_string(list_sort(list(DISTINCT tool)), ',') AS agents FROM spans GROUP BY user_id"""
)
def occurrence_stats(spark, d):
    rows = spans(spark, d).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("canonical_id"), F.lit(None).cast("timestamp_ntz").alias("recorded_at"), F.col("ts").alias("ingested_at"), F.col("tool").alias("agent"))
    return store.occurrence_stats(rows).withColumn("agents", F.array_join("agents", ","))


@query(
    f"""WITH {DOCS} SELECT trace_id, left(sha256(concat_ws(chr(10), 'h', trace_id, '', source)), 24) AS occurrence_id FROM docs"""
)
def occurrence_ids(spark, d):
    return doc_traces(spark, d).select("trace_id", identity.occurrence_id(F.lit("h"), F.col("trace_id"), F.lit(None).cast("string"), F.col("source")).alias("occurrence_id"))


@query(
    f"""WITH {DOCS}, s AS (SELECT trace_id, trim(left(array_to_string(regexp_extract_all(lower(regexp_replace(text, '\\[REDACTED:[^\\]]*\\]', ' ', 'g')), '[a-z0-9]+')[1:6], '_'), 48), '_') AS stem FROM docs)
    SELECT trace_id, CASE WHEN stem = '' THEN 'test' ELSE stem END || '_' || left(sha256(trace_id), 8) AS test_id FROM s"""
)
def test_id_slug(spark, d):
    return doc_traces(spark, d).select("trace_id", identity.test_id(F.col("trace_id"), F.col("input_text")).alias("test_id"))


@query("SELECT label, 'cl-' || left(sha256(string_agg('v' || vec_id, chr(10) ORDER BY 'v' || vec_id)), 12) AS cluster_id FROM embeddings GROUP BY label")
def cluster_id_by_label(spark, d):
    ids = F.collect_list(F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    return table(spark, d, "embeddings").groupBy("label").agg(identity.cluster_id(ids).alias("cluster_id"))


@query(f"WITH {CASES} SELECT run_id, 'sha256:' || left(sha256(string_agg(test_id, chr(10) ORDER BY test_id)), 16) AS suite_hash FROM cases GROUP BY run_id")
def suite_hash_by_run(spark, d):
    return comparison.summaries(results(spark, d)).groupBy("run_id").agg(identity.suite_hash(F.collect_list("test_id")).alias("suite_hash"))


# --- redaction -----------------------------------------------------------------------------------

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL}', '[REDACTED:email]', 'g')) AS redacted, len(regexp_extract_all(text, '{_EMAIL}')) AS n FROM documents")
def redact_emails(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(F.regexp_replace("text", redaction.EMAIL, redaction.placeholder("email")).cast("binary"), 256).alias("redacted"), F.regexp_count("text", F.lit(redaction.EMAIL)).cast("long").alias("n"))


_LUHN = "(SELECT sum(CASE WHEN i % 2 = 0 THEN v ELSE CASE WHEN 2*v > 9 THEN 2*v - 9 ELSE 2*v END END) FROM (SELECT i, CAST(substr(reverse(c), i + 1, 1) AS INT) AS v FROM range(len(c)) t(i)))"


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest([y FOR y IN regexp_extract_all(text, '[0-9]+') IF len(y) BETWEEN 13 AND 19]) AS c FROM documents) WHERE {_LUHN} % 10 = 0 GROUP BY doc_id")
def cards_by_luhn(spark, d):
    """Documents with unbroken digit runs that are card numbers."""
    runs = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<!\d)\d{13,19}(?!\d)"), F.lit(0))).alias("c"))
    return runs.where(F.expr("luhn_check(c)")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def redact_all_rules(spark, d):
    """Every rule over every document: digest of the redacted text and the count by rule."""
    out = redaction.redact_frame(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("redacted"), *[f"n_{k}" for k in redaction.TEXT_RULES])


@query(f"SELECT count(*) FILTER (regexp_matches(text, '{_EMAIL}')) AS with_email, sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS emails, count(*) AS documents FROM documents")
def redaction_rule_counts(spark, d):
    n = F.regexp_count("text", F.lit(redaction.EMAIL))
    return table(spark, d, "documents").agg(F.count_if(n > 0).alias("with_email"), F.sum(n).alias("emails"), F.count(F.lit(1)).alias("documents"))


# --- events and spans ------------------------------------------------------------------------------


def _event_rows(spark, d):
    order = Window.partitionBy("trace_id").orderBy("event_id")
    return spans(spark, d).withColumn("position", F.row_number().over(order) - 1)


@query(f"WITH {SPANS} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) - 1 AS position, span_id, tool FROM spans")
def trace_event_index(spark, d):
    return _event_rows(spark, d).select("trace_id", "position", "span_id", "tool")


@query(
    f"""WITH {SPANS}, e AS (SELECT trace_id, k, tool, value, row_number() OVER (PARTITION BY trace_id ORDER BY event_id) - 1 AS position FROM spans),
    r AS (SELECT *, CASE WHEN tool IN ('click', 'purchase') THEN 'tool_result' ELSE 'tool_call' END AS type, 'c' || k AS call_id, 'e' || k AS event_key FROM e),
    w AS (SELECT *, row_number() OVER (PARTITION BY trace_id, event_key ORDER BY position) AS ne, row_number() OVER (PARTITION BY trace_id, type, call_id ORDER BY position) AS nc,
      max(CASE WHEN type = 'tool_call' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, call_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS called,
      max(value) OVER (PARTITION BY trace_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r)
    SELECT trace_id, position, 'duplicate_event_id' AS rule FROM w WHERE ne > 1
    UNION ALL SELECT trace_id, position, 'timestamp_backwards' FROM w WHERE value < top
    UNION ALL SELECT trace_id, position, 'duplicate_call_id' FROM w WHERE type = 'tool_call' AND nc > 1
    UNION ALL SELECT trace_id, position, 'result_before_call' FROM w WHERE type = 'tool_result' AND coalesce(called, 0) = 0"""
)
def event_order_violations(spark, d):
    """All four sequence rules; the value column stands in for time so that every rule strikes."""
    rows = _event_rows(spark, d).select(
        "trace_id", "position", F.concat(F.lit("e"), F.col("k").cast("string")).alias("event_id"),
        F.when(F.col("tool").isin("click", "purchase"), "tool_result").otherwise("tool_call").alias("type"),
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("call_id"), F.col("value").alias("timestamp"),
    )
    return validate.violations(rows)


@query(f"WITH {SPANS} SELECT trace_id, count(*) AS n_spans, CASE WHEN bool_or(errored) THEN 'error' ELSE 'unknown' END AS status, string_agg(span_id, ',' ORDER BY ts, span_id) AS spans FROM spans GROUP BY trace_id")
def span_grouping(spark, d):
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "span_id"))), lambda x: x["span_id"]), ",")
    return spans(spark, d).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"), F.when(F.max("errored"), "error").otherwise("unknown").alias("status"), own.alias("spans"))


@query(
    f"""WITH {SPANS}, p AS (SELECT *, 's' || (event_id - k % 5) AS parent_id FROM spans)
    SELECT p.trace_id, p.span_id AS root FROM p LEFT JOIN (SELECT DISTINCT trace_id, span_id AS parent_id, true AS known FROM spans) s USING (trace_id, parent_id)
    QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY coalesce(known, false), ts, span_id) = 1"""
)
def span_root(spark, d):
    rows = spans(spark, d).withColumn("parent_id", F.concat(F.lit("s"), (F.col("event_id") - F.col("k") % 5).cast("string")))
    return roots(rows, "ts", "span_id").select("trace_id", F.col("span_id").alias("root"))


@query(f"WITH {SPANS} SELECT trace_id, coalesce(arg_min(tool, (ts, span_id)) FILTER (tool <> 'view'), 'none') AS first_input FROM spans GROUP BY trace_id")
def span_first_input(spark, d):
    pick = F.min_by("tool", F.when(F.col("tool") != "view", F.struct("ts", "span_id")))
    return spans(spark, d).groupBy("trace_id").agg(F.coalesce(F.when(F.max(F.col("tool") != "view"), pick), F.lit("none")).alias("first_input"))


@query(
    f"""WITH {SPANS} SELECT trace_id, tool, k, count(*) AS n FROM (
      SELECT trace_id, tool, k FROM spans WHERE event_id % 3 > 0 EXCEPT ALL SELECT trace_id, tool, k FROM spans WHERE event_id % 3 = 0) GROUP BY ALL"""
)
def intent_execution_bag_difference(spark, d):
    rows = spans(spark, d).withColumn("position", F.col("event_id"))
    left = bag_difference(rows.where("event_id % 3 > 0"), rows.where("event_id % 3 = 0"), "trace_id", "tool", "k")
    return left.groupBy("trace_id", "tool", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH n AS (SELECT page_id, unnest([url, '9' || url, '__' || page_id, '--', ' Größe ' || url]) AS name, unnest(range(5)) AS k FROM pages),
    p AS (SELECT page_id, k, trim(regexp_replace(trim(name), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS plain FROM n),
    t AS (SELECT page_id, k, CASE WHEN plain = '' THEN 'tool' ELSE plain END AS named FROM p)
    SELECT page_id, k, left(CASE WHEN regexp_matches(named, '^\\p{L}') THEN named ELSE '_' || named END, 128) AS tool FROM t"""
)
def tool_name_coercion(spark, d):
    own = F.col("page_id").cast("string")
    names = F.array("url", F.concat(F.lit("9"), "url"), F.concat(F.lit("__"), own), F.lit("--"), F.concat(F.lit(" Größe "), "url"))
    rows = table(spark, d, "pages").select("page_id", F.posexplode(names).alias("k", "name"))
    return rows.select("page_id", F.col("k").cast("long").alias("k"), safe_tool_name(F.col("name")).alias("tool"))


def _attributed(spark, d):
    """Spans with attributes: an event is a message, a declared call or an executed one, by its type."""
    e = table(spark, d, "events")
    own, k = F.col("event_id").cast("string"), F.get_json_object("props", "$.k")
    tool = F.create_map(F.lit("openinference.span.kind"), F.lit("TOOL"), F.lit("tool.name"), F.concat(F.lit("t"), (k.cast("int") % 3).cast("string")), F.lit("tool.parameters"), F.lit('{"a": 1}'), F.lit("output.value"), k)
    asks = F.create_map(
        F.lit("llm.input_messages.10.message.role"), F.lit("assistant"), F.lit("llm.input_messages.10.message.content"), F.concat(F.lit("later "), own),
        F.lit("llm.input_messages.9.message.role"), F.lit("user"), F.lit("llm.input_messages.9.message.content"), F.concat(F.lit("said "), own),
        F.lit("llm.output_messages.0.message.tool_calls.0.tool_call.function.name"), F.concat(F.lit("t"), (k.cast("int") % 3).cast("string")),
        F.lit("llm.output_messages.0.message.tool_calls.0.tool_call.function.arguments"), F.lit('{"a":1}'),
    )
    plain = F.create_map(F.lit("input.value"), F.concat(F.lit("value "), own))
    listed = F.create_map(F.lit("gen_ai.input.messages"), F.concat(F.lit('[{"role":"user","parts":[{"text":"part "},{"text":"'), own, F.lit('"}]},{"role":"user","content":""}]')))
    kind = F.col("event_type")
    attributes = F.when(kind.isin("click", "purchase"), tool).when(kind == "view", asks).when(kind == "signup", listed).otherwise(plain)
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), F.lpad(own, 12, "0").alias("span_id"), F.lit(None).cast("string").alias("parent_id"),
        kind.alias("name"), F.col("ts").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("ended"), F.col("event_id").cast("long").alias("start_nanos"), attributes.alias("attributes"),
        F.create_map(F.lit("service.name"), F.lit("svc")).alias("resource"), (kind == "error").alias("errored"), F.lit(None).cast("string").alias("message"),
    )


_ATTRIBUTED = """e AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id, event_type AS kind, CAST(props->>'$.k' AS INT) AS k FROM events)"""


@query(
    f"""WITH {_ATTRIBUTED}, f AS (SELECT trace_id, arg_min(event_id, event_id) AS root FROM e GROUP BY ALL),
    a AS (SELECT e.trace_id, event_id, kind FROM e JOIN f USING (trace_id) WHERE kind NOT IN ('click', 'purchase')
          QUALIFY row_number() OVER (PARTITION BY e.trace_id ORDER BY event_id) = 1)
    SELECT f.trace_id, CASE WHEN a.kind IN ('view', 'signup') THEN NULL WHEN a.event_id IS NULL THEN (SELECT any_value(kind) FROM e WHERE e.event_id = f.root) ELSE 'value ' || a.event_id END AS input_text,
      CASE a.kind WHEN 'view' THEN 'user:said ' || a.event_id || '|assistant:later ' || a.event_id WHEN 'signup' THEN 'user:part ' || a.event_id ELSE '' END AS messages
    FROM f LEFT JOIN a USING (trace_id)"""
)
def span_messages(spark, d):
    """Inputs of assembled traces, from the first span that says something."""
    rows = assemble(_attributed(spark, d))
    return rows.select("trace_id", "input_text", F.array_join(F.transform("input_messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


@query(
    f"""WITH {_ATTRIBUTED}, d AS (SELECT trace_id, 't' || (k % 3) AS tool, count(*) FILTER (kind = 'view') AS asked, count(*) FILTER (kind IN ('click', 'purchase')) AS done FROM e GROUP BY ALL)
    SELECT trace_id, CAST(coalesce(sum(greatest(asked - done, 0)), 0) AS BIGINT) AS undone, CAST(sum(done) AS BIGINT) AS executed FROM d GROUP BY trace_id"""
)
def span_undone_calls(spark, d):
    """Calls that were declared and never run, one for one, beside those that were."""
    rows = assemble(_attributed(spark, d)).select("trace_id", F.filter("events", lambda x: x["type"] == "tool_call").alias("calls"))
    return rows.select("trace_id", F.size(F.filter("calls", lambda x: x["call_id"].isNull())).cast("long").alias("undone"), F.size(F.filter("calls", lambda x: x["call_id"].isNotNull())).cast("long").alias("executed"))


def _recorded(spark, d):
    """A trace's JSON for each user and day: tool calls with their arguments, and results."""
    e = table(spark, d, "events")
    body = lambda type_, **more: F.struct(F.lit(type_).alias("type"), F.concat(F.col("event_id").cast("string"), F.lit(type_)).alias("event_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id"), F.col("event_type").alias("tool"), *[v.alias(k) for k, v in more.items()])
    call = F.to_json(body("tool_call", arguments=F.try_parse_json("props")))
    result = F.to_json(body("tool_result", result=F.floor("value")))
    own = F.when(F.col("event_type").isin("click", "purchase"), F.concat(call, F.lit(","), result)).otherwise(call)
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), "event_id", own.alias("own"))
    events = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "own"))), lambda x: x["own"]), ",")
    text = F.concat(F.lit('{"trace_id":"'), F.col("trace_id"), F.lit('","input":{"text":"one\\u001erequest"},"events":['), F.col("events"), F.lit("]}"))
    return rows.groupBy("trace_id").agg(events.alias("events")).select(F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(True).alias("utf8"), text.alias("text"))


@query(
    """WITH e AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id, event_type, props->>'$.k' AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
    t AS (SELECT trace_id, event_id, [CAST(to_json([['arguments', '{"k":' || k || '}'], ['tool', '"' || event_type || '"'], ['type', '"tool_call"']]) AS VARCHAR)]
            || CASE WHEN event_type NOT IN ('click', 'purchase') THEN [] WHEN v IS NULL THEN [CAST(to_json([['tool', '"' || event_type || '"'], ['type', '"tool_result"']]) AS VARCHAR)]
               ELSE [CAST(to_json([['result', CAST(v AS VARCHAR)], ['tool', '"' || event_type || '"'], ['type', '"tool_result"']]) AS VARCHAR)] END AS own FROM e)
    SELECT trace_id, 'sha256:' || sha256(CAST(to_json(['one' || chr(30) || 'request', '[]', NULL, '[]', 'unknown', NULL, NULL, NULL, '[]']) AS VARCHAR)
      || CAST(to_json(flatten(list(own ORDER BY event_id))) AS VARCHAR)) AS content_hash FROM t GROUP BY trace_id"""
)
def interaction_hashes(spark, d):
    """Content hashes of whole records: arguments and results count, ids do not."""
    return ingest.with_hash(traces.parse(_recorded(spark, d))).select("trace_id", "content_hash")


# --- runs and comparison ------------------------------------------------------------------------------


@query(f"WITH {RESULTS} SELECT run_id, outcome, count(*) AS n FROM results GROUP BY ALL")
def run_outcome_counts(spark, d):
    return results(spark, d).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESULTS} SELECT run_id, test_id, event_id, repetition FROM results")
def repetition_numbering(spark, d):
    return results(spark, d).select("run_id", "test_id", "event_id", "repetition")


@query(f"WITH {CASES} SELECT run_id, test_id, passed, failed, errored, repetitions, evaluated, round(pass_rate, 6) AS pass_rate, verdict FROM cases")
def case_summaries(spark, d):
    return comparison.summaries(results(spark, d)).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"WITH {CASES} SELECT run_id, verdict, count(*) AS n FROM cases GROUP BY ALL")
def case_verdicts(spark, d):
    return comparison.summaries(results(spark, d)).groupBy("run_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {CASES} SELECT run_id, test_id, CASE WHEN evaluated > 0 THEN round(greatest(0, {_LOW.format(p='passed', n='evaluated')}), 6) END AS low,
    CASE WHEN evaluated > 0 THEN round(least(1, {_HIGH.format(p='passed', n='evaluated')}), 6) END AS high FROM cases"""
)
def wilson_intervals(spark, d):
    w = statistics.wilson(F.col("passed"), F.col("evaluated"))
    return comparison.summaries(results(spark, d)).select("run_id", "test_id", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query(
    f"""WITH {RESULTS} SELECT run_id, test_id, repetition, outcome FROM results
    QUALIFY row_number() OVER (PARTITION BY run_id, test_id ORDER BY outcome = 'fail' DESC, CASE WHEN outcome = 'fail' THEN -repetition ELSE repetition END) = 1"""
)
def representative_result(spark, d):
    return comparison.representative(results(spark, d)).select("run_id", "test_id", "repetition", "outcome")


@query(f"WITH {COMPARED} SELECT test_id, b_verdict, c_verdict, b_passed, c_passed, classification FROM compared")
def compare_runs(spark, d):
    return comparison.compare(results(spark, d)).select("test_id", "b_verdict", "c_verdict", "b_passed", "c_passed", "classification")


@query(f"WITH {COMPARED} SELECT classification, count(*) AS n FROM compared GROUP BY ALL")
def compare_class_counts(spark, d):
    return comparison.compare(results(spark, d)).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {COMPARED} SELECT count(*) AS comparable, round(count(*) FILTER (b_verdict = 'pass') / count(*), 6) AS baseline_rate,
    round(count(*) FILTER (c_verdict = 'pass') / count(*), 6) AS candidate_rate FROM compared WHERE classification IN {_COMPARABLE}"""
)
def pass_rates(spark, d):
    return comparison.pass_rates(comparison.compare(results(spark, d))).withColumns({c: F.round(c, 6) for c in ("baseline_rate", "candidate_rate")})


@query(f"WITH {COMPARED} SELECT test_id, b_verdict, c_verdict, classification FROM compared WHERE flaky")
def flaky_cases(spark, d):
    return comparison.compare(results(spark, d)).where("flaky").select("test_id", "b_verdict", "c_verdict", "classification")


@query(
    f"""WITH {COMPARED}, s AS (SELECT count(*) AS pairs, count(*) FILTER (classification = 'fixed') AS fixed, count(*) FILTER (classification = 'regression') AS regressions
      FROM compared WHERE classification IN {_COMPARABLE}),
    t AS (SELECT *, fixed + regressions AS n, least(fixed, regressions) AS x FROM s),
    p AS (SELECT least(1, 2 * sum(exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0)))) AS p FROM t, range(0, (SELECT x + 1 FROM t)) r(k))
    SELECT pairs, fixed, regressions, round((fixed - regressions) / pairs, 6) AS difference, round(log10(p), 5) AS log_p, p < 0.05 AS significant,
      round((fixed - regressions) / pairs - {_Z} * sqrt((n - (fixed - regressions) * (fixed - regressions) / pairs) / (pairs * pairs)), 6) AS low,
      round((fixed - regressions) / pairs + {_Z} * sqrt((n - (fixed - regressions) * (fixed - regressions) / pairs) / (pairs * pairs)), 6) AS high FROM t, p"""
)
def mcnemar_stats(spark, d):
    s = comparison.paired_statistics(comparison.compare(results(spark, d)))
    # a p-value below the doubles is 0, and Spark's logarithm of 0 is null
    log_p = F.when(F.col("p_value") > 0, F.log10("p_value")).otherwise(float("-inf"))
    return s.select("pairs", "fixed", "regressions", F.round("difference", 6).alias("difference"), F.round(log_p, 5).alias("log_p"), "significant", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _runs(spark, d):
    """A run for each user: the type of its last event is the target."""
    return spans(spark, d).select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target_id"), F.col("ts").alias("started_at"), "tool")


@query(f"WITH {SPANS} SELECT 't' || user_id AS target_id, 'r' || event_id AS run_id FROM spans QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'r' || event_id DESC) = 1")
def latest_run_per_target(spark, d):
    return store.latest(_runs(spark, d), "target_id", "started_at", "run_id").select("target_id", "run_id")


@query(f"WITH {SPANS} SELECT 't' || user_id AS target_id, arg_max('r' || event_id, ts) AS run_id FROM spans WHERE tool = 'purchase' GROUP BY ALL")
def current_baseline(spark, d):
    promoted = _runs(spark, d).where("tool = 'purchase'")
    return promoted.groupBy("target_id").agg(F.max_by("run_id", "started_at").alias("run_id"))


# --- families ---------------------------------------------------------------------------------------


def _members(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("v"), F.lpad(v.cast("string"), 9, "0")).alias("failure_id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_id"),
        F.col("embedding").cast("array<double>").alias("vector"), F.when(v % 4 == 0, "critical").when(v % 4 == 1, "high").when(v % 4 == 2, "medium").alias("severity"), "vec_id", "label",
    )


@query(f"WITH {MEMBERS} SELECT failure_id, cluster_id, round(distance, 6) AS distance FROM placed")
def family_centroid_distance(spark, d):
    return families.member_distances(_members(spark, d)).select("failure_id", "cluster_id", F.round("distance", 6).alias("distance"))


@query(
    f"""WITH {MEMBERS}, r AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS rank FROM (SELECT * REPLACE (round(distance, 9) AS distance) FROM placed)),
    w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, failure_id) AS a, row_number() OVER (PARTITION BY cluster_id ORDER BY distance DESC, failure_id) AS b,
      row_number() OVER (PARTITION BY cluster_id ORDER BY rank, distance, failure_id) AS c FROM r)
    SELECT failure_id, cluster_id, concat_ws(',', CASE WHEN a = 1 THEN 'central' END, CASE WHEN b = 1 THEN 'boundary' END, CASE WHEN c = 1 THEN 'high_severity' END) AS roles FROM w WHERE a = 1 OR b = 1 OR c = 1"""
)
def family_roles(spark, d):
    placed = families.member_distances(_members(spark, d)).withColumn("distance", F.round("distance", 9))
    return families.roles(placed).where(F.size("roles") > 0).select("failure_id", "cluster_id", F.array_join("roles", ",").alias("roles"))


@query(
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE 1 - list_dot_product(a.v, b.v) < 0.55"""
)
def cosine_pairs_below_threshold(spark, d):
    """All near pairs, by blocks of vectors: no cross join."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("point"), F.col("embedding").cast("array<double>").alias("vector"))
    return linkage.near_pairs(points, 0.55)


@query()
def average_linkage_families(spark, d):
    """Exact average linkage of the vectors, clustered within parts that no merge can leave."""
    rows = _members(spark, d).select(F.lit("described").alias("population"), "failure_id", "vector")
    return families.cluster(rows, {"described": 0.75})


@query()
def hashing_embedding(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", families.embedder()(F.col("text")).alias("vector"))
    return rows.select("conv_id", "turn", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 9).alias("total"), F.size("vector").alias("dimensions"))


_WORDS = "[x FOR x IN list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) IF length(x) > 1 AND NOT regexp_matches(x, '\\p{Nd}')]"


@query(
    f"""WITH t AS (SELECT conv_id, turn, unnest({_WORDS}) AS term FROM conversations WHERE text IS NOT NULL),
    n AS (SELECT conv_id, count(DISTINCT turn) AS n FROM t GROUP BY ALL),
    c AS (SELECT conv_id, term, count(*) AS df FROM t GROUP BY ALL),
    r AS (SELECT conv_id, term, row_number() OVER (PARTITION BY conv_id ORDER BY df DESC, term) AS place FROM c JOIN n USING (conv_id) WHERE df >= greatest(1, (n + 1) // 2))
    SELECT 'c' || conv_id AS cluster_id, string_agg(term, ', ' ORDER BY place) AS terms FROM r WHERE place <= 3 GROUP BY ALL"""
)
def family_shared_terms(spark, d):
    rows = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("cluster_id"), F.col("turn").cast("string").alias("failure_id"), "text")
    return families.shared_terms(rows)


@query(
    """WITH m AS (SELECT 'c' || label AS cluster_id, ['wrong_tool_argument','other','unnecessary_action'][1 + vec_id % 3] AS kind, ['planner','tools'][1 + vec_id % 2] AS component FROM embeddings),
    k AS (SELECT cluster_id, kind FROM m GROUP BY cluster_id, kind QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, kind) = 1),
    c AS (SELECT cluster_id, component FROM m GROUP BY cluster_id, component QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, component) = 1)
    SELECT cluster_id, kind || ' in ' || component AS label FROM k JOIN c USING (cluster_id)"""
)
def family_labels(spark, d):
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("vec_id") % n + 1).cast("int"))
    rows = _members(spark, d).select(
        "cluster_id", "failure_id", at(("wrong_tool_argument", "other", "unnecessary_action"), 3).alias("failure_type"), at(("planner", "tools"), 2).alias("component"),
        F.lit(None).cast("string").alias("behaviour"), F.lit("").alias("text"),
    )
    return families.labels(rows)


@query(
    f"""WITH {SPANS}, t AS (SELECT trace_id, string_agg(DISTINCT tool, ', ' ORDER BY tool) AS listed, CASE WHEN bool_or(errored) THEN 'explicit_status' ELSE 'failed_evaluator' END AS kind FROM spans GROUP BY trace_id)
    SELECT trace_id, listed || ' ' || listed || ' ' || listed || ' | ' || kind || ' | slow answer' AS text FROM t"""
)
def observation_text(spark, d):
    rows = spans(spark, d).groupBy("trace_id").agg(F.collect_list("tool").alias("tools"), F.when(F.max("errored"), "explicit_status").otherwise("failed_evaluator").alias("kind"))
    seen = F.array(F.lit("the trace is explicitly marked as failed"), F.lit("slow answer"))
    return rows.select("trace_id", families.observation_text(F.col("tools"), F.array("kind", "kind"), seen).alias("text"))


@query(f"WITH {DOCS} SELECT trace_id, 'other in ' || lang || ': ' || source AS text FROM docs")
def cluster_text(spark, d):
    return doc_traces(spark, d).select("trace_id", families.cluster_text(F.lit("other"), F.col("lang"), F.col("source")).alias("text"))


# --- drafts and expectations ----------------------------------------------------------------------------


def _calls(spark, d):
    calls = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool", "arguments"))), lambda x: F.struct(x["tool"].alias("tool"), x["arguments"].alias("arguments")))
    rows = spans(spark, d).groupBy("trace_id").agg(calls.alias("calls"))
    return rows.withColumn("flat", expectations.flatten_json(F.element_at("calls", -1)["arguments"]))


def _derived(spark, d, kind):
    rows = _calls(spark, d).withColumns({"failure_type": F.lit(kind).cast("string"), "summary": F.lit("s"), "evidence": F.lit("slow answer")})
    return expectations.derive(rows).select("trace_id", F.explode("expectations").alias("e")).select("trace_id", "e.*")


@query(f"WITH {SPANS} SELECT trace_id, 'tool_argument_not_equals' AS type, arg_max(tool, (ts, event_id)) AS tool, 'k' AS path, CAST(arg_max(k, (ts, event_id)) AS VARCHAR) AS value FROM spans GROUP BY trace_id")
def last_tool_call_expectations(spark, d):
    return _derived(spark, d, None)


@query(
    f"""WITH {SPANS}, c AS (SELECT trace_id, tool, count(*) AS n, min((ts, event_id)) AS first FROM spans GROUP BY ALL),
    m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, first) = 1)
    SELECT trace_id, CASE WHEN n = 1 THEN 'tool_not_called' ELSE 'max_tool_calls' END AS type, tool, CASE WHEN n > 1 THEN CAST(n - 1 AS VARCHAR) END AS value FROM m"""
)
def call_limit_expectations(spark, d):
    return _derived(spark, d, "unnecessary_action").drop("path")


@query(f"WITH {SPANS} SELECT trace_id, 'tool_not_called' AS type, arg_max(tool, (ts, event_id)) AS tool FROM spans GROUP BY trace_id")
def forbidden_tool_expectations(spark, d):
    return _derived(spark, d, "wrong_tool_selection").select("trace_id", "type", "tool")


@query("SELECT event_id, 'k' AS path, props->>'$.k' AS value FROM events")
def flattened_arguments(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(expectations.flatten_json(F.col("props"))).alias("x")).select("event_id", "x.*")


def _pairs(spark, d):
    """Three expectations for each trace: its first, middle and last call tell their kinds."""
    e = expectations.expectation
    rows = spans(spark, d).groupBy("trace_id").agg(F.min_by("tool", "event_id").alias("a"), F.max_by("tool", "event_id").alias("b"), F.min_by("k", "event_id").alias("ka"), F.max_by("k", "event_id").alias("kb"))
    return rows.withColumn("es", F.array(e("tool_called", F.col("a")), e("tool_not_called", F.col("b")), e("tool_argument_equals", F.col("b"), F.lit("k"), F.col("ka").cast("string")), e("tool_argument_not_equals", F.col("b"), F.lit("k"), F.col("kb").cast("string"))))


@query(
    f"""WITH {SPANS}, g AS (SELECT trace_id, arg_min(tool, event_id) AS a, arg_max(tool, event_id) AS b, arg_min(k, event_id) AS ka, arg_max(k, event_id) AS kb FROM spans GROUP BY ALL)
    SELECT trace_id, 0 AS first, 1 AS second FROM g WHERE a = b UNION ALL SELECT trace_id, 1, 2 FROM g UNION ALL SELECT trace_id, 1, 3 FROM g UNION ALL SELECT trace_id, 2, 3 FROM g WHERE ka = kb"""
)
def contradiction_pairs(spark, d):
    rows = _pairs(spark, d).select("trace_id", F.explode(expectations.contradictions(F.col("es"))).alias("c"))
    return rows.select("trace_id", "c.first", "c.second")


@query(
    f"""WITH {SPANS}, g AS (SELECT trace_id, arg_min(tool, event_id) AS a, arg_max(tool, event_id) AS b, arg_min(k, event_id) AS ka, arg_max(k, event_id) AS kb FROM spans GROUP BY ALL)
    SELECT g.trace_id, 'pass' AS called, 'fail' AS not_called, CASE WHEN count(*) FILTER (s.tool = b AND s.k = ka) > 0 THEN 'pass' ELSE 'fail' END AS equals, 'fail' AS not_equals,
      CASE WHEN count(*) <= 2 THEN 'pass' ELSE 'fail' END AS few, 'error' AS rubric FROM g JOIN spans s USING (trace_id) GROUP BY g.trace_id, a, b, ka, kb"""
)
def evaluate_expectations(spark, d):
    rows = _pairs(spark, d).join(_calls(spark, d), "trace_id")
    e = expectations.expectation
    run = lambda x: expectations.evaluate(x, F.lit("done"), F.col("calls"))
    at = lambda k: run(F.col("es")[k])
    few, rubric = run(e("max_tool_calls", None, None, F.lit("2"))), run(e("human_rubric", None, None, F.lit('"x"')))
    return rows.select("trace_id", at(0).alias("called"), at(1).alias("not_called"), at(2).alias("equals"), at(3).alias("not_equals"), few.alias("few"), rubric.alias("rubric"))


@query(
    """SELECT event_id, x.kind, x.verdict FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events) e,
    LATERAL (SELECT unnest(['number', 'text', 'null', 'absent', 'not_null', 'pattern', 'bad_pattern', 'contains', 'lacks', 'few', 'rubric', 'called', 'not_called']) AS kind,
      unnest([CASE WHEN k % 4 = 0 THEN 'pass' ELSE 'fail' END, 'fail', 'pass', 'fail', 'fail', CASE WHEN k % 2 = 0 THEN 'pass' ELSE 'fail' END, 'error',
        CASE WHEN k % 10 = 7 THEN 'pass' ELSE 'fail' END, CASE WHEN k % 10 = 7 THEN 'fail' ELSE 'pass' END, 'pass', 'error', 'pass', 'fail']) AS verdict) x"""
)
def evaluate_all_kinds(spark, d):
    """Every kind on every event: numbers, texts, nulls and absent arguments stay apart, and a bad pattern is an error."""
    k = F.get_json_object("props", "$.k").cast("int")
    calls = F.array(F.struct(F.lit("t").alias("tool"), F.concat(F.lit('{"a":{"n":'), (k % 4).cast("string"), F.lit(',"z":null}}')).alias("arguments")))
    e, t = expectations.expectation, F.lit("t")
    es = {
        "number": e("tool_argument_equals", t, F.lit("a.n"), F.lit("0.0")), "text": e("tool_argument_equals", t, F.lit("a.n"), F.lit('"0"')),
        "null": e("tool_argument_equals", t, F.lit("a.z"), F.lit("null")), "absent": e("tool_argument_equals", t, F.lit("a.y"), F.lit("null")), "not_null": e("tool_argument_not_equals", t, F.lit("a.z"), F.lit("null")),
        "pattern": e("output_matches", None, None, F.lit('"[02468]$"')), "bad_pattern": e("output_matches", None, None, F.lit('"(["')),
        "contains": e("output_contains", None, None, F.lit('"7"')), "lacks": e("output_not_contains", None, None, F.lit('"7"')),
        "few": e("max_tool_calls", None, None, F.lit("1")), "rubric": e("human_rubric", None, None, F.lit('"x"')), "called": e("tool_called", t), "not_called": e("tool_not_called", t),
    }
    rows = table(spark, d, "events").select("event_id", (k % 10).cast("string").alias("out"), calls.alias("calls"), F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), x.alias("e")) for n, x in es.items()])).alias("x"))
    return rows.select("event_id", "x.kind", expectations.evaluate(F.col("x.e"), F.col("out"), F.col("calls")).alias("verdict"))


@query(
    f"""WITH {SPANS} SELECT event_type AS tool, CASE WHEN event_type IN ('click', 'view') THEN 'positive' ELSE 'other' END AS side, count(*) AS n FROM events GROUP BY ALL"""
)
def expectation_classes(spark, d):
    kind = F.when(F.col("tool") == "click", "tool_called").when(F.col("tool") == "view", "output_contains").otherwise("tool_not_called")
    side = F.when(kind.isin(*expectations.POSITIVE), "positive").otherwise("other")
    return spans(spark, d).groupBy("tool", side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_prompt_render(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(text.alias("prompt"), F.count(F.lit(1)).alias("turns"))


@query(
    f"""WITH {SPANS}, c AS (SELECT trace_id, k, arg_max(event_id, event_id) AS call FROM spans WHERE tool IN ('view', 'signup') GROUP BY ALL)
    SELECT s.trace_id, s.event_id AS result, c.call FROM spans s LEFT JOIN c USING (trace_id, k) WHERE s.tool IN ('click', 'purchase')"""
)
def fixture_join(spark, d):
    """Results with the call of their id; of repeated call ids the last counts."""
    rows = spans(spark, d)
    calls = rows.where(F.col("tool").isin("view", "signup")).groupBy("trace_id", "k").agg(F.max("event_id").alias("call"))
    return rows.where(F.col("tool").isin("click", "purchase")).join(calls, ["trace_id", "k"], "left").select("trace_id", F.col("event_id").alias("result"), "call")


@query(
    """SELECT n_name AS nation, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
)
def revenue_by_nation(spark, d):
    """The relational core on the star schema: two fact joins and one grouped fold."""
    t = lambda n: table(spark, d, n)
    joined = (
        t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")), "c_nationkey")
    )
    by_order = joined.groupBy("nation", "l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return by_order.groupBy("nation").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


from tracewright.plans import stored  # noqa: E402,F401  registers its queries here
