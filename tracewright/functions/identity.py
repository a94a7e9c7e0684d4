"""Stable identifiers, all from sha-256 of immutable facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(col: Column, n: int) -> Column:
    return F.substring(F.sha2(col.cast("binary"), 256), 1, n)


def failure_id(trace_id: Column) -> Column:
    return F.concat(F.lit("fail-"), _hex(trace_id, 12))


def cluster_id(members: Column) -> Column:
    """``members``: array of failure ids in any order."""
    return F.concat(F.lit("cl-"), _hex(F.array_join(F.array_sort(members), "\n"), 12))


def suite_hash(tests: Column) -> Column:
    return F.concat(F.lit("sha256:"), _hex(F.array_join(F.array_sort(tests), "\n"), 16))


def occurrence_id(content_hash: Column, trace_id: Column, recorded_at: Column, source: Column) -> Column:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return _hex(F.concat_ws("\n", content_hash, trace_id, blank(recorded_at), blank(source)), 24)


def content_hash(canonical: Column) -> Column:
    """Of canonical JSON text (see :func:`canonical_json`)."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical.cast("binary"), 256))


def canonical_json(payload: Column) -> Column:
    """JSON text through VARIANT: keys sorted, compact; 1 and 1.0 print alike."""
    return F.to_json(F.try_parse_json(payload))


#: Keys of an event that name the recording, not the interaction.
VOLATILE = ("event_id", "call_id", "timestamp")


def event_identity(event: Column) -> Column:
    """A VARIANT event as text: its members by name, without volatile and null ones; no arguments are empty arguments."""
    members = F.map_filter(event.try_cast("map<string,variant>"), lambda k, v: ~k.isin(*VOLATILE) & ~F.is_variant_null(v))
    texts = F.transform_values(members, lambda _, v: F.to_json(v))
    told = F.map_filter(texts, lambda k, v: ~((k == "arguments") & (v == "{}")))
    return F.to_json(F.transform(F.array_sort(F.map_keys(told)), lambda k: F.array(k, told[k])))


def interaction_hash(text: Column, *facts: Column) -> Column:
    """Of what was said and done: ``facts`` (already parsed, in a fixed order) and the events of the trace's JSON
    ``text`` with their arguments and results, but without identifiers, times or provenance."""
    events = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.events", "array<variant>"), F.array().cast("array<variant>"))
    said = F.array(*[f.cast("string") for f in facts])
    # JSON escapes what separates its parts, and tells a null from any text
    return content_hash(F.concat(F.to_json(said), F.to_json(F.transform(events, event_identity))))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


def slug(text: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[REDACTED:[^\]]*\]", " "))
    words = F.slice(F.regexp_extract_all(clean, F.lit("[a-z0-9]+"), F.lit(0)), 1, 6)
    return F.btrim(F.left(F.array_join(words, "_"), F.lit(48)), F.lit("_"))


def test_id(trace_id: Column, text: Column) -> Column:
    stem = slug(text)
    return F.concat_ws("_", F.when(stem == "", F.lit("test")).otherwise(stem), _hex(trace_id, 8))
