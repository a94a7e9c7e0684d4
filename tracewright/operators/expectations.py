"""Regression expectations: derivation, validation, contradictions and evaluation.

An expectation is a struct<type, tool, path, value>; ``value`` holds JSON text, so that 1, "1" and
null stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPECTATION = "struct<type:string,tool:string,path:string,value:string>"
POSITIVE = ("output_contains", "output_matches", "tool_called", "tool_argument_equals")
TYPES = ("output_contains", "output_not_contains", "output_matches", "tool_called", "tool_not_called", "tool_argument_equals", "tool_argument_not_equals", "max_tool_calls", "human_rubric")


def expectation(type_: str, tool: Column | None = None, path: Column | None = None, value: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(type_).alias("type"), (tool if tool is not None else null).alias("tool"), (path if path is not None else null).alias("path"), (value if value is not None else null).alias("value")).cast(EXPECTATION)


def prose(value: Column) -> Column:
    """Free text, which no equality check can pin down: over 80 characters or 8 spaces."""
    text = plain(value)
    return value.startswith('"') & ((F.char_length(text) > 80) | (F.regexp_count(text, F.lit(" ")) > 8))


_FLAT = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_FLAT)
def flatten_json(arguments):
    """Dotted scalars of JSON objects; nesting beyond four levels and lists are dropped."""
    import json

    import pandas as pd

    def walk(value, prefix, left):
        for key, v in value.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(v, dict):
                if left:
                    yield from walk(v, path, left - 1)
            elif not isinstance(v, list):
                yield {"path": path, "value": json.dumps(v, ensure_ascii=False)}

    out = []
    for text in arguments:
        value = json.loads(text) if text else {}
        out.append(list(walk(value, "", 3)) if isinstance(value, dict) else [])
    return pd.Series(out)


def derive(failures: DataFrame) -> DataFrame:
    """Adds ``expectations`` to rows with failure_type (null: undescribed), summary, evidence,
    calls array<struct<tool, arguments>> and flat array<struct<path, value>> of the last call."""
    last = F.element_at("calls", -1)["tool"]
    none = F.array().cast(f"array<{EXPECTATION}>")
    has = F.size("calls") > 0
    scalars = F.filter("flat", lambda x: ~prose(x["value"]))
    forbid_tool = F.when(has, F.array(expectation("tool_not_called", last))).otherwise(none)
    forbid_arguments = (
        F.when(~has, none)
        .when(F.size(scalars) == 0, forbid_tool)
        .otherwise(F.transform(scalars, lambda x: expectation("tool_argument_not_equals", last, x["path"], x["value"])))
    )
    # the tool called most, the first met among equals
    tools = F.transform("calls", lambda c: c["tool"])
    counted = F.transform(F.array_distinct(tools), lambda t: F.struct(F.size(F.filter(tools, lambda x: x == t)).alias("n"), (-F.array_position(tools, t)).alias("at"), t.alias("tool")))
    most = F.array_max(counted)
    limit = F.when(~has, none).when(most["n"] == 1, F.array(expectation("tool_not_called", most["tool"]))).otherwise(
        F.array(expectation("max_tool_calls", most["tool"], None, (most["n"] - 1).cast("string")))
    )
    kind = F.col("failure_type")
    found = (
        F.when(kind.isNull() | (kind == "wrong_tool_argument"), forbid_arguments)
        .when(kind == "wrong_tool_selection", forbid_tool)
        .when(kind == "unnecessary_action", limit)
        .otherwise(none)
    )
    words = F.coalesce(F.when(kind.isNotNull(), F.col("summary")), F.col("evidence"), F.lit("the interaction was recorded as a failure"))
    rubric = F.array(expectation("human_rubric", None, None, json_string(F.concat(F.lit("The agent must not repeat this failure: "), words))))
    return failures.withColumn("expectations", F.when(F.size(found) > 0, found).otherwise(rubric))


#: Fixed values: (first type, second types, what must agree, what must differ, reason) of pairs that cannot both hold.
CONFLICTS = (
    ("tool_called", ("tool_not_called",), ("tool",), (), "a tool is required and forbidden"),
    ("tool_not_called", ("tool_argument_equals", "tool_argument_not_equals"), ("tool",), (), "an argument of a forbidden tool is checked"),
    ("tool_called", ("max_tool_calls",), ("cap",), (), "a required tool is capped at zero"),
    ("tool_argument_equals", ("tool_argument_not_equals",), ("tool", "path", "value"), (), "an argument must equal and not equal a value"),
    ("tool_argument_equals", ("tool_argument_equals",), ("tool", "path"), ("value",), "an argument must equal two values"),
    ("output_contains", ("output_not_contains",), ("value",), (), "the output must contain and not contain a text"),
    ("max_tool_calls", ("max_tool_calls",), ("tool",), ("value",), "a tool has two call limits"),
)


def contradiction(a: Column, b: Column) -> Column:
    """Reason why two expectations, in this order, cannot both hold; or null."""
    alike = {field: a[field].eqNullSafe(b[field]) for field in ("tool", "path", "value")}
    alike["cap"] = (b["value"] == "0") & (b["tool"].isNull() | alike["tool"])
    found = []
    for first, seconds, same, other, reason in CONFLICTS:
        hit = (a["type"] == first) & b["type"].isin(*seconds)
        for field in same:
            hit = hit & alike[field]
        for field in other:
            hit = hit & ~alike[field]
        found.append(F.when(hit, reason))
    return F.coalesce(*found)


def contradictions(expectations: Column) -> Column:
    """array<struct<first, second, reason>> over all pairs, either order."""
    n = F.size(expectations)
    at = lambda i: F.element_at(expectations, i + 1)
    pairs = F.flatten(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i), lambda j: F.struct(i.alias("first"), j.alias("second"), F.coalesce(contradiction(at(i), at(j)), contradiction(at(j), at(i))).alias("reason"))))
    )
    return F.when(n > 1, F.filter(pairs, lambda p: p["reason"].isNotNull())).otherwise(F.array().cast("array<struct<first:int,second:int,reason:string>>"))


def invalid(e: Column) -> Column:
    """Reason why an expectation could never be evaluated, or null."""
    kind, text = e["type"], F.regexp_extract(e["value"], '^"([\\s\\S]*)"$', 1)
    blank = e["value"].isNull() | ~e["value"].startswith('"') | (F.trim(text) == "")
    missing_tool = e["tool"].isNull() | (e["tool"] == "")
    return (
        F.when(kind.isin("tool_argument_equals", "tool_argument_not_equals") & (missing_tool | e["path"].isNull() | (e["path"] == "")), "needs a tool and a path")
        .when(kind.isin("tool_called", "tool_not_called") & missing_tool, "needs a tool")
        .when((kind == "max_tool_calls") & ~F.coalesce(e["value"].rlike(r"^-?\d+$"), F.lit(False)), "needs a whole number")
        .when((kind == "max_tool_calls") & e["value"].startswith("-"), "cannot be negative")
        .when((kind == "output_matches") & (e["value"].isNull() | ~e["value"].startswith('"')), "needs a pattern")
        .when(kind.isin("output_contains", "output_not_contains", "human_rubric") & blank, "needs text")
        .when((kind == "output_matches") & ~compiles(plain(e["value"])), "the pattern does not compile")
    )


def plain(value: Column) -> Column:
    """The text of a JSON string."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def json_string(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def compiles(pattern: Column) -> Column:
    """Whether a pattern is one; it is only tried, so a bad one is no error."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce(pattern, F.lit(""))).isNotNull()


def describe(e: Column) -> Column:
    """An expectation in a line of text."""
    kind, at = e["type"], F.concat(e["tool"], F.lit("."), e["path"])
    return (
        F.when(kind == "tool_argument_equals", F.concat(at, F.lit(" == "), e["value"]))
        .when(kind == "tool_argument_not_equals", F.concat(at, F.lit(" != "), e["value"]))
        .when(kind == "tool_called", F.concat(F.lit("calls "), e["tool"]))
        .when(kind == "tool_not_called", F.concat(F.lit("never calls "), e["tool"]))
        .when(kind == "max_tool_calls", F.concat(F.lit("at most "), e["value"], F.lit(" calls to "), F.coalesce(e["tool"], F.lit("any tool"))))
        .when(kind == "human_rubric", F.concat(F.lit("rubric: "), plain(e["value"])))
        .otherwise(F.concat(kind, F.lit(" "), e["value"]))
    )


def value_at(arguments: Column, path: Column) -> Column:
    """JSON text of the value at a dotted path; ``null`` for a JSON null, and null where there is none."""
    step = lambda v, key: v.try_cast("map<string,variant>")[key]
    return F.to_json(F.aggregate(F.split(path, r"\."), F.try_parse_json(arguments), step))


def evaluate(e: Column, text: Column, calls: Column) -> Column:
    """pass, fail or error (a rubric needs a judge, a pattern may be none) of an expectation on an output.

    ``calls``: array<struct<tool, arguments>> with JSON object arguments.
    """
    words = plain(e["value"])
    out = F.coalesce(text, F.lit(""))
    of_tool = F.filter(calls, lambda c: e["tool"].isNull() | (c["tool"] == e["tool"]))
    # as JSON values: 1 and "1" differ, a null is a value, and an absent argument is none
    wanted = F.to_json(F.try_parse_json(e["value"]))
    has_value = F.exists(of_tool, lambda c: F.coalesce(value_at(c["arguments"], e["path"]) == wanted, F.lit(False)))
    kind = e["type"]
    ok = (
        F.when(kind == "output_contains", F.contains(out, words))
        .when(kind == "output_not_contains", ~F.contains(out, words))
        .when((kind == "output_matches") & compiles(words), F.regexp_like(out, words))
        .when(kind == "tool_called", F.size(of_tool) > 0)
        .when(kind == "tool_not_called", F.size(of_tool) == 0)
        .when(kind == "tool_argument_equals", has_value)
        .when(kind == "tool_argument_not_equals", ~has_value)
        .when(kind == "max_tool_calls", F.size(of_tool) <= e["value"].try_cast("int"))
    )
    unfit = (kind == "human_rubric") | ((kind == "output_matches") & ~compiles(words))
    return F.when(unfit, "error").when(ok, "pass").otherwise("fail")
