"""``python -m tracewright``: from-traces, ingest, failures, history, compare, runs, baseline, queries."""

from __future__ import annotations

import argparse
import sys


def failures(spark, given) -> int:
    from tracewright.operators import decisions, store
    from tracewright.operators.versions import Store

    becomes = {"confirm": "confirmed", "dismiss": "dismissed", "reopen": "candidate"}
    try:
        if given.action == "list" or given.action == "show":
            rows = Store(spark, given.folder).read("failures")
            if rows is None:
                raise decisions.DecisionError("no failures are stored")
            if given.action == "list":
                store.page(rows, ("failure_id",), given.status, given.limit, given.offset).select("failure_id", "trace_id", "status", "origin", "kinds", "reviewer").show(given.limit, truncate=False)
            else:
                print(decisions.find(rows, given.name or ""))
        elif not given.name:
            raise decisions.DecisionError("which one?")
        elif given.action == "add":
            print(decisions.add(spark, given.folder, given.name, given.reviewer, given.reason))
        else:
            print(decisions.decide(spark, given.folder, given.name, becomes[given.action], given.reviewer, given.reason))
    except decisions.DecisionError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewright")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("from-traces", help="traces to families and drafted tests")
    one.add_argument("path")
    one.add_argument("out")
    one.add_argument("--format", default="jsonl")
    one = sub.add_parser("ingest", help="validate a file, or add it to a store; exit code 1 if a record is invalid or conflicts")
    one.add_argument("path")
    one.add_argument("--store")
    one.add_argument("--dry-run", action="store_true")
    one.add_argument("--format", default="jsonl")
    one.add_argument("--errors")
    one = sub.add_parser("failures", help="list the failures of a store, or confirm, dismiss, reopen or add one")
    one.add_argument("action", choices=("list", "show", "confirm", "dismiss", "reopen", "add"))
    one.add_argument("folder")
    one.add_argument("name", nargs="?", help="a failure id or a prefix of it, or the id of its trace")
    one.add_argument("--status")
    one.add_argument("--limit", type=int, default=50)
    one.add_argument("--offset", type=int, default=0)
    one.add_argument("--reviewer", default="command line")
    one.add_argument("--reason")
    one = sub.add_parser("history", help="the versions of a store")
    one.add_argument("folder")
    one = sub.add_parser("runs", help="the newest runs of a folder")
    one.add_argument("folder")
    one = sub.add_parser("baseline", help="make a run the baseline of a folder")
    one.add_argument("folder")
    one.add_argument("run")
    one.add_argument("--reviewer", default="command line")
    one.add_argument("--reason")
    one = sub.add_parser("compare", help="compare two runs of a results table; exit code 1 on regressions")
    one.add_argument("results")
    one.add_argument("baseline")
    one.add_argument("candidate")
    one = sub.add_parser("query", help="run a registered query over a folder of tables")
    one.add_argument("name")
    one.add_argument("folder")
    given = parser.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "from-traces":
        from tracewright.plans import from_traces

        print(from_traces.run(spark, given.path, given.out, format=given.format))
        return 0
    if given.command == "ingest":
        from tracewright.operators import ingest
        from tracewright.sources.adapters import UnknownFormat

        try:
            told = ingest.ingest(spark, given.path, given.store, ingest.Mode.DRY_RUN if given.dry_run else ingest.Mode.STORE, given.format, errors=given.errors)
        except UnknownFormat as e:
            print(e, file=sys.stderr)
            return 2
        print(f"{told.valid} valid, {told.issues} issues")
        print(told)
        return int(not told.ok)
    if given.command == "history":
        from tracewright.operators.versions import Store

        for number in (at := Store(spark, given.folder)).numbers():
            print(number, ", ".join(f"{t} ({len(x)} layers)" for t, x in sorted(at.manifest(number)["tables"].items())))
        return 0
    if given.command == "failures":
        return failures(spark, given)
    if given.command in ("runs", "baseline"):
        from tracewright.operators import runs

        try:
            if given.command == "runs":
                runs.recent(spark, given.folder).show(truncate=False)
            else:
                print(runs.promote(spark, given.folder, given.run, given.reviewer, given.reason))
        except runs.RunError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    if given.command == "compare":
        from tracewright.operators import comparison

        compared = comparison.compare(spark.read.parquet(given.results), given.baseline, given.candidate).persist()
        compared.groupBy("classification").count().orderBy("classification").show()
        comparison.paired_statistics(compared).show(truncate=False)
        return int(not compared.where("classification = 'regression'").isEmpty())
    from tracewright.plans.catalogue import QUERIES

    if given.name not in QUERIES:
        print("unknown query; one of: " + ", ".join(sorted(QUERIES)), file=sys.stderr)
        return 2
    QUERIES[given.name](spark, given.folder).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
