"""Every registered query of the engine against its DuckDB statement."""

import os

import duckdb
import pytest

from tracewright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canon(rows):
    cell = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    assert canon([[r[c] for c in order] for r in rows]) == canon([[r[k] for k in at] for r in got.fetchall()])


def test_class_counts_of_the_larger_table(spark):
    got = {r["classification"]: r["n"] for r in catalogue.compare_class_counts(spark, "/root/testdata/sf0.01").collect()}
    assert got == {"fixed": 327, "likely_fixed": 1, "missing": 95, "not_comparable": 109, "regression": 445, "unchanged_failure": 225, "unchanged_pass": 297}


def test_rows_do_not_depend_on_partitions(spark, tmp_path):
    a = canon(catalogue.compare_runs(spark, SF).collect())
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).write.parquet(f"{tmp_path}/{t}.parquet")
    assert canon(catalogue.compare_runs(spark, str(tmp_path)).collect()) == a
    assert canon(catalogue.average_linkage_families(spark, str(tmp_path)).collect()) == canon(catalogue.average_linkage_families(spark, SF).collect())


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
