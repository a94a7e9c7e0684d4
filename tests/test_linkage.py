"""Linkage over several tasks against the one-task form, and near pairs through pivots against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright import shared
from tracewright.operators import families, linkage

SCHEMA = "failure_id string, vector array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x):
    return spark.createDataFrame([(f"f{k:05d}", v.tolist()) for k, v in enumerate(x)], SCHEMA)


def groups(rows):
    found = {}
    for r in rows:
        found.setdefault(r.root, []).append(int(r.failure_id[1:]))
    return sorted(sorted(g) for g in found.values())


def around(rng, centres, n, spread, width):
    """``n`` vectors near each of some centres."""
    middle = unit(rng.normal(size=(centres, width)))
    return unit(np.repeat(middle, n, axis=0) + spread * rng.normal(size=(centres * n, width)))


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_a_giant_part_gives_the_families_of_one_task(spark, threshold):
    x = unit(np.random.default_rng(3).normal(size=(400, 6)))
    points = table(spark, x).select(F.col("failure_id").alias("point"), "vector", F.lit(1).cast("long").alias("size"))
    assert linkage.parts(points, threshold, 90).select("part").distinct().count() == 1
    assert groups(linkage.cluster(table(spark, x), threshold, 90, 90).collect()) == linkage.average_linkage(x, threshold)


def test_equal_vectors_are_one_point_and_count_as_many(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(unit(rng.normal(size=(1, 4))), 150, axis=0), unit(rng.normal(size=(60, 4)))])
    points, members = linkage.folded(table(spark, x))
    assert (points.count(), members.count(), points.agg(F.max("size")).first()[0]) == (61, 210, 150)
    assert groups(linkage.cluster(table(spark, x), 0.6, 25, 25).collect()) == linkage.average_linkage(x, 0.6)


def test_many_equal_distances_do_not_queue(spark):
    # all pairs of 256 are at one distance: ties, decided by hashes, let many merge in a round
    x = np.eye(256)
    points = table(spark, x).select(F.col("failure_id").alias("cid"), F.col("vector").alias("mean"), F.lit(1).cast("long").alias("size"), F.lit("p").alias("part"), F.lit(256).cast("long").alias("n_open"))
    moves, left = linkage._mutual(points, 1.5, 60)
    assert moves.count() == 256 and 256 - left.count() >= 40


def test_zero_and_missing_vectors_stay_alone(spark):
    rows = [("a", [0.0, 0.0]), ("b", [0.0, -0.0]), ("c", [1.0, 0.0]), ("d", [1.0, -0.0]), ("e", None), ("f", None), ("g", [float("nan"), 1.0]), ("h", [None, 1.0])]
    got = {r.failure_id: r.root for r in linkage.cluster(spark.createDataFrame(rows, SCHEMA), 0.5, 2, 2).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "d": "c", "e": "e", "f": "f", "g": "g", "h": "h"}
    assert linkage.cluster(spark.createDataFrame([], SCHEMA), 0.5).count() == 0


@pytest.mark.parametrize("threshold", [1e-6, 0.2, 0.55, 1.0, 1.3])
def test_near_pairs_are_all_pairs(spark, threshold):
    rng = np.random.default_rng(5)
    x = np.concatenate([around(rng, 6, 30, 0.15, 12), np.zeros((3, 12))])
    x[7] = x[8]
    want = {(f"f{a:05d}", f"f{b:05d}") for a, b in zip(*np.nonzero(np.triu(1 - x @ x.T < threshold, 1)))}
    got = linkage.near_pairs(table(spark, x).withColumnRenamed("failure_id", "point"), threshold, 20).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_pivots_shuffle_less_where_vectors_lie_in_groups(spark):
    x = around(np.random.default_rng(6), 40, 50, 0.05, 32)
    rows = linkage.dealt(table(spark, x).withColumnRenamed("failure_id", "point"), 0.3, 100)
    copies = rows.agg(F.sum(F.size("targets"))).first()[0]
    # every row to every block would be 20 copies a row
    assert copies < len(x) * 20 / 2


def test_families_name_clusters_by_their_members(spark):
    x = unit(np.random.default_rng(7).normal(size=(80, 3)))
    rows = table(spark, x).withColumn("population", F.lit("described"))
    assert sorted(families.cluster(rows, {"described": 0.4}, 15, 15).select("failure_id", "cluster_id").collect()) == sorted(families.cluster(rows, {"described": 0.4}).select("failure_id", "cluster_id").collect())


def test_a_cluster_that_takes_its_neighbours_one_by_one_takes_few_rounds(spark, monkeypatch):
    # on a line of growing gaps each merge must wait for the one before it
    angle = np.cumsum(np.r_[0, 0.02 * 1.035 ** np.arange(60)])
    x = np.c_[np.cos(angle / 4), np.sin(angle / 4)]
    rounds, mutual = [], linkage._mutual
    monkeypatch.setattr(linkage, "_mutual", lambda *a: rounds.append(1) or mutual(*a))
    assert groups(linkage.cluster(table(spark, x), 0.5, 20, 20).collect()) == linkage.average_linkage(x, 0.5)
    assert 1 <= len(rounds) <= 8


def test_estimates_do_not_grow_in_a_loop_of_joins(spark):
    rows = spark.range(10).withColumn("x", F.lit(1))
    for _ in range(3):
        rows = shared.written(rows.join(rows.withColumnRenamed("x", "y"), "id").select("id", "x"), "loop")
    plan = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert rows.count() == 10 and plan < 1 << 20


def test_merges_inside_a_group_wait_for_what_is_nearer_outside():
    x = unit(np.array([[1.0, 0.0], [0.98, 0.2], [0.0, 1.0], [0.1, 1.0]]))
    none = np.full(4, -1)
    alone, _ = linkage._merged(x, 0.5, np.ones(4), np.full(4, np.inf), none, none > 0)
    assert alone.tolist() == [0, 0, 2, 2]
    # something outside is nearer to the second than the first is
    root, complete = linkage._merged(x, 0.5, np.ones(4), np.array([1.0, 0.001, 1.0, 1.0]), none, none > 0)
    assert root.tolist() == [0, 1, 2, 2] and complete.tolist() == [False, False, True, False]


def test_a_part_that_a_sample_shows_needs_no_blocks(spark, monkeypatch):
    x = unit(np.random.default_rng(8).normal(size=(300, 5)))
    points = table(spark, x).withColumnRenamed("failure_id", "point")
    met = []
    meetings = linkage.meetings
    monkeypatch.setattr(linkage, "meetings", lambda *a: met.append(1) or meetings(*a))
    assert {r.part for r in linkage.parts(points, 0.6, 50).collect()} == {"f00000"} and not met
    # one that is near to nothing has a part of its own, and so has a missing one
    odd = table(spark, np.zeros((1, 5))).select(F.lit("zero").alias("point"), "vector")
    none = odd.select(F.lit("none").alias("point"), F.lit(None).cast("array<double>").alias("vector"))
    assert {r.part for r in linkage.parts(points.unionByName(odd).unionByName(none), 0.6, 50).collect()} == {"f00000", "zero", "none"} and met


@pytest.mark.parametrize("step", [0.0, 1e-9, 1e-3])
def test_the_nearest_is_that_of_double_precision(step, monkeypatch):
    monkeypatch.setattr(linkage, "TILE", 7)
    rng = np.random.default_rng(9)
    x = np.concatenate([unit(rng.normal(size=(30, 6))), unit(np.ones((1, 6)) + step * rng.normal(size=(30, 6)))])
    rows = pd.DataFrame({"cid": [f"c{k:02d}" for k in range(60)], "mean": list(x), "h": rng.integers(1, 1 << 60, 60), "grp": np.arange(60) // 10, "blk": np.arange(60) // 30})
    found = pd.concat([linkage._nearest(0.9)(("p", i, j), rows if i != j else rows[rows["blk"] == i]) for i, j in ((0, 0), (0, 1), (1, 1))])
    gap = np.round(np.clip(1 - x @ x.T, 0, 2), 12)
    np.fill_diagonal(gap, np.inf)
    for k, (cid, own) in enumerate(found.groupby("cid")):
        near = own["gap"].min()
        assert near == pytest.approx(gap[k].min() if gap[k].min() < 0.9 else np.inf, abs=3e-12)
        if near < np.inf:
            first = own[own["gap"] == near].sort_values("tie").iloc[0]
            assert gap[k][int(first["other"][1:])] == pytest.approx(near, abs=3e-12)
        least = gap[k][np.arange(60) // 10 != k // 10].min()
        assert least - 1e-5 <= own["out"].min() <= least + 1e-12
