"""Folders that all machines share, cuts of lineage, and column names that are free in a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without it (tests): then a folder of our own is used.  On a
    cluster executors could not see such a folder, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tracewright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and continue from its rows in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`cut`, for loops of joins: a table of :func:`scratch`, whose size the planner takes from its files.

    A checkpoint carries the estimate of its plan along, and joins multiply estimates: after some rounds
    they are numbers of millions of digits, and planning takes minutes.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets the driver's garbage go, and with it the shuffle files of plans that nothing names any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a new table in the shared folder; :func:`release` deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def made() -> tuple[str, ...]:
    """Tables of :func:`scratch` that were not released."""
    return tuple(_MADE)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables of :func:`scratch` but those in ``keep``; their readers must have run."""
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for name in [p for p in _MADE if p not in keep]:
        path = path_of(name)
        path.getFileSystem(conf).delete(path, True)
        _MADE.remove(name)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def free_prefix(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` begins with it (names know no case)."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(wish.lower()) for c in names):
        wish = f"_{wish}"
    return wish
