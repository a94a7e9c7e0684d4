"""Spans of a stream, held until their trace is complete and then given out together.

A trace is complete when no span of it has ended for ``gap`` of event time: it is due at the last end plus
the gap, and every later span moves that.  Spans wait in keyed state (RocksDB, so state is bounded by disk),
in any order; when the watermark has passed that time, all of them come out at once and the state goes.  What
remains for ``memory`` is a mark that the trace was closed, so that a span that comes even later is given
out as ``late`` instead of making a second trace.  Spans older than the watermark are dropped by the engine.

The key of the state is a bucket of traces (``buckets`` of them, by a hash of trace_id), since every call of a key
costs Python some milliseconds: a batch makes at most two calls a bucket, however many traces it holds.  A task has
the open spans and the marks of one bucket in memory, so streams of very many open traces want more buckets; their
number belongs to a checkpoint and cannot change with it.

Rows travel through the state as JSON of their own columns, so any span table with a key and an end will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
OUT = "trace_id string, span string, late boolean"
#: Buckets of traces, and spans in one value of the state or one batch given out.
BUCKETS, SLICE = 1024, 4096


class Closing(StatefulProcessor):
    """The traces of a bucket: their spans lie in the state many to a row, and one timer wakes the bucket for its earliest trace."""

    def __init__(self, gap_ms: int, memory_ms: int):
        self.gap_ms, self.memory_ms = gap_ms, memory_ms

    def init(self, handle) -> None:
        self.handle = handle
        #: Spans of open traces; ``due``: when the trace could be closed if no span came after this one.
        self.open = handle.getListState("open", "trace_id array<string>, span array<string>, due array<long>")
        #: Closed traces, and how long that is remembered.
        self.marks = handle.getListState("marks", "trace_id array<string>, until array<long>")
        #: The timer that is set, in milliseconds: never after the first due or until.
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        if self.timer.exists():
            if self.timer.get()[0] <= at:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    @staticmethod
    def _keep(state, rows: pd.DataFrame) -> None:
        """The state is these rows."""
        if len(rows):
            state.put([tuple(part[c].tolist() for c in part) for part in _slices(rows)])
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = {t for ids, _ in self.marks.get() for t in ids}
        least, wake = timerValues.getCurrentWatermarkInMs() + 1, []
        for part in rows:
            late = part["trace_id"].isin(closed)
            if late.any():
                yield part.loc[late, ["trace_id", "span"]].assign(late=True)
            part = part.assign(due=(part["ended_ms"] + self.gap_ms).clip(lower=least)).loc[~late, ["trace_id", "span", "due"]]
            if len(part):
                self.open.appendList([tuple(x[c].tolist() for c in x) for x in _slices(part)])
                wake.append(int(part.groupby("trace_id")["due"].max().min()))
        if wake:
            self._wake(min(wake))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        # the timer that fired is gone by itself
        self.timer.clear()
        spans, marks = _rows(self.open.get(), "trace_id", "span", "due"), _rows(self.marks.get(), "trace_id", "until")
        spans["due"] = spans.groupby("trace_id")["due"].transform("max")
        ready, over = spans["due"] <= now, marks["until"] <= now
        found, spans = spans.loc[ready, ["trace_id", "span"]], spans[~ready]
        if len(found):
            self._keep(self.open, spans)
        if len(found) or over.any():
            made = pd.DataFrame({"trace_id": found["trace_id"].unique(), "until": now + self.memory_ms})
            marks = pd.concat([marks[~over], made]) if len(made) else marks[~over]
            self._keep(self.marks, marks)
        if left := [int(x.min()) for x in (spans["due"], marks["until"]) if len(x)]:
            self._wake(min(left))
        for part in _slices(found):
            yield part.assign(late=False)

    def close(self) -> None:
        pass


def _slices(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (rows.iloc[k : k + SLICE] for k in range(0, len(rows), SLICE))


def _rows(held, *columns: str) -> pd.DataFrame:
    """The rows of a list state, whose values hold a list for each column."""
    lists = list(zip(*held)) or [()] * len(columns)
    return pd.DataFrame({c: pd.Series(list(chain.from_iterable(x)), dtype="int64" if c in ("due", "until") else object) for c, x in zip(columns, lists)})


def _ms(spark: SparkSession, text: str) -> int:
    return spark.sql(f"SELECT timestampdiff(MILLISECOND, timestamp '1970-01-01 00:00:00', timestamp '1970-01-01 00:00:00' + interval '{text}')").first()[0]


@contextmanager
def in_rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; a query takes the setting when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def close(spans: DataFrame, ended: str = "ended", gap: str = "10 minutes", late: str = "5 minutes", memory: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """The streaming ``spans`` (with trace_id) of closed traces, all of a trace in one batch, with ``late``: whether a
    span came after its trace was closed.

    Its query is started :func:`in_rocks`.  Spans without trace_id or end are no part of any trace and are left out.
    """
    spark = spans.sparkSession
    kind = spans.schema.simpleString()
    own = [F.col(f"`{c}`") for c in spans.columns]
    rows = spans.where(F.col("trace_id").isNotNull() & F.col(ended).isNotNull()).select(
        "trace_id", F.col(ended).cast("timestamp").alias("ended_at"), F.to_json(F.struct(*own), TIME).alias("span")
    )
    rows = rows.withWatermark("ended_at", late).withColumn("ended_ms", F.unix_millis("ended_at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets)))
    out = rows.groupBy("bucket").transformWithStateInPandas(Closing(_ms(spark, gap), _ms(spark, memory)), OUT, "Append", "EventTime")
    return out.select(F.from_json("span", kind, TIME).alias("s"), "late").select("s.*", "late")
