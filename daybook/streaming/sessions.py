"""Timed entries by owner, as streams or tables: sessions, owners who come and fall silent, repeats dropped while they may come.

Sessions are Spark's own windows. That an owner came is told at once and that it fell silent by a timer
on event time, which takes state of one's own: the owner's open runs, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an owner in one batch that are held before they are merged.
CHUNK = 4096

Span = tuple[int, int, int]


def merged(spans: list[Span], gap: int) -> list[Span]:
    """(first, last, n) in any order -> those with at most ``gap`` between them made one, as Spark's session windows do, in order."""
    out: list[Span] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] <= gap:
            a, b, m = out[-1]
            out[-1] = a, max(b, last), m + n
        else:
            out.append((first, last, n))
    return out


class Activity(StatefulProcessor):
    """Runs of an owner's events, in microseconds; a late event may lengthen a run or join two, which then end as one."""

    def __init__(self, after: int):
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", "first bigint, last bigint, n bigint")

    def _due(self, span: Span) -> int:
        """In milliseconds, never before the time is over."""
        return -(-(span[1] + self.after) // 1000)

    def _hold(self, spans: list[Span]) -> None:
        if spans:
            self.open.put(spans)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(s) for s in self.open.get()]
        now = list(before)
        for r in rows:
            now.append((r.us, r.us, 1))
            if len(now) > len(before) + CHUNK:
                now = merged(now, self.after)
        now = merged(now, self.after)
        old, new = {self._due(s) for s in before}, {self._due(s) for s in now}
        for t in old - new:
            self.handle.deleteTimer(t)
        for t in new - old:
            self.handle.registerTimer(t)
        self._hold(now)
        for first, last, _ in now:
            if not any(first <= s[0] <= last for s in before):
                yield Row(owner=key[0], status="active", us=first, n=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, held = expiredTimerInfo.getExpiryTimeInMs(), [tuple(s) for s in self.open.get()]
        self._hold([s for s in held if self._due(s) > due])
        for s in held:
            if self._due(s) <= due:
                yield Row(owner=key[0], status="silent", us=s[1] + self.after, n=s[2])


def _timed(events: DataFrame, late: str, owner: str, ts: str) -> DataFrame:
    rows = events.where(F.col(owner).isNotNull() & F.col(ts).isNotNull())
    if events.isStreaming:
        return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows if events.schema[ts].dataType.simpleString().startswith("timestamp") else rows.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())


def _micros(spark: SparkSession, width: str) -> int:
    """The width of an interval of fixed length, '90 minutes' say."""
    return spark.range(1).select(F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00Z' + INTERVAL {width})")).first()[0]


def sessions(events: DataFrame, *totals: Column, gap: str = "1 hour", late: str = "2 hours", owner: str = "user_id", ts: str = "ts") -> DataFrame:
    """owner, start, until, n and ``totals`` of each run of an owner's events at most ``gap`` apart; ``until`` is the last event and the gap.

    Of a stream a session is told once the watermark passes its end; events behind the watermark are dropped. Rows without an owner or a time are none.
    """
    by = _timed(events, late, owner, ts).groupBy(F.col(owner).alias("owner"), F.session_window(ts, gap).alias("w"))
    out = by.agg(F.count("*").alias("n"), *totals)
    return out.select("owner", F.col("w.start").alias("start"), F.col("w.end").alias("until"), *out.columns[2:])


def activity(events: DataFrame, after: str = "1 day", late: str = "2 hours", owner: str = "user_id", ts: str = "ts") -> DataFrame:
    """owner, status, at, n: 'active' at the first event after a silence of more than ``after``, 'silent' that long after the last one, n events in between.

    Of a stream 'active' is told at once, with n 0, and 'silent' once the watermark has passed it. Where a late event joins two runs of
    which both were told of, the 'silent' between them is never told, so one 'active' may follow another. Of a table all runs
    have ended. Rows without an owner or a time are none.
    """
    spark, rows = events.sparkSession, _timed(events, late, owner, ts)
    if not events.isStreaming:
        w = rows.groupBy(F.col(owner).alias("owner"), F.session_window(ts, after).alias("w")).agg(F.count("*").alias("n"))
        told = lambda status, at, n: F.struct(F.lit(status).alias("status"), at.alias("at"), n.cast("long").alias("n"))
        return w.select("owner", F.inline(F.array(told("active", F.col("w.start"), F.lit(0)), told("silent", F.col("w.end"), F.col("n")))))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[owner].dataType.simpleString()
    timed = rows.select(F.col(owner).alias("owner"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"))
    found = timed.groupBy("owner").transformWithState(Activity(_micros(spark, after)), f"owner {kind}, status string, us bigint, n bigint", "Append", "EventTime")
    return found.select("owner", "status", F.timestamp_micros("us").alias("at"), "n")


def once(events: DataFrame, keys: list[str], late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Of a stream, the first row of each key; a key is forgotten once the watermark has passed it, so state doesn't grow for ever."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
