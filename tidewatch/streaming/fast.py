"""The fast axis as a stream, and detect-once over a stream of findings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import Source
from ..operators import stats
from ..plans.cycle import fast_events
from ..scratch import scope


def trailing_window_stats(history: DataFrame, window_secs: int, slide_secs: int, delay_secs: int) -> DataFrame:
    """(itemid, window, mean, cnt, max_value) of sliding windows over a stream of samples; samples later than
    `delay_secs` are dropped."""
    rows = history.withColumn("ts", F.timestamp_seconds("clock")).withWatermark("ts", f"{delay_secs} seconds")
    window = F.window("ts", f"{window_secs} seconds", f"{slide_secs} seconds")
    return rows.groupBy("itemid", window.alias("window")).agg(F.avg("value").alias("mean"), F.count("value").alias("cnt"), F.max("value").alias("max_value"))


class _Once(StatefulProcessor):
    """Findings of one item, in the order of their clocks whatever the order of their arrival: each is judged when the watermark
    has passed it, and what was recorded is forgotten when its time has passed."""

    def __init__(self, keep_secs: int):
        self.keep = keep_secs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "clock long")
        self.last = handle.getValueState("last", "clock long")

    def handleInputRows(self, key, rows, timerValues):
        clocks = sorted({int(c) for part in rows for c in part["clock"]})
        self.pending.appendList([(c,) for c in clocks])
        for c in clocks:
            self.handle.registerTimer(c * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        waiting = sorted({c for (c,) in self.pending.get()}) if self.pending.exists() else []
        last, new = self.last.get()[0] if self.last.exists() else None, []
        for c in (c for c in waiting if c <= now):
            if last is None or c - last > self.keep:
                last = c
                new.append(c)
                self.handle.registerTimer((c + self.keep + 1) * 1000)
        rest = [(c,) for c in waiting if c > now]
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        if last is not None and now - last > self.keep:
            self.last.clear()
        elif new:
            self.last.update((last,))
        if new:
            yield pd.DataFrame({"itemid": [key[0]] * len(new), "clock": new})

    def close(self) -> None:
        pass


def record_once(findings: DataFrame, keep_secs: int, delay_secs: int) -> DataFrame:
    """(itemid, clock) of the findings of a stream that are more than `keep_secs` after the last one recorded of their item, as
    backtest.record_once() has them: findings may arrive out of order by `delay_secs`, and come out when the watermark has
    passed them. An item's state goes `keep_secs` after its record. Sets the session's state store to RocksDB, which this
    needs."""
    findings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = findings.select("itemid", "clock", F.timestamp_seconds("clock").alias("ts")).withWatermark("ts", f"{delay_secs} seconds")
    return rows.groupBy("itemid").transformWithStateInPandas(_Once(keep_secs), "itemid long, clock long", "Append", "EventTime")


def detect_once(findings: DataFrame, keep_secs: int) -> DataFrame:
    """Each item's first finding; it is forgotten when the watermark is `keep_secs` past it. record_once() counts from the record."""
    rows = findings.withColumn("ts", F.timestamp_seconds("clock")).withWatermark("ts", f"{keep_secs} seconds")
    return rows.dropDuplicatesWithinWatermark(["itemid"]).drop("ts")


def start_fast_axis(ticks: DataFrame, history: Callable[[int, int], DataFrame], items: DataFrame, hours: DataFrame | None, cfg: Source, emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Runs the fast plan for the newest clock of every micro-batch of `ticks` (a stream with clock).

    `history(start, end)` gives the samples of a window, `emit(events, endep)` takes the result; a batch that is run
    again after a failure gives the same events.
    """

    def batch(df: DataFrame, _: int) -> None:
        endep = df.agg(F.max("clock")).first()[0]
        if endep is not None:
            span = stats.in_range(history(endep - cfg.fast_detect.history_span_secs, endep), endep - cfg.fast_detect.history_span_secs, endep)
            with scope():  # the batch's tables go with it
                emit(fast_events(span, items, hours, None, cfg, endep)[0], endep)

    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
