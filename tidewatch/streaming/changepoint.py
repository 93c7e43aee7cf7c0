"""Change points of a stream: both CUSUM statistics of every item as state, updated in the order of the samples' clocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Changepoint
from ..functions.scalar import score_ramp


class _Cusum(StatefulProcessor):
    """Samples wait until the watermark has passed them, then move the sums; what is kept are these, the clocks that their runs
    began at, and the samples that wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "clock long, dev double, slack double")
        self.sums = handle.getValueState("sums", "up double, down double, top double, u long, d long")

    def handleInputRows(self, key, rows, timerValues):
        got = sorted({(int(c), float(d), float(s)) for part in rows for c, d, s in zip(part["clock"], part["dev"], part["slack"])})
        self.waiting.appendList(got)
        for clock in {c for c, _, _ in got}:
            self.handle.registerTimer(clock * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        if not due:
            return
        up, down, top, u, d = tuple(self.sums.get()) if self.sums.exists() else (0.0, 0.0, 0.0, None, None)
        out = []
        for clock, dev, slack in due:
            u, d = (clock if up == 0 else u), (clock if down == 0 else d)
            up, down = max(0.0, up + dev - slack), max(0.0, down - dev - slack)
            s = max(up, down)
            top = max(top, s)
            out.append((key[0], clock, s, top, (u if up >= down else d) if s > 0 else None))
        self.sums.update((up, down, top, u, d))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["itemid", "clock", "s", "s_max", "onset"]).astype({"onset": "Int64"})

    def close(self) -> None:
        pass


def changepoint_stream(samples: DataFrame, base: DataFrame, cfg: Changepoint, delay_secs: int) -> DataFrame:
    """(itemid, clock, s, s_max, onset, score) after each sample of a stream: detectors.changepoint_scores() as of then (null below
    the decision) and where the present run began, whatever order samples arrive in within `delay_secs`.

    `base` has itemid, t_mean, sigma and w, an item's interval against the reference interval. Sets the session's state store
    to RocksDB, which this needs.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = base.where("sigma > 0").select("itemid", "t_mean", "sigma", "w")
    rows = samples.where("value is not null").withColumn("ts", F.timestamp_seconds("clock")).withWatermark("ts", f"{delay_secs} seconds").join(known, "itemid")
    moved = rows.select("itemid", "clock", "ts", ((F.col("value") - F.col("t_mean")) * F.col("w")).alias("dev"), (cfg.cusum_k * F.col("sigma") * F.col("w")).alias("slack"))
    path = moved.groupBy("itemid").transformWithStateInPandas(_Cusum(), "itemid long, clock long, s double, s_max double, onset long", "Append", "EventTime")
    decision = cfg.cusum_h * F.col("sigma")
    score = F.when(F.col("s_max") >= decision, score_ramp(F.col("s_max"), decision))
    return path.join(known.select("itemid", "sigma"), "itemid").select("itemid", "clock", "s", "s_max", "onset", score.alias("score"))
