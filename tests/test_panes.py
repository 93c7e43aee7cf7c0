import numpy as np
from pyspark.sql import functions as F

from tidewatch import config, schemas
from tidewatch.operators import panes, stats
from tidewatch.plans import cycle
from tidewatch.sources.stores import DayTable, Paned, Stores

DAY = 86400


def rows_of(n_items, n_days, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n_items):
        for h in range(24 * n_days):
            if rng.random() < 0.8:
                v = float(rng.choice([0.0, 1e6 + rng.normal(0, 1e-2), rng.normal(0, 5), float("nan")], p=[0.1, 0.3, 0.55, 0.05]))
                out.append((i, h * 3600 + int(rng.integers(0, 3)) * 600, v - 1, v, v + float(rng.random())))
    return out


def close(got, want):
    assert got.keys() == want.keys() and len(got) > 0
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b)), (k, got[k], want[k])


def test_windows_from_panes_after_random_arrivals(spark, tmp_path):
    """Late rows, corrected rows and repeated calls: the statistics of all rows, only touched days made anew."""
    data = rows_of(5, 4, 1)
    rng = np.random.default_rng(2)
    order = rng.permutation(len(data))
    paned = Paned(DayTable(spark, f"{tmp_path}/rows", schemas.TRENDS, ["itemid", "clock"], "clock"), DayTable(spark, f"{tmp_path}/panes", schemas.PANES, ["itemid", "pane"], "pane"))
    frame = lambda some: spark.createDataFrame(some, schemas.TRENDS)
    paned.add(frame([data[k] for k in order[: len(order) // 2]]))
    paned.add(frame([(i, t, 0.0, 5.0, 9.0) for i, t, *_ in (data[k] for k in order[:40])]))
    rest = [data[k] for k in [*order[len(order) // 2 :], *order[:40]]]
    paned.add(frame(rest))
    paned.add(frame(rest[:30]))
    df = frame(data).cache()
    for start, end in ((0, 4 * DAY), (1800, 3 * DAY - 1), (DAY + 3599, 2 * DAY + 601), (7200, 7800)):
        parts = paned.within(start, end)
        cols = ["cnt", "mean", "last_clock", "zero_cnt", "max_value", "intra_std"]
        inside = stats.in_range(df, start, end)
        want = stats.window_stats(df, start, end, "value_avg").join(stats.intra_std(inside, 4.0), "itemid", "left")
        fetch = lambda d, keys, cs: {tuple(r[k] for k in keys): tuple(r[c] for c in cs) for r in d.collect()}
        close(fetch(panes.window_stats(parts, 4.0).na.fill(-1.0), ["itemid"], cols), fetch(want.na.fill(-1.0), ["itemid"], cols))
        exact = inside.where("not isnan(value_avg)").groupBy("itemid").agg(F.coalesce(F.stddev_samp("value_avg"), F.lit(0.0)).alias("std"))
        close(fetch(panes.window_stats(parts), ["itemid"], ["std"]), fetch(exact, ["itemid"], ["std"]))
        close(fetch(panes.hour_stats(parts), ["itemid", "hour_of_day"], ["mean", "std", "cnt"]), fetch(stats.hour_stats(inside), ["itemid", "hour_of_day"], ["mean", "std", "cnt"]))
    before = {d: t.versions() for d, t in paned.hours.days().items()}
    paned.add(frame([(1, DAY + 5, 1.0, 2.0, 3.0)]))
    after = {d: t.versions() for d, t in paned.hours.days().items()}
    assert {d for d in after if after[d] != before[d]} == {1}


class Trends:
    """A source of trends that grows."""

    def __init__(self, spark, rows, ids):
        self.df, self.ids, self.asked = spark.createDataFrame(rows, schemas.TRENDS), spark.createDataFrame([(i,) for i in ids], "itemid long"), []

    def get_item_ids(self, *_):
        return self.ids

    def get_trends(self, start, end, ids):
        self.asked.append((start, end))
        return stats.in_range(self.df, start, end).join(ids, "itemid", "left_semi")


def test_statistics_advance_as_they_would_be_made_anew(spark, tmp_path):
    rows = [r for r in rows_of(3, 5, 3) if not (r[0] == 2 and r[1] > DAY) and not np.isnan(r[3])]
    cfg = config.Source(trends_retention=2)
    source = Trends(spark, rows, [0, 1, 2])
    anew, kept = Stores(spark, str(tmp_path), "a"), Stores(spark, str(tmp_path), "b")
    anew.create()
    kept.create()
    for end in (2 * DAY, 2 * DAY + 5000, 4 * DAY + 1800):
        cycle.update_statistics(spark, source, anew, cfg, end)
        cycle.advance_statistics(spark, source, kept, cfg, end)
        for table, keys in (("trends_stats", ["itemid"]), ("hour_stats", ["itemid", "hour_of_day"])):
            cols = [c for c in getattr(anew, table).schema.names if c not in keys]
            got, want = ({tuple(r[k] for k in keys): tuple(-1.0 if r[c] is None else r[c] for c in cols) for r in getattr(s, table).read().collect()} for s in (kept, anew))
            assert got.keys() == want.keys()
            for k in want:
                np.testing.assert_allclose(np.array(got[k], float), np.array(want[k], float), rtol=1e-6, atol=1e-3)
    # what was there is not asked for again
    assert (2 * DAY - 7200, 2 * DAY + 5000) in source.asked
