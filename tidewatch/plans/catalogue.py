"""Every operator as a query over the driver's tables, with the same result as SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANOMALY_FILTERS, CATEGORIES, ITEM_FILTERS, Category, Changepoint, Clustering, Detectors, Duration, Ensemble, FastDetect, IdleBaseline, Magnitude, MetricCategories, Recency, RecurringPeak, Seasonal, Source, WatchRule, ZScore
from ..functions import scalar, sequence
from ..operators import cluster, detectors, evaluate, fast, filters, gates, onset, pages, panes, rules, selection, stats
from ..scratch import materialize, scratch_path
from ..sources.jdbc import JdbcSource
from ..sources.stores import Stores
from . import backtest
from . import bindings as b
from .bindings import DAY, DAYS, ENDEP, VIEWS, stats_sql, with_views
from .cycle import Inputs, detect, fast_events, hour_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
START = ENDEP - DAYS * DAY
HOUR = hour_of(ENDEP)
Z1, Z15 = ZScore(lambda_threshold=1.0), ZScore(lambda_threshold=1.5)
CAT = MetricCategories()


def query(sql: str | None = None, **views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, **views)
        return f

    return add


def r(name: str, digits: int = 9):
    return F.round(name, digits).alias(name)


class _Views:
    """The bindings of one run; frames are lazy."""

    def __init__(self, spark: SparkSession, sf: str, cut: bool = False):
        """With `cut`, for plans that start from the samples many times, samples and hours are tables."""
        table = materialize if cut else lambda df, _: df
        self.hist, self.items = table(b.history(spark, sf), "samples"), table(b.items(spark, sf), "items")
        self.trends = table(stats.hourly_trends(self.hist), "hours")
        self.recent = stats.window_stats(self.hist, ENDEP - DAY, ENDEP)
        self.base = stats.window_stats(self.trends, START, ENDEP, "value_avg")
        window = stats.in_range(self.trends, START, ENDEP)
        self.sig = self.base.join(stats.intra_std(window, 4.0), "itemid", "left")
        self.hours = stats.hour_stats(window)
        self.window = window
        self.full = stats.trend_stats(self.trends, START, ENDEP, 4.0, DAY, 2.0, DAY)


def _glob_sql(column: str, pattern: str) -> str:
    return f"{column} GLOB '{pattern}'"


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(_glob_sql('key_', p) for p in c.key_patterns)} THEN %s" for c in CATEGORIES) + " END"
CATEGORY_NAME_SQL = _CATEGORY_SQL % tuple(f"'{c.name}'" for c in CATEGORIES)
CATEGORY_WEIGHT_SQL = _CATEGORY_SQL % tuple(f"{c.weight}::DOUBLE" for c in CATEGORIES)


def _ramp_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest(0, least(1, ({x} - {lo}) / {float(hi - lo)}))"


MAGNITUDE_SQL = _CATEGORY_SQL % tuple(_ramp_sql({"relative": "delta / greatest(abs(t_mean), 1e-9)", "absolute": "delta"}[c.magnitude.mode], c.magnitude.lo, c.magnitude.hi) for c in CATEGORIES)


# --- statistics


@query("SELECT itemid, clock, round(value_min, 9) AS value_min, round(value_avg, 9) AS value_avg, round(value_max, 9) AS value_max FROM trends")
def hourly_trends_rollup(spark, sf):
    return _Views(spark, sf).trends.select("itemid", "clock", r("value_min"), r("value_avg"), r("value_max"))


_STATS = ("sum", "sqr_sum", "mean", "std", "max_value")


@query(f"SELECT itemid, cnt, last_clock, zero_cnt, {', '.join(f'round({c}, 7) AS {c}' for c in _STATS)} FROM long_", long_=stats_sql("hist", "value", START))
def window_stats(spark, sf):
    s = stats.window_stats(b.history(spark, sf), START, ENDEP)
    return s.select("itemid", "cnt", "last_clock", "zero_cnt", *(r(c, 7) for c in _STATS))


@query("SELECT itemid, round(intra_std, 9) AS intra_std FROM intra")
def intra_std(spark, sf):
    return stats.intra_std(_Views(spark, sf).window, 4.0).select("itemid", r("intra_std"))


@query("SELECT itemid, round(sigma, 9) AS sigma FROM sig")
def baseline_sigma(spark, sf):
    return _Views(spark, sf).sig.select("itemid", F.round(scalar.baseline_sigma(F.col("std"), F.col("intra_std")), 9).alias("sigma"))


@query("SELECT itemid, hour_of_day, round(mean, 9) AS mean, round(std, 9) AS std, cnt FROM hours")
def hour_of_day_stats(spark, sf):
    return _Views(spark, sf).hours.select("itemid", "hour_of_day", r("mean"), r("std"), "cnt")


def _panes(spark, sf):
    v = _Views(spark, sf, True)
    columns = ("value_avg", "value_min", "value_max")
    return panes.within(panes.partials(v.trends, *columns), v.trends, START, ENDEP, *columns)


_PANED = {"mean": 9, "std": 9, "max_value": 9, "intra_std": 9}


@query(f"SELECT itemid, cnt, last_clock, zero_cnt, {', '.join(f'round({c}, {d}) AS {c}' for c, d in _PANED.items())} FROM base JOIN intra USING (itemid)")
def pane_window_stats(spark, sf):
    """Window statistics put together from partial statistics of hours."""
    s = panes.window_stats(_panes(spark, sf), 4.0)
    return s.select("itemid", "cnt", "last_clock", "zero_cnt", *(r(c, d) for c, d in _PANED.items()))


@query("SELECT itemid, hour_of_day, round(mean, 9) AS mean, round(std, 9) AS std, cnt FROM hours")
def pane_hour_stats(spark, sf):
    return panes.hour_stats(_panes(spark, sf)).select("itemid", "hour_of_day", r("mean"), r("std"), "cnt")


@query("SELECT itemid, interval FROM spacing")
def sample_interval(spark, sf):
    return stats.sample_interval(b.history(spark, sf), 600)


@query("SELECT CASE WHEN m >= 1 THEN floor(m) ELSE 600 END::BIGINT AS unit FROM (SELECT quantile_cont(gap, 0.5) AS m FROM (SELECT itemid, quantile_cont(gap, 0.5) AS gap FROM gaps WHERE gap IS NOT NULL GROUP BY itemid))")
def grid_unit(spark, sf):
    return stats.grid_unit(b.history(spark, sf))


@query("SELECT itemid, round(quantile_cont(gap, 0.5), 9) AS gap FROM gaps WHERE gap IS NOT NULL GROUP BY itemid")
def selected_median_gaps(spark, sf):
    """Median gaps of items of any number of samples."""
    rows = b.history(spark, sf).select("itemid", sequence.gap().alias("gap"))
    return selection.exact_quantile(rows, ["itemid"], "gap").select("itemid", F.round("quantile", 9).alias("gap"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 9) AS quantile FROM ev WHERE value IS NOT NULL GROUP BY event_type")
def value_quantiles(spark, sf):
    """A high quantile of all samples of a type, whose values hardly repeat: few groups of many values."""
    return selection.exact_quantile(b.raw_events(spark, sf), ["event_type"], "value", 0.9, 1000).select("event_type", r("quantile"))


PEAK_SQL = {
    "peak_rows": f"SELECT itemid, clock, value_max AS x, avg(value_max) OVER (PARTITION BY itemid ORDER BY clock RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS trail, clock - min(clock) OVER (PARTITION BY itemid) >= {DAY} AS whole, coalesce(sigma > 0 AND value_max >= mean + 2.0 * sigma, false) AS hot FROM trends LEFT JOIN sig USING (itemid) WHERE clock >= {START} AND clock < {ENDEP - DAY}",
    "peak_marks": "SELECT *, hot AND NOT coalesce(lag(hot) OVER (PARTITION BY itemid ORDER BY clock), false) AS begins FROM peak_rows",
    "peaks": "SELECT itemid, coalesce(max(trail) FILTER (whole), max(trail)) AS local_peak, count(*) FILTER (begins)::BIGINT AS peak_episodes FROM peak_marks GROUP BY itemid",
}


@query("SELECT itemid, round(local_peak, 9) AS local_peak, peak_episodes FROM peaks", **PEAK_SQL)
def recurring_peaks(spark, sf):
    v = _Views(spark, sf)
    return stats.peak_stats(v.window, v.sig, DAY, 2.0, ENDEP - DAY).select("itemid", r("local_peak"), "peak_episodes")


@query(f"SELECT itemid, last_clock >= {ENDEP - 12 * 3600} AS fresh FROM recent")
def stale_items(spark, sf):
    fresh, stale = stats.split_stale(_Views(spark, sf).recent, ENDEP, 12 * 3600)
    return fresh.select("itemid", F.lit(True).alias("fresh")).unionByName(stale.withColumn("fresh", F.lit(False)))


@query(f"SELECT itemid, round(median(value_avg), 9) AS level FROM (SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY clock DESC) AS rn FROM trends) WHERE rn <= 3 GROUP BY itemid")
def recent_level(spark, sf):
    return stats.recent_level(_Views(spark, sf).trends, 3).select("itemid", r("level"))


# --- rules


@query(f"SELECT itemid, key_, {CATEGORY_NAME_SQL} AS category, {CATEGORY_WEIGHT_SQL} AS weight FROM items")
def metric_category(spark, sf):
    i = scalar.category_index(F.col("key_"), CATEGORIES)
    return b.items(spark, sf).select("itemid", "key_", scalar.category_name(i, CAT).alias("category"), scalar.category_weight(i, CAT).alias("weight"))


_INDEX_SQL = _CATEGORY_SQL % tuple(range(len(CATEGORIES)))


@query(f"SELECT key_ AS key, any_value({_INDEX_SQL})::INTEGER AS rule FROM items GROUP BY key_ HAVING any_value({_INDEX_SQL}) IS NOT NULL")
def rules_as_a_table(spark, sf):
    """The categories' globs as a table that keys are joined with."""
    globs = [(i, p) for i, c in enumerate(CATEGORIES) for p in c.key_patterns]
    return rules.first_rule(b.items(spark, sf).select(F.col("key_").alias("key")), rules.rule_table(spark, globs))


def _rule_sql(rule) -> str:
    parts = ([_glob_sql("key_", rule.key_pattern)] if rule.key_pattern else []) + ([f"units = '{rule.units}'"] if rule.units else [])
    return " AND ".join(parts) or "true"


_ITEM_DROP = " OR ".join(f"coalesce({_rule_sql(x)} AND {'true' if x.min_value is None else f'recent.mean < {x.min_value}'}, false)" for x in ITEM_FILTERS)


@query(f"SELECT DISTINCT hist.itemid FROM hist LEFT JOIN items USING (itemid) LEFT JOIN recent USING (itemid) WHERE NOT coalesce(key_ IS NOT NULL AND ({_ITEM_DROP}), false)")
def item_filters(spark, sf):
    v = _Views(spark, sf)
    return filters.apply_item_filters(v.hist.select("itemid").distinct(), v.items, v.recent, ITEM_FILTERS)


ZSCORE_VIEW = "SELECT itemid, least((z - {l}) / {l} * 0.5 + 0.5, 1) AS score, z, h_mean, t_mean FROM (SELECT itemid, {r}.mean AS h_mean, base.mean AS t_mean, abs({r}.mean - base.mean) / base.std AS z FROM {r} JOIN base USING (itemid) WHERE base.std > 0 AND (base.mean = 0 OR abs({r}.mean - base.mean) / abs(base.mean) > 0.05)) WHERE z >= {l}"
SEASONAL_VIEW = "SELECT itemid, least((z - {l}) / {l} * 0.5 + 0.5, 1) AS score, z FROM (SELECT itemid, abs(recent.mean - hours.mean) / hours.std AS z FROM recent JOIN hours USING (itemid) WHERE hour_of_day = {h} AND hours.std > 0) WHERE z >= {l}"
VIEWS |= {
    "z1": ZSCORE_VIEW.format(l=1.0, r="recent"),
    "z15": ZSCORE_VIEW.format(l=1.5, r="recent"),
    "zb": ZSCORE_VIEW.format(l=1.0, r="before"),
    "s1": SEASONAL_VIEW.format(l=1.0, h=HOUR),
    "spacing2": f"SELECT itemid, greatest(round_even(coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 600), 0)::BIGINT, 1) AS interval FROM (SELECT itemid, clock - lag(clock) OVER (PARTITION BY itemid ORDER BY clock) AS gap FROM hist WHERE clock > {ENDEP - 2 * DAY}) GROUP BY itemid",
    "dev": "SELECT itemid, row_number() OVER (PARTITION BY itemid ORDER BY clock) AS rn, (value - mean) * interval / 600 AS d, 0.5 * sigma * interval / 600 AS slack, sigma FROM hist JOIN sig USING (itemid) JOIN spacing2 USING (itemid) WHERE sigma > 0 AND clock > " + str(ENDEP - 2 * DAY),
    "walk": "SELECT itemid, rn, greatest(0, d - slack) AS up, greatest(0, -d - slack) AS down, sigma FROM dev WHERE rn = 1 UNION ALL SELECT dev.itemid, dev.rn, greatest(0, up + d - slack), greatest(0, down - d - slack), dev.sigma FROM walk JOIN dev ON dev.itemid = walk.itemid AND dev.rn = walk.rn + 1",
    "cp": "SELECT itemid, least((s_max - 5.0 * sigma) / (5.0 * sigma) * 0.5 + 0.5, 1) AS score, s_max FROM (SELECT itemid, max(greatest(up, down)) AS s_max, any_value(sigma) AS sigma FROM walk GROUP BY itemid) WHERE s_max >= 5.0 * sigma",
    "votes": "SELECT itemid, 0.3 AS w, score FROM z1 UNION ALL SELECT itemid, 0.4, score FROM s1 UNION ALL SELECT itemid, 0.3, score FROM cp",
    "ens": "SELECT itemid, sum(score * w) / sum(w) AS score, count(*) AS n FROM votes WHERE score > 0 GROUP BY itemid HAVING count(*) >= 2",
}


def _changepoints(v: _Views) -> DataFrame:
    """CUSUM over the last two days."""
    return detectors.changepoint_scores(v.hist.where(F.col("clock") > ENDEP - 2 * DAY), v.sig, Changepoint(), 600)


@query(f"SELECT z1.itemid, round(score, 9) AS score FROM z1 LEFT JOIN items USING (itemid) LEFT JOIN recent USING (itemid) LEFT JOIN base USING (itemid) WHERE NOT coalesce(key_ IS NOT NULL AND ({' OR '.join(f'coalesce(({_rule_sql(x)}) AND abs(coalesce(recent.mean, 0) - coalesce(base.mean, 0)) < {x.min_abs_diff}, false)' for x in ANOMALY_FILTERS)}), false)")
def anomaly_filters(spark, sf):
    v = _Views(spark, sf)
    s = detectors.zscore_scores(v.recent, v.base, Z1).select("itemid", r("score"))
    return filters.apply_anomaly_filters(s, v.items, v.recent, v.base, ANOMALY_FILTERS)


@query("SELECT itemid, group_name, host_name FROM items WHERE (key_ GLOB 'system.cpu*' AND true) OR (key_ GLOB 'net.*' AND host_name GLOB '*A*')")
def watchlist(spark, sf):
    return filters.watchlist(b.items(spark, sf), (WatchRule("system.cpu*", ""), WatchRule("net.*", "*A*"))).select("itemid", "group_name", "host_name")


@query("SELECT CASE WHEN score >= 0.5 THEN 'high' WHEN score > 0.1 THEN 'mid' ELSE 'low' END AS band, count(*)::BIGINT AS n FROM (SELECT itemid, coalesce(score, 0) AS score FROM base LEFT JOIN z1 USING (itemid)) GROUP BY 1")
def score_bands(spark, sf):
    v = _Views(spark, sf)
    s = v.base.select("itemid").join(detectors.zscore_scores(v.recent, v.base, Z1), "itemid", "left").fillna({"score": 0.0})
    return s.groupBy(filters.score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


# --- detectors and onsets

_Z = "itemid, round(score, 9) AS score, round(z, 9) AS z"


@query(f"SELECT {_Z}, round(h_mean, 9) AS h_mean, round(t_mean, 9) AS t_mean FROM z15")
def zscore_scores(spark, sf):
    v = _Views(spark, sf)
    return detectors.zscore_scores(v.recent, v.base, Z15).select("itemid", r("score"), r("z"), r("h_mean"), r("t_mean"))


@query(f"SELECT {_Z} FROM s1")
def seasonal_scores(spark, sf):
    v = _Views(spark, sf)
    return detectors.seasonal_scores(v.recent, v.hours, HOUR, Seasonal(lambda_threshold=1.0)).select("itemid", r("score"), r("z"))


@query("SELECT itemid, round(score, 9) AS score, round(s_max, 4) AS s_max FROM cp")
def changepoint_scores(spark, sf):
    return _changepoints(_Views(spark, sf)).select("itemid", r("score"), r("s_max", 4))


CUSUM_SQL = {
    "cdev": f"SELECT itemid, clock, row_number() OVER (PARTITION BY itemid ORDER BY clock) AS rn, (value - mean) * interval / 600 AS d, 0.5 * sigma * interval / 600 AS slack FROM hist JOIN sig USING (itemid) JOIN spacing2 USING (itemid) WHERE sigma > 0 AND clock > {ENDEP - 2 * DAY}",
    "cwalk": "SELECT itemid, rn, clock, greatest(0, d - slack) AS up, greatest(0, -d - slack) AS down, clock AS u, clock AS v FROM cdev WHERE rn = 1 UNION ALL SELECT c.itemid, c.rn, c.clock, greatest(0, up + d - slack), greatest(0, down - d - slack), CASE WHEN up = 0 THEN c.clock ELSE u END, CASE WHEN down = 0 THEN c.clock ELSE v END FROM cwalk JOIN cdev c ON c.itemid = cwalk.itemid AND c.rn = cwalk.rn + 1",
}


@query("SELECT itemid, clock, round(greatest(up, down), 4) AS s, round(max(greatest(up, down)) OVER (PARTITION BY itemid ORDER BY clock), 4) AS s_max, CASE WHEN greatest(up, down) > 0 THEN CASE WHEN up >= down THEN u ELSE v END END AS onset FROM cwalk", **CUSUM_SQL)
def cusum_path(spark, sf):
    """Both CUSUM statistics after every sample, and where their runs began."""
    v = _Views(spark, sf)
    history = v.hist.where(F.col("clock") > ENDEP - 2 * DAY)
    base = v.sig.select("itemid", F.col("mean").alias("t_mean"), scalar.baseline_sigma(F.col("std"), F.col("intra_std")).alias("sigma")).where("sigma > 0")
    rows = history.join(base, "itemid").join(stats.sample_interval(history, 600).select("itemid", (F.col("interval") / 600).alias("w")), "itemid")
    path = sequence.cusum_path(rows, (F.col("value") - F.col("t_mean")) * F.col("w"), 0.5 * F.col("sigma") * F.col("w"))
    return path.select("itemid", "clock", r("s", 4), r("s_max", 4), "onset")


def _ensemble(v: _Views) -> DataFrame:
    found = {"zscore": detectors.zscore_scores(v.recent, v.base, Z1), "seasonal": detectors.seasonal_scores(v.recent, v.hours, HOUR, Seasonal(lambda_threshold=1.0)), "changepoint": _changepoints(v)}
    return detectors.ensemble_scores(found, {"zscore": 0.3, "changepoint": 0.3, "seasonal": 0.4}, Ensemble(min_score=0.7, require_any=2))


@query("SELECT itemid, round(score, 9) AS score, n::BIGINT AS n_detectors, round(score, 9) >= 0.7 AS is_anomaly FROM ens")
def ensemble_scores(spark, sf):
    return _ensemble(_Views(spark, sf)).select("itemid", r("score"), "n_detectors", (F.round("score", 9) >= 0.7).alias("is_anomaly"))


LEVEL_SQL = {
    "lv": "SELECT itemid, median(value_avg) AS level FROM (SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY clock DESC) AS rn FROM trends) WHERE rn <= 3 GROUP BY itemid",
    "bd": "SELECT itemid, level, CASE WHEN 0.1 * abs(level) > 0 THEN 0.1 * abs(level) ELSE 2.0 * std END AS band FROM lv LEFT JOIN base USING (itemid)",
    "lrows": "SELECT itemid, clock, row_number() OVER (PARTITION BY itemid ORDER BY clock DESC) AS rn, abs(value_avg - level) > band AS far FROM trends JOIN bd USING (itemid) WHERE band > 0",
    "lwalk": "SELECT itemid, rn, far::INTEGER AS run FROM lrows WHERE rn = 1 UNION ALL SELECT lrows.itemid, lrows.rn, CASE WHEN far THEN run + 1 ELSE 0 END FROM lwalk JOIN lrows ON lrows.itemid = lwalk.itemid AND lrows.rn = lwalk.rn + 1 WHERE run <= 2",
    "lstop": "SELECT itemid, max(rn) - CASE WHEN max(run) = 3 THEN 3 ELSE 0 END AS pos FROM lwalk GROUP BY itemid",
    "level_on": "SELECT itemid, clock AS onset FROM lstop JOIN lrows USING (itemid) WHERE rn = pos",
}
ANOMALY_SQL = {
    "steps": f"SELECT itemid, k, {ENDEP} - 3600 * k AS t FROM (SELECT DISTINCT itemid FROM trends WHERE clock > {ENDEP - 49 * 3600 - DAY + 3600} AND clock <= {ENDEP}), range(49) AS g(k)",
    "means": f"SELECT steps.itemid, k, t, avg(value_avg) AS x FROM steps LEFT JOIN trends ON trends.itemid = steps.itemid AND clock > t - {DAY} AND clock <= t GROUP BY ALL",
    "hots": "SELECT means.itemid, k, x, coalesce((base.std > 0 AND abs(x - base.mean) / base.std >= 1.0) OR (hours.std > 0 AND abs(x - hours.mean) / hours.std >= 1.0), false) AS hot FROM means LEFT JOIN base ON base.itemid = means.itemid LEFT JOIN hours ON hours.itemid = means.itemid AND hour_of_day = (t % 86400) // 3600",
    "awalk": "SELECT itemid, k, 0 AS cold, k AS last FROM hots WHERE k = 0 AND hot UNION ALL SELECT h.itemid, h.k, CASE WHEN hot THEN 0 ELSE cold + 1 END, CASE WHEN hot THEN h.k ELSE last END FROM awalk JOIN hots h ON h.itemid = awalk.itemid AND h.k = awalk.k + 1 WHERE x IS NOT NULL AND cold + (NOT hot)::INTEGER <= 2",
    "anomaly_on": f"SELECT itemid, {ENDEP} - 3600 * max(last) AS onset FROM awalk GROUP BY itemid",
}


def _level(v):
    return onset.level_onset(v.trends, v.base)


def _began(v):
    return onset.anomaly_onset(v.trends, v.base, v.hours, ENDEP, DAY, 1.0, 1.0)


@query("SELECT itemid, onset FROM level_on", **LEVEL_SQL)
def level_onset(spark, sf):
    return _level(_Views(spark, sf))


@query("SELECT itemid, onset FROM anomaly_on", **ANOMALY_SQL)
def anomaly_onset(spark, sf):
    return _began(_Views(spark, sf))


# --- gates

MAG = {"mg": f"SELECT itemid, key_, {MAGNITUDE_SQL} AS magnitude FROM (SELECT z1.itemid, key_, abs(h_mean - t_mean) AS delta, t_mean FROM z1 JOIN items USING (itemid))"}


@query("SELECT itemid, round(magnitude, 9) AS magnitude FROM mg", **MAG)
def gate_magnitude(spark, sf):
    v = _Views(spark, sf)
    s = detectors.zscore_scores(v.recent, v.base, Z1).join(v.items, "itemid").join(v.base.select("itemid", "std"), "itemid")
    gate = gates.magnitude_gate(scalar.category_index(F.col("key_"), CATEGORIES), CAT, F.abs(F.col("h_mean") - F.col("t_mean")), F.col("t_mean"), F.col("std"))
    return s.select("itemid", F.round(gate, 9).alias("magnitude"))


_DUR = {
    "drow": f"SELECT itemid, clock, abs(value - mean) > 2.0 * sigma AS hit, row_number() OVER (PARTITION BY itemid ORDER BY clock) AS rn FROM hist JOIN sig USING (itemid) WHERE sigma > 0 AND clock BETWEEN {ENDEP - DAY} AND {ENDEP}",
    "dspace": f"SELECT itemid, greatest(round_even(coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 600), 0)::BIGINT, 1) AS interval FROM (SELECT itemid, clock - lag(clock) OVER (PARTITION BY itemid ORDER BY clock) AS gap FROM hist WHERE clock BETWEEN {ENDEP - DAY} AND {ENDEP}) GROUP BY itemid",
    "dcount": "SELECT itemid, count(*) FILTER (hit) AS n FROM drow GROUP BY itemid",
    "drun": "SELECT itemid, rn, hit::INTEGER AS run FROM drow WHERE rn = 1 UNION ALL SELECT drow.itemid, drow.rn, CASE WHEN hit THEN run + 1 ELSE 0 END FROM drun JOIN drow ON drow.itemid = drun.itemid AND drow.rn = drun.rn + 1",
    "dlong": "SELECT itemid, max(run) AS n FROM drun GROUP BY itemid",
}


def _duration(spark, sf, measure):
    v = _Views(spark, sf)
    return gates.duration_gate(stats.in_range(v.hist, ENDEP - DAY, ENDEP), v.sig, Duration(measure=measure, hi_secs=36000), 600).select("itemid", r("duration"))


@query(f"SELECT itemid, round({_ramp_sql('n * interval', 600, 36000)}, 9) AS duration FROM dcount JOIN dspace USING (itemid)", **_DUR)
def gate_duration(spark, sf):
    return _duration(spark, sf, "count")


@query(f"SELECT itemid, round({_ramp_sql('n * interval', 600, 36000)}, 9) AS duration FROM dlong JOIN dspace USING (itemid)", **_DUR)
def gate_duration_consecutive(spark, sf):
    return _duration(spark, sf, "consecutive")


@query("SELECT itemid, CASE WHEN zero_cnt / cnt >= 0.8 AND r.mean <= max_value THEN 0.0 ELSE 1.0 END::DOUBLE AS idle FROM izero JOIN irecent r USING (itemid)", izero=stats_sql("idle_hist", "value", START).replace("SELECT *,", "SELECT itemid, zero_cnt, cnt, max_value,", 1), irecent=stats_sql("idle_hist", "value", ENDEP - DAY).replace("SELECT *,", "SELECT itemid,", 1))
def gate_idle(spark, sf):
    h = b.idle_history(spark, sf)
    long_, short = stats.window_stats(h, START, ENDEP), stats.window_stats(h, ENDEP - DAY, ENDEP).select("itemid", F.col("mean").alias("recent"))
    return long_.join(short, "itemid").select("itemid", gates.idle_gate(F.col("recent"), F.col("zero_cnt"), F.col("cnt"), F.col("max_value"), IdleBaseline()).alias("idle"))


@query("SELECT itemid, CASE WHEN recent.mean > base.mean AND peak_episodes >= 1 AND recent.mean <= local_peak THEN 0.0 ELSE 1.0 END::DOUBLE AS peak FROM recent JOIN base USING (itemid) JOIN peaks USING (itemid)", **PEAK_SQL)
def gate_peak(spark, sf):
    v = _Views(spark, sf)
    j = v.recent.select("itemid", F.col("mean").alias("recent")).join(v.full.where("local_peak is not null"), "itemid")
    return j.select("itemid", gates.peak_gate(F.col("recent"), F.col("mean"), F.col("local_peak"), F.col("peak_episodes"), RecurringPeak(min_episodes=1)).alias("peak"))


@query(f"SELECT itemid, CASE WHEN {ENDEP} - onset > 14400 THEN 0.0 ELSE 1.0 END::DOUBLE AS recency FROM base LEFT JOIN anomaly_on USING (itemid)", **ANOMALY_SQL)
def gate_recency(spark, sf):
    v = _Views(spark, sf)
    return v.base.select("itemid").join(_began(v), "itemid", "left").select("itemid", gates.recency_gate(F.col("onset"), ENDEP, 14400, Recency()).alias("recency"))


def _gated(v: _Views, cfg: MetricCategories = MetricCategories(recurring_peak=RecurringPeak(min_episodes=1), duration=Duration(hi_secs=36000))) -> DataFrame:
    s = detectors.zscore_scores(v.recent, v.base, Z1).select("itemid", "score")
    return gates.apply_gates(s, v.items, v.recent, v.full, cfg, 0.4, stats.in_range(v.hist, ENDEP - DAY, ENDEP), 600, _began(v), ENDEP, 30 * 3600)


GATED_SQL = {
    **MAG, **_DUR, **PEAK_SQL, **ANOMALY_SQL,
    "gt": f"""SELECT z1.itemid, z1.score AS raw_score, h_mean, t_mean, {CATEGORY_WEIGHT_SQL.replace('key_', 'items.key_')} AS weight, {CATEGORY_NAME_SQL.replace('key_', 'items.key_')} AS category, coalesce(magnitude, 1) AS magnitude, coalesce({_ramp_sql('n * interval', 600, 36000)}, 1) AS duration,
CASE WHEN base.zero_cnt / base.cnt >= 0.8 AND h_mean <= base.max_value THEN 0 ELSE 1 END AS idle, CASE WHEN h_mean > t_mean AND peak_episodes >= 1 AND h_mean <= local_peak THEN 0 ELSE 1 END AS peak, CASE WHEN {ENDEP} - onset > 108000 THEN 0 ELSE 1 END AS recency
FROM z1 LEFT JOIN items USING (itemid) LEFT JOIN mg USING (itemid) LEFT JOIN base USING (itemid) LEFT JOIN dcount USING (itemid) LEFT JOIN dspace USING (itemid) LEFT JOIN peaks USING (itemid) LEFT JOIN anomaly_on USING (itemid)""",
    "gated": "SELECT *, raw_score * weight * magnitude * duration * idle * peak * recency AS score FROM gt",
}


@query("SELECT itemid, category, round(score, 9) AS score, round(raw_score, 9) AS raw_score, round(score, 9) >= 0.4 AS is_anomaly FROM gated", **GATED_SQL)
def gated_scores(spark, sf):
    return _gated(_Views(spark, sf, True)).select("itemid", "category", r("score"), r("raw_score"), (F.round("score", 9) >= 0.4).alias("is_anomaly"))


#: One category whose magnitude grades the test series, so that some items are held back by it alone.
GRADED = MetricCategories(categories=(Category("all", ("*",), 1.0, Magnitude("relative", 0.5, 8.0)),), recurring_peak=RecurringPeak(enabled=False), duration=Duration(enabled=False))


GRADED_SQL = (
    "SELECT *, raw_score * magnitude * idle * recency AS score FROM "
    f"(SELECT * REPLACE (CASE WHEN h_mean IS NULL OR t_mean IS NULL THEN 1 ELSE {_ramp_sql('abs(h_mean - t_mean) / greatest(abs(t_mean), 1e-9)', 0.5, 8.0)} END AS magnitude) FROM gt)"
)


def _graded(v: _Views) -> DataFrame:
    return materialize(_gated(v, GRADED), "gated")


@query(
    "SELECT itemid, round(score, 9) AS score FROM graded WHERE score < 0.4 AND raw_score >= 0.4 AND idle = 1 AND magnitude < 1",
    **GATED_SQL,
    graded=GRADED_SQL,
)
def rescue_candidates(spark, sf):
    return gates.rescue_candidates(_graded(_Views(spark, sf, True)), 0.4).select("itemid", r("score"))


# --- incidents

CHART_SQL = {
    "crow": f"SELECT hist.* FROM hist SEMI JOIN z1 USING (itemid) WHERE clock BETWEEN {START} AND {ENDEP}",
    "cgap": "SELECT itemid, quantile_cont(gap, 0.5) AS gap FROM (SELECT itemid, clock - lag(clock) OVER (PARTITION BY itemid ORDER BY clock) AS gap FROM crow) WHERE gap IS NOT NULL GROUP BY itemid",
    "cunit": "SELECT CASE WHEN m >= 1 THEN floor(m) ELSE 600 END::BIGINT AS unit FROM (SELECT quantile_cont(gap, 0.5) AS m FROM cgap)",
    "cmean": "SELECT itemid, clock // unit AS bucket, avg(value) AS value FROM crow, cunit WHERE itemid IN (SELECT itemid FROM cgap, cunit WHERE gap <= 2.0 * unit) GROUP BY ALL",
    "cgrid": "SELECT itemid, bucket FROM (SELECT DISTINCT itemid FROM cmean), (SELECT unnest(range(lo, hi + 1)) AS bucket FROM (SELECT min(bucket) AS lo, max(bucket) AS hi FROM cmean))",
    "cnear": "SELECT itemid, cgrid.bucket, value, max(CASE WHEN value IS NOT NULL THEN cgrid.bucket END) OVER (PARTITION BY itemid ORDER BY cgrid.bucket) AS b0, min(CASE WHEN value IS NOT NULL THEN cgrid.bucket END) OVER (PARTITION BY itemid ORDER BY cgrid.bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1 FROM cgrid LEFT JOIN cmean USING (itemid, bucket)",
    "charted": "SELECT n.itemid, n.bucket, CASE WHEN n.value IS NOT NULL THEN n.value WHEN b0 IS NULL THEN y.value WHEN b1 IS NULL THEN x.value ELSE x.value + (y.value - x.value) * (n.bucket - b0) / (b1 - b0) END AS value FROM cnear n LEFT JOIN cmean x ON x.itemid = n.itemid AND x.bucket = b0 LEFT JOIN cmean y ON y.itemid = n.itemid AND y.bucket = b1",
    "cdiff": "SELECT * FROM (SELECT itemid, bucket, round(value - lag(value) OVER (PARTITION BY itemid ORDER BY bucket), 9) AS value FROM charted) WHERE value IS NOT NULL",
    "drank": "SELECT itemid, bucket, rank() OVER (PARTITION BY itemid ORDER BY value) + (count(*) OVER (PARTITION BY itemid, value) - 1) / 2 AS r FROM cdiff",
    "lrank": "SELECT itemid, bucket, rank() OVER (PARTITION BY itemid ORDER BY value) + (count(*) OVER (PARTITION BY itemid, value) - 1) / 2 AS r FROM (SELECT itemid, bucket, round(value, 9) AS value FROM charted)",
    "cids": "SELECT DISTINCT itemid FROM charted",
    "drho": "SELECT a.itemid AS i, b.itemid AS j, corr(a.r, b.r) AS rho FROM drank a JOIN drank b ON a.bucket = b.bucket AND a.itemid < b.itemid GROUP BY ALL",
    "dist0": "SELECT a.itemid AS i, b.itemid AS j, (1 - CASE WHEN rho IS NULL OR isnan(rho) THEN 0 ELSE rho END) / 2 AS distance FROM cids a JOIN cids b ON a.itemid < b.itemid LEFT JOIN drho ON drho.i = a.itemid AND drho.j = b.itemid",
    "fam": "SELECT itemid, trim(split_part(key_, '[', 1)) AS f FROM items",
    "rraw": "SELECT a.itemid AS i, b.itemid AS j, corr(a.r, b.r) AS rho FROM lrank a JOIN lrank b ON a.bucket = b.bucket AND a.itemid < b.itemid JOIN fam x ON x.itemid = a.itemid JOIN fam y ON y.itemid = b.itemid AND x.f = y.f WHERE x.f <> '' GROUP BY ALL",
    "dist1": "SELECT dist0.i, dist0.j, CASE WHEN rho >= 0.3 THEN least(distance, (1 - rho) / 2) ELSE distance END AS distance FROM dist0 LEFT JOIN rraw ON rraw.i = dist0.i AND rraw.j = dist0.j",
}


def _charts(v: _Views) -> DataFrame:
    ids = detectors.zscore_scores(v.recent, v.base, Z1).select("itemid")
    rows = materialize(stats.in_range(v.hist, START, ENDEP).join(ids, "itemid", "left_semi"), "flagged-samples")
    unit = materialize(stats.grid_unit(rows), "grid-unit")
    return cluster.build_charts(rows.join(cluster.usable_items(rows, unit), "itemid", "left_semi"), unit)


@query("SELECT itemid, bucket, round(value, 9) AS value FROM charted", **CHART_SQL)
def charts(spark, sf):
    return _charts(_Views(spark, sf)).select("itemid", "bucket", r("value"))


@query("SELECT i, j, round(distance, 9) AS distance FROM dist0", **CHART_SQL)
def diff_spearman_pairs(spark, sf):
    return cluster.pair_distances(_charts(_Views(spark, sf, True))).select("i", "j", r("distance"))


@query("SELECT i, j, round(distance, 9) AS distance FROM dist1", **CHART_SQL)
def raw_channel_pairs(spark, sf):
    v = _Views(spark, sf, True)
    return cluster.pair_distances(_charts(v), v.items, 0.3).select("i", "j", r("distance"))


@query("SELECT d.i, d.j, round(CASE WHEN abs(a.onset - b.onset) > 7200 THEN 1 ELSE distance END, 9)::DOUBLE AS distance FROM dist0 d LEFT JOIN level_on a ON a.itemid = d.i LEFT JOIN level_on b ON b.itemid = d.j", **CHART_SQL, **LEVEL_SQL)
def distance_with_onset(spark, sf):
    v = _Views(spark, sf, True)
    return cluster.pair_distances(_charts(v), onsets=_level(v), max_gap=7200).select("i", "j", r("distance"))


def _linked(eps: float) -> dict[str, str]:
    """Complete linkage of the charted items, merging the two closest clusters at a time."""
    near = "SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, max(distance) AS d FROM clus x JOIN dist99 ON i = x.itemid JOIN clus y ON j = y.itemid WHERE x.label <> y.label GROUP BY ALL ORDER BY d, a, b LIMIT 1"
    return {
        "dist99": CHART_SQL["dist1"].replace(">= 0.3", ">= 0.99"),
        "clus": f"SELECT 0 AS step, itemid, itemid AS label FROM cids UNION ALL SELECT step + 1, c.itemid, CASE WHEN c.label = m.b THEN m.a ELSE c.label END FROM clus c, ({near}) m WHERE d < {eps}",
        "grp": "SELECT itemid, label FROM clus WHERE step = (SELECT max(step) FROM clus) QUALIFY count(*) OVER (PARTITION BY label) >= 2",
    }


@query("SELECT i, j, round(distance, 9) AS distance FROM dist1 WHERE distance < 0.45", **CHART_SQL)
def close_pairs(spark, sf):
    v = _Views(spark, sf, True)
    return cluster.close_pairs(_charts(v), 0.45, v.items, 0.3).select("i", "j", r("distance"))


@query("SELECT z1.itemid, coalesce(k - 1, -1)::INTEGER AS clusterid FROM z1 LEFT JOIN (SELECT itemid, dense_rank() OVER (ORDER BY label) AS k FROM grp) USING (itemid)", **CHART_SQL, **_linked(0.35))
def incident_clusters(spark, sf):
    v = _Views(spark, sf, True)
    return cluster.cluster_anomalies(stats.in_range(v.hist, START, ENDEP), detectors.zscore_scores(v.recent, v.base, Z1), Clustering(corr_eps=0.35), v.items)


RESCUE_SQL = {
    "graded": GRADED_SQL,
    "rconf": "SELECT itemid FROM graded WHERE score >= 0.4",
    "rcand": "SELECT itemid, score FROM graded WHERE score < 0.4 AND raw_score >= 0.4 AND idle = 1 AND magnitude < 1",
    **CHART_SQL,
    "crow": CHART_SQL["crow"].replace("JOIN z1", "JOIN (SELECT itemid FROM rconf UNION SELECT itemid FROM rcand)"),
}


@query("SELECT itemid, round(score, 9) AS score FROM rcand WHERE itemid IN (SELECT x.itemid FROM grp x JOIN grp y USING (label) SEMI JOIN rconf ON rconf.itemid = y.itemid)", **GATED_SQL, **RESCUE_SQL, **_linked(0.45))
def rescued_items(spark, sf):
    v = _Views(spark, sf, True)
    gated = _graded(v)
    cand, ok = gates.rescue_candidates(gated, 0.4), gated.where("is_anomaly")
    found = cluster.cluster_anomalies(stats.in_range(v.hist, START, ENDEP), ok.select("itemid").union(cand.select("itemid")), Clustering(corr_eps=0.45), v.items)
    return gates.select_rescued(cand, found, ok).select("itemid", r("score"))


@query()
def hourly_detection(spark, sf):
    """The whole hourly plan, at lower thresholds than shipped: these series are sparse."""
    v = _Views(spark, sf, True)
    cfg = Source(history_interval=4800, staleness_secs=DAY, detectors=Detectors(ZScore(lambda_threshold=1.0), Changepoint(cusum_h=2.0), Seasonal(lambda_threshold=1.0)), ensemble=Ensemble(0.3, 2), anomaly_filters=())
    found = detect(Inputs(v.hist, v.trends, v.items, v.recent, v.full, v.hours), cfg, ENDEP)
    return found.gated.join(found.clusters, "itemid", "left").select("itemid", "category", r("score"), r("raw_score"), "is_anomaly", F.coalesce("clusterid", F.lit(-1)).alias("clusterid"))


#: A replay of daily cycles by the z-score alone, without gates.
CYCLES = [ENDEP - DAY * k for k in range(12)]
KEEP = 3 * DAY
REPLAY = Source(
    history_interval=4800, anomaly_keep_secs=KEEP, detectors=Detectors(ZScore(lambda_threshold=1.0), Changepoint(enabled=False), Seasonal(enabled=False)), ensemble=Ensemble(0.6, 1), item_filters=(), anomaly_filters=(),
    clustering=Clustering(rescue_same_incident=False, min_corr_points=1_000_000), metric_categories=MetricCategories(categories=(), default_weight=1.0, duration=Duration(enabled=False), recency=Recency(enabled=False), idle_baseline=IdleBaseline(enabled=False), recurring_peak=RecurringPeak(enabled=False)),
)
REPLAY_SQL = {
    "cyc": f"SELECT {ENDEP} - {DAY} * k AS e FROM range({len(CYCLES)}) AS g(k)",
    "crec": f"SELECT e, itemid, avg(value) AS h FROM cyc JOIN hist ON clock > e - {DAY} AND clock <= e GROUP BY ALL",
    "cbase": f"SELECT e, itemid, avg(value_avg) AS m, coalesce(stddev_samp(value_avg), 0) AS s FROM cyc JOIN trends ON clock BETWEEN e - {DAYS * DAY} AND e GROUP BY ALL",
    "cdet": "SELECT e, itemid, row_number() OVER (PARTITION BY itemid ORDER BY e) AS rn FROM crec JOIN cbase USING (e, itemid) WHERE s > 0 AND (m = 0 OR abs(h - m) / abs(m) > 0.05) AND abs(h - m) / s / 2 >= 0.6",
    "cfold": f"SELECT itemid, rn, e, e AS last FROM cdet WHERE rn = 1 UNION ALL SELECT d.itemid, d.rn, d.e, CASE WHEN d.e - last > {KEEP} THEN d.e ELSE last END FROM cfold f JOIN cdet d ON d.itemid = f.itemid AND d.rn = f.rn + 1",
    "conce": "SELECT itemid, e FROM cfold WHERE e = last",
    "cflag": f"SELECT e, itemid, true AS d, false AS n, false AS k FROM cdet UNION ALL SELECT e, itemid, false, true, false FROM conce UNION ALL SELECT cyc.e, itemid, false, false, true FROM conce o JOIN cyc ON cyc.e >= o.e AND cyc.e - o.e <= {KEEP}",
}


@query("SELECT e AS endep, itemid, bool_or(d) AS detected, bool_or(n) AS recorded, bool_or(k) AS retained FROM cflag GROUP BY ALL", **REPLAY_SQL)
def replay_cycles(spark, sf):
    v = _Views(spark, sf, True)
    return backtest.replay_cycles(v.hist, v.trends, v.items, REPLAY, CYCLES)


# --- fast axis

FAST = {
    "frow": f"SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY clock DESC) AS rn FROM hist WHERE clock BETWEEN {START} AND {ENDEP}",
    "fnew": "SELECT itemid, avg(value) AS mean FROM frow WHERE rn <= 3 GROUP BY itemid",
    "fold": "SELECT itemid, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(value)::BIGINT AS cnt FROM frow WHERE rn > 3 GROUP BY itemid",
    "fz": "SELECT itemid, least((z - 1.0) * 0.5 + 0.5, 1) AS score, z, h_mean FROM (SELECT itemid, fnew.mean AS h_mean, abs(fnew.mean - fold.mean) / fold.std AS z FROM fnew JOIN fold USING (itemid) WHERE std > 0 AND cnt > 0 AND (fold.mean = 0 OR abs(fnew.mean - fold.mean) / abs(fold.mean) > 0.05)) WHERE z >= 1.0",
    "hw": f"SELECT host_name, 1 - exp(-sum(least(greatest(severity, 0), 5) / 5) / 3.0) AS weight FROM problems WHERE clock BETWEEN {ENDEP - DAY} AND {ENDEP} GROUP BY host_name",
    "fe": "SELECT fz.itemid, score, host_name, CASE WHEN fz.itemid % 3 = 0 THEN 'c' || (hostid % 5)::VARCHAR ELSE 'i' || fz.itemid::VARCHAR END AS g FROM fz JOIN items USING (itemid)",
    "fh": "SELECT g, product(1 - weight) AS hr, max(weight) AS boost FROM (SELECT DISTINCT g, host_name FROM fe) JOIN hw USING (host_name) WHERE weight > 0 GROUP BY g",
}
FCFG = FastDetect(detect_window=3, lambda_threshold=1.0, min_item_score=0.5)


def _short(spark, sf):
    return stats.short_window_stats(stats.in_range(b.history(spark, sf), START, ENDEP), 3)


@query("SELECT itemid, round(fnew.mean, 9) AS recent, round(fold.mean, 9) AS mean, round(std, 9) AS std, cnt FROM fnew LEFT JOIN fold USING (itemid)", **FAST)
def short_window_stats(spark, sf):
    new, old = _short(spark, sf)
    return new.select("itemid", F.round("mean", 9).alias("recent")).join(old.select("itemid", r("mean"), r("std"), "cnt"), "itemid", "left")


@query("SELECT itemid, round(score, 9) AS score, round(z, 9) AS z FROM fz", **FAST)
def fast_severity(spark, sf):
    return fast.fast_severity(*_short(spark, sf), FCFG).select("itemid", r("score"), r("z"))


@query(f"SELECT fz.itemid, round(abs(h_mean - hours.mean) / hours.std, 9) AS seasonal_z, coalesce(abs(h_mean - hours.mean) / hours.std < 1.0, false) AS suppressed FROM fz LEFT JOIN hours ON hours.itemid = fz.itemid AND hour_of_day = {HOUR} AND hours.std > 0", **FAST)
def seasonal_veto(spark, sf):
    return fast.seasonal_veto(fast.fast_severity(*_short(spark, sf), FCFG), _Views(spark, sf).hours, HOUR, 1.0).select("itemid", r("seasonal_z"), "suppressed")


def _weights(spark, sf):
    return fast.host_event_weights(stats.in_range(b.problem_events(spark, sf), ENDEP - DAY, ENDEP), 3.0)


@query("SELECT host_name, round(weight, 9) AS weight FROM hw", **FAST)
def host_event_weight(spark, sf):
    return _weights(spark, sf).select("host_name", r("weight"))


def _events(spark, sf):
    items = b.items(spark, sf)
    groups = items.select("itemid", F.when(F.col("itemid") % 3 == 0, (F.col("hostid") % 5).cast("int")).otherwise(-1).alias("clusterid"))
    return fast.score_events(fast.fast_severity(*_short(spark, sf), FCFG).join(items.select("itemid"), "itemid", "left_semi"), groups, items, _weights(spark, sf))


@query("SELECT round(1 - product(1 - least(greatest(score, 0), 1)) * coalesce(any_value(hr), 1), 4) AS score, count(*)::BIGINT AS n_items, min(itemid) AS first_item, CASE WHEN count(*) >= 2 THEN 'novel co-occurrence' ELSE 'single-item' END AS reason, round(coalesce(any_value(boost), 0), 4) AS event_boost FROM fe LEFT JOIN fh USING (g) GROUP BY g", **FAST)
def noisy_or_events(spark, sf):
    return _events(spark, sf).select("score", "n_items", F.col("items")[0]["item_id"].alias("first_item"), "reason", "event_boost")


@query("SELECT round(weight, 4) AS score, 0::BIGINT AS n_items, 'host_events' AS reason, round(weight, 4) AS event_boost, host_name AS host FROM hw WHERE weight >= 0.1 AND host_name NOT IN (SELECT host_name FROM fz JOIN items USING (itemid) WHERE z >= 8.0)", **FAST)
def event_only_events(spark, sf):
    strong = fast.fast_severity(*_short(spark, sf), FastDetect(detect_window=3, lambda_threshold=8.0, min_item_score=0.5))
    return fast.event_only_events(_weights(spark, sf), strong.join(b.items(spark, sf), "itemid"), 0.1).select("score", "n_items", "reason", "event_boost", "host")


@query()
def fast_detection(spark, sf):
    """The fast plan over all items and the last two weeks."""
    v = _Views(spark, sf)
    cfg = Source(fast_detect=FastDetect(True, (WatchRule(),), DAYS * DAY, 3, 1.0, 0.5, True, 1.0, True, True, DAY))
    scored, _ = fast_events(v.hist, v.items, v.hours, b.problem_events(spark, sf), cfg, ENDEP)
    return scored.select("score", "n_items", "reason", "event_boost", "host")


# --- recorded anomalies, pages and queues

AN = {
    "zz": f"SELECT itemid, {ENDEP}::BIGINT AS created, score FROM z1 UNION ALL SELECT itemid, {ENDEP - DAY}::BIGINT, score FROM zb",
    "an": "SELECT itemid, created, group_name, hostid, CASE WHEN itemid % 3 = 0 THEN hostid % 5 ELSE -1 END AS clusterid, host_name, item_name, score, itemid % 2 = 0 AS rescued FROM zz JOIN items USING (itemid)",
}


def _anomalies(spark, sf):
    v = _Views(spark, sf)
    before = stats.window_stats(v.hist, ENDEP - 2 * DAY, ENDEP - DAY)
    s = detectors.zscore_scores(v.recent, v.base, Z1).select("itemid", F.lit(ENDEP).cast("long").alias("created"), "score")
    return b.anomalies(spark, sf, s.unionByName(detectors.zscore_scores(before, v.base, Z1).select("itemid", F.lit(ENDEP - DAY).cast("long").alias("created"), "score")))


def _stores(spark) -> Stores:
    return Stores(spark, scratch_path(spark, "stores"), "tables")


@query(f"SELECT itemid, round(score, 9) AS score FROM an WHERE created = {ENDEP} AND itemid NOT IN (SELECT itemid FROM an WHERE created < {ENDEP} AND created >= {ENDEP - 3 * DAY})", **AN)
def detect_once(spark, sf):
    a, st = _anomalies(spark, sf), _stores(spark)
    st.anomalies.upsert(a.where(F.col("created") < ENDEP))
    return a.where(F.col("created") == ENDEP).join(st.recorded_ids(ENDEP - 3 * DAY), "itemid", "left_anti").select("itemid", r("score"))


@query(f"SELECT itemid, created FROM an WHERE created >= {ENDEP - DAY // 2}", **AN)
def retention(spark, sf):
    st = _stores(spark)
    st.anomalies.upsert(_anomalies(spark, sf))
    st.anomalies.delete_before("created", ENDEP - DAY // 2)
    return st.anomalies.read().select("itemid", "created")


@query("SELECT itemid, created, group_name FROM an WHERE created = (SELECT max(created) FROM an)", **AN)
def latest_cycle(spark, sf):
    return pages.latest_cycle(_anomalies(spark, sf)).select("itemid", "created", "group_name")


@query("SELECT itemid, round(score, 9) AS score, n_members, n_rescued FROM (SELECT *, count(*) OVER (PARTITION BY g)::BIGINT AS n_members, count(*) FILTER (rescued) OVER (PARTITION BY g)::BIGINT AS n_rescued, row_number() OVER (PARTITION BY g ORDER BY score DESC, itemid) AS k FROM (SELECT *, CASE WHEN clusterid >= 0 THEN 'c' || clusterid::VARCHAR ELSE 'i' || itemid::VARCHAR END AS g FROM (SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY score DESC, created DESC, group_name) AS b FROM an) WHERE b = 1)) WHERE k = 1", **AN)
def collapse_flagged(spark, sf):
    return pages.collapse_flagged(_anomalies(spark, sf)).select("itemid", r("score"), "n_members", "n_rescued")


GROUP_PAGES = {"gp": "SELECT DISTINCT page, itemid FROM (SELECT group_name AS page, min(itemid) AS itemid FROM an WHERE clusterid >= 0 GROUP BY group_name, hostid, clusterid, created UNION ALL SELECT group_name, itemid FROM an WHERE clusterid < 0)"}


@query("SELECT page, itemid FROM gp", **AN, **GROUP_PAGES)
def pages_by_group(spark, sf):
    return pages.pages_by_group(_anomalies(spark, sf))


CLUSTER_PAGES = {
    "pca": "SELECT DISTINCT CASE WHEN clusterid >= 0 THEN (dense_rank() OVER (ORDER BY created) - 1) * 1000 + clusterid ELSE -1 END AS cid, hostid, itemid FROM an",
    "pcn": "SELECT *, CASE WHEN cid >= 0 AND count(*) OVER (PARTITION BY cid) > 1 THEN 'cluster' || cid::VARCHAR ELSE 'singletons' END AS page FROM pca",
    "pcp": "SELECT page FROM pcn GROUP BY page ORDER BY min(cid) LIMIT 50",
    "cpage": "SELECT page, itemid, row_number() OVER (PARTITION BY page ORDER BY cid, hostid, itemid) - 1 AS pos FROM pcn SEMI JOIN pcp USING (page)",
}


@query("SELECT page, itemid, pos::BIGINT AS pos FROM cpage", **AN, **CLUSTER_PAGES)
def pages_by_cluster(spark, sf):
    return pages.pages_by_cluster(_anomalies(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


_LAYOUT = "SELECT page || '_' || (k // 48 + 1)::VARCHAR AS page, itemid, (k % 48 % 4 * 15)::BIGINT AS x, (k % 48 // 4 * 5)::BIGINT AS y, header FROM (SELECT page, itemid, {k} AS k, host_name || ': ' || key_ AS header FROM {pages} JOIN items USING (itemid))"


@query(_LAYOUT.format(pages="gp", k="row_number() OVER (PARTITION BY page ORDER BY itemid) - 1"), **AN, **GROUP_PAGES)
def page_layout(spark, sf):
    return pages.page_layout(pages.pages_by_group(_anomalies(spark, sf)), pages.widget_labels(b.items(spark, sf)))


@query(_LAYOUT.format(pages="cpage", k="pos"), **AN, **CLUSTER_PAGES)
def cluster_page_layout(spark, sf):
    return pages.page_layout(pages.pages_by_cluster(_anomalies(spark, sf)), pages.widget_labels(b.items(spark, sf)))


BANDS = "SELECT itemid, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 0.5 THEN 'high_score' WHEN coalesce(score, 0) > 0.1 THEN 'mid_score' ELSE 'low_score' END AS page FROM base LEFT JOIN z1 USING (itemid)"


@query("SELECT page || CASE WHEN n > 48 THEN '_' || (k // 48 + 1)::VARCHAR ELSE '' END AS page, itemid, (k % 48 % 4 * 16)::BIGINT AS x, (k % 48 // 4 * 5)::BIGINT AS y, '' AS header FROM (SELECT page, itemid, row_number() OVER (PARTITION BY page ORDER BY score DESC, itemid) - 1 AS k, count(*) OVER (PARTITION BY page) AS n FROM bands)", bands=BANDS)
def band_pages(spark, sf):
    v = _Views(spark, sf)
    s = v.base.select("itemid").join(detectors.zscore_scores(v.recent, v.base, Z1), "itemid", "left").fillna({"score": 0.0})
    paged = pages.pages_by_band(s.select("itemid", "score", filters.score_band(F.col("score")).alias("band")))
    return pages.page_layout(paged, width=pages.REVIEW_WIDTH, suffix_always=False)


HASH_SQL = "(((itemid * 48271 + {s} * 7919) % 2147483647) * 16807 + 12345) % 2147483647"
POOL = {
    "allz": "SELECT base.itemid, abs(recent.mean - base.mean) / base.std / 3 AS score FROM base JOIN recent USING (itemid) WHERE base.std > 0",
    "pool": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY CASE WHEN band = 'mid' THEN -score ELSE {HASH_SQL.format(s=7)} END, itemid) AS pos FROM (SELECT itemid, score, CASE WHEN score > 0.1 AND score < 0.5 THEN 'mid' WHEN score <= 0.1 THEN 'low' END AS band FROM allz WHERE itemid NOT IN (SELECT itemid FROM z15)) WHERE band IS NOT NULL) WHERE pos <= 30",
    "trim": "SELECT * FROM (SELECT itemid, score, band, host_name, key_, row_number() OVER (PARTITION BY band ORDER BY pos) AS rn FROM pool JOIN items USING (itemid) WHERE NOT EXISTS (SELECT 1 FROM items x WHERE x.itemid % 10 = 3 AND x.host_name = items.host_name AND x.key_ = items.key_)) WHERE rn <= 10",
}


def _simple_scores(v):
    return v.base.where("std > 0").join(v.recent.select("itemid", F.col("mean").alias("m")), "itemid").select("itemid", (F.abs(F.col("m") - F.col("mean")) / F.col("std") / 3).alias("score"))


def _pool(v):
    return pages.candidate_pools(_simple_scores(v), detectors.zscore_scores(v.recent, v.base, Z15), 10, 10, 7)


@query("SELECT itemid, round(score, 9) AS score, band, pos::BIGINT AS pos FROM pool", **POOL)
def strata_pools(spark, sf):
    return _pool(_Views(spark, sf)).select("itemid", r("score"), "band", F.col("pos").cast("long").alias("pos"))


QUEUE = {
    "qdone": "SELECT DISTINCT host_name, key_ FROM items WHERE itemid % 10 = 3",
    "qtop": "SELECT itemid, score, z FROM z15 ORDER BY score DESC, z DESC, itemid LIMIT 30",
    "qflag": "SELECT itemid, host_name, key_, score, z FROM qtop JOIN items USING (itemid) ANTI JOIN qdone USING (host_name, key_) ORDER BY score DESC, z DESC, itemid LIMIT 10",
    "qpool": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY CASE WHEN band = 'mid' THEN -score ELSE {HASH_SQL.format(s=7)} END, itemid) AS pos FROM (SELECT itemid, score, CASE WHEN score > 0.1 AND score < 0.5 THEN 'mid' WHEN score <= 0.1 THEN 'low' END AS band FROM allz ANTI JOIN qtop USING (itemid)) WHERE band IS NOT NULL) WHERE pos <= CASE WHEN band = 'mid' THEN 24 ELSE 18 END",
    "qrest": "SELECT * FROM (SELECT itemid, host_name, key_, score, band, row_number() OVER (PARTITION BY band ORDER BY pos) AS rn FROM qpool JOIN items USING (itemid) ANTI JOIN qdone USING (host_name, key_)) WHERE rn <= CASE WHEN band = 'mid' THEN 8 ELSE 6 END",
}


@query("SELECT itemid, host_name, key_, round(score, 4) AS score, 'flagged' AS band FROM qflag UNION ALL SELECT itemid, host_name, key_, round(score, 4), CASE band WHEN 'mid' THEN 'boundary' ELSE 'control' END FROM qrest", **POOL, **QUEUE)
def review_queue(spark, sf):
    v = _Views(spark, sf)
    done = v.items.where("itemid % 10 = 3")
    return pages.review_queue(_simple_scores(v), v.items, done, 10, 8, 6, 7, zscores=detectors.zscore_scores(v.recent, v.base, Z15)).select("itemid", "host_name", "key_", "score", "band")


@query(f"SELECT itemid FROM an WHERE created >= {ENDEP} UNION SELECT itemid FROM s1", **AN)
def replay_candidates(spark, sf):
    v = _Views(spark, sf)
    return pages.replay_candidates(_anomalies(spark, sf), detectors.seasonal_scores(v.recent, v.hours, HOUR, Seasonal(lambda_threshold=1.0)), ENDEP)


@query("SELECT itemid, band, rn::BIGINT AS rn FROM trim", **POOL)
def dedup_trim(spark, sf):
    v = _Views(spark, sf)
    return pages.dedup_trim(_pool(v), v.items, v.items.where("itemid % 10 = 3"), 10).select("itemid", "band", F.col("rn").cast("long").alias("rn"))


@query("SELECT itemid, round(score, 9) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, itemid) AS k FROM z1) WHERE k <= 20 UNION ALL SELECT itemid, round(score, 9) FROM (SELECT *, row_number() OVER (ORDER BY " + HASH_SQL.format(s=3) + ", itemid) AS h FROM (SELECT *, row_number() OVER (ORDER BY score DESC, itemid) AS k FROM z1) WHERE k > 20) WHERE h <= 10 UNION ALL SELECT itemid, 0 FROM (SELECT itemid, row_number() OVER (ORDER BY " + HASH_SQL.format(s=4) + ", itemid) AS h FROM base WHERE itemid NOT IN (SELECT itemid FROM z1)) WHERE h <= 10")
def stratified_sample(spark, sf):
    v = _Views(spark, sf)
    z = detectors.zscore_scores(v.recent, v.base, Z1)
    return pages.stratified_sample(z, v.base.join(z, "itemid", "left_anti"), 20, 10, 10, 3).select("itemid", r("score"))


@query("SELECT itemid, round(score, 9) AS score, round(z, 9) AS z FROM z1 ORDER BY score DESC, z DESC, itemid LIMIT 25")
def top_zscores(spark, sf):
    v = _Views(spark, sf)
    return pages.top_zscores(detectors.zscore_scores(v.recent, v.base, Z1), 25).select("itemid", r("score"), r("z"))


SUMMARY = {
    "newest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY itemid ORDER BY created DESC, score DESC) AS k FROM an) WHERE k = 1",
    "cycles": "SELECT itemid, string_agg(DISTINCT created::VARCHAR, ',' ORDER BY created::VARCHAR) AS detections FROM an GROUP BY itemid",
}


@query("SELECT items.itemid, items.host_name, items.item_name, items.group_name, coalesce(newest.created, 0)::BIGINT AS created, coalesce(newest.clusterid, -1)::INTEGER AS clusterid, round(CASE WHEN newest.created IS NOT NULL THEN base.mean END, 9) AS trend_mean, round(CASE WHEN newest.created IS NOT NULL THEN base.std END, 9) AS trend_std, coalesce(detections, '') AS detections, round(coalesce(allz.score, 0), 9) AS score, CASE WHEN allz.score >= 0.5 THEN 'high' WHEN allz.score > 0.1 THEN 'mid' ELSE 'low' END AS band FROM items LEFT JOIN newest USING (itemid) LEFT JOIN cycles USING (itemid) LEFT JOIN allz ON allz.itemid = items.itemid LEFT JOIN base ON base.itemid = items.itemid", **POOL, **AN, **SUMMARY)
def review_summary(spark, sf):
    v = _Views(spark, sf)
    scores = _simple_scores(v).withColumn("band", filters.score_band(F.col("score")))
    level = v.base.select("itemid", F.col("mean").alias("trend_mean"), F.col("std").alias("trend_std"))
    out = pages.review_summary(_anomalies(spark, sf).join(level, "itemid", "left"), v.items, scores)
    return out.select("itemid", "host_name", "item_name", "group_name", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("clusterid", F.lit(-1)).alias("clusterid"), r("trend_mean"), r("trend_std"), F.array_join(F.col("detections").cast("array<string>"), ",").alias("detections"), r("score"), "band")


@query("SELECT item_id, CASE WHEN item_id % 11 = 4 THEN -1 ELSE label END AS label, '' AS note, incident, CASE item_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0.25 ELSE 1 END::DOUBLE AS confidence FROM labels_")
def normalized_labels(spark, sf):
    """Labels as people write them: words for numbers, confidences out of range, of no number or missing."""
    typed = b.labels(spark, sf).withColumn("label", F.when(F.col("item_id") % 11 == 4, "unsure").otherwise(F.col("label").cast("string")))
    told = F.element_at(F.array(F.lit("1.5"), F.lit("-2"), F.lit("0.25"), F.lit("high"), F.lit(None)), (F.col("item_id") % 5 + 1).cast("int"))
    return pages.normalize_labels(typed.withColumn("confidence", told).withColumn("note", F.lit(None).cast("string")))


@query("SELECT string_agg(DISTINCT incident, ',' ORDER BY incident) AS names FROM labels_ WHERE incident <> ''")
def incident_names(spark, sf):
    return pages.incident_names(b.labels(spark, sf)).select(F.array_join("names", ",").alias("names"))


@query("SELECT host_name, key_, CASE WHEN fresh.label IS NOT NULL THEN fresh.label ELSE old.label END AS label, coalesce(fresh.date, old.date) AS date FROM (SELECT host_name, key_, max(label) AS label, '2024-01-30' AS date FROM items JOIN labels_ ON item_id = itemid WHERE itemid % 2 = 0 GROUP BY ALL) fresh FULL JOIN (SELECT host_name, key_, max(label) AS label, '2024-01-01' AS date FROM items JOIN labels_ ON item_id = itemid WHERE itemid % 2 = 1 GROUP BY ALL) old USING (host_name, key_)")
def master_upsert(spark, sf):
    labels, items = b.labels(spark, sf), b.items(spark, sf)
    old = pages.build_master_rows(labels.where("item_id % 2 = 1"), items, "2024-01-01")
    return pages.upsert_master(old, pages.build_master_rows(labels.where("item_id % 2 = 0"), items, "2024-01-30")).select("host_name", "key_", "label", "date")


# --- evaluation

_METRICS = "tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1"
_COUNTS = "count(*) FILTER ({h} AND label = 1)::BIGINT AS tp, count(*) FILTER ({h} AND label = 0)::BIGINT AS fp, count(*) FILTER (NOT ({h}) AND label = 1)::BIGINT AS fn, count(*) FILTER (NOT ({h}) AND label = 0)::BIGINT AS tn"
_PR = "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM ({q})"
EV = {"lb": "SELECT item_id AS itemid, label, round(coalesce(score, 0), 9) AS score, key_ FROM labels_ LEFT JOIN z1 ON z1.itemid = item_id JOIN items ON items.itemid = item_id WHERE label >= 0"}


def _cols():
    return ["tp", "fp", "fn", "tn", *(r(c) for c in ("precision", "recall", "f1"))]


def _scored(spark, sf):
    v = _Views(spark, sf)
    return detectors.zscore_scores(v.recent, v.base, Z1).select("itemid", F.round("score", 9).alias("score"))


@query(f"SELECT {_METRICS} FROM ({_PR.format(q='SELECT ' + _COUNTS.format(h='score >= 0.5') + ' FROM lb')})", **EV)
def detection_metrics(spark, sf):
    return evaluate.detection_metrics(_scored(spark, sf), b.labels(spark, sf)).select(*_cols())


@query(f"SELECT category, {_METRICS} FROM ({_PR.format(q=f'SELECT {CATEGORY_NAME_SQL} AS category, ' + _COUNTS.format(h='score >= 0.5') + ' FROM lb GROUP BY 1')})", **EV)
def per_category_metrics(spark, sf):
    i = scalar.category_index(F.col("key_"), CATEGORIES)
    cats = b.items(spark, sf).select("itemid", scalar.category_name(i, CAT).alias("category"))
    return evaluate.category_metrics(_scored(spark, sf), b.labels(spark, sf), cats).select("category", *_cols())


DETECTORS = {
    "det": "SELECT itemid, 'zscore' AS detector, round(score, 9) AS score FROM z1 UNION ALL SELECT itemid, 'seasonal', round(score, 9) FROM s1",
    "det_lb": "SELECT detector, label, coalesce(score, 0) AS score FROM (SELECT item_id AS itemid, label, detector FROM labels_, (SELECT DISTINCT detector FROM det) WHERE label >= 0) LEFT JOIN det USING (itemid, detector)",
    "det_pr": _PR.format(q="SELECT detector, " + _COUNTS.format(h="score >= 0.5") + " FROM det_lb GROUP BY detector"),
}


def _by_detector(spark, sf):
    v = _Views(spark, sf)
    seasonal = detectors.seasonal_scores(v.recent, v.hours, HOUR, Seasonal(lambda_threshold=1.0))
    one = lambda df, name: df.select("itemid", F.lit(name).alias("detector"), F.round("score", 9).alias("score"))
    return evaluate.detector_metrics(one(detectors.zscore_scores(v.recent, v.base, Z1), "zscore").unionByName(one(seasonal, "seasonal")), b.labels(spark, sf))


@query(f"SELECT detector, {_METRICS} FROM det_pr", **DETECTORS)
def detector_metrics(spark, sf):
    return _by_detector(spark, sf).select("detector", *_cols())


@query(
    "SELECT tp, fp, fn, tn, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, round(p, 9) AS micro_precision, round(r, 9) AS micro_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS micro_f1 FROM ("
    + _PR.format(q="SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, avg(p) AS mp, avg(r) AS mr, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS mf FROM det_pr")
    + ")",
    **DETECTORS,
)
def pooled_metrics(spark, sf):
    """Reports of several detectors as one."""
    return evaluate.pool(_by_detector(spark, sf)).select("tp", "fp", "fn", "tn", *(r(f"{k}_{c}") for k in ("macro", "micro") for c in ("precision", "recall", "f1")))


SWEEP = {"sweep": "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (" + _PR.format(q="SELECT t AS threshold, " + _COUNTS.format(h="score >= t") + f" FROM lb, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in evaluate.GRID)}]) AS t) GROUP BY t") + ")"}


@query(f"SELECT threshold, {_METRICS} FROM sweep", **EV, **SWEEP)
def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(_scored(spark, sf), b.labels(spark, sf)).select("threshold", *_cols())


@query(f"SELECT threshold, {_METRICS} FROM sweep ORDER BY f DESC, threshold LIMIT 1", **EV, **SWEEP)
def best_threshold(spark, sf):
    return evaluate.best_threshold(evaluate.threshold_sweep(_scored(spark, sf), b.labels(spark, sf))).select("threshold", *_cols())


@query(f"SELECT threshold, {_METRICS} FROM sweep ORDER BY (r >= 0.5) DESC, CASE WHEN r >= 0.5 THEN -threshold END, r DESC, tp + fp, threshold LIMIT 1", **EV, **SWEEP)
def min_alert_threshold(spark, sf):
    return evaluate.min_alert_threshold(evaluate.threshold_sweep(_scored(spark, sf), b.labels(spark, sf)), 0.5).select("threshold", *_cols())


PAIRS = {
    "tr": "SELECT item_id AS itemid, incident AS t, CASE WHEN item_id % 3 = 0 THEN 'c' || (hostid % 5)::VARCHAR ELSE 'i' || item_id::VARCHAR END AS p FROM labels_ JOIN items ON itemid = item_id WHERE incident <> ''",
    "pr": "SELECT count(*) FILTER (a.t = b.t AND a.p = b.p) AS tp, count(*) FILTER (a.t <> b.t AND a.p = b.p) AS fp, count(*) FILTER (a.t = b.t AND a.p <> b.p) AS fn, count(*) AS n FROM tr a JOIN tr b ON a.itemid < b.itemid",
}


@query("SELECT tp::BIGINT AS pair_tp, fp::BIGINT AS pair_fp, fn::BIGINT AS pair_fn, round(CASE WHEN n = 0 THEN 0 WHEN (2 * tp + fp + fn) / 2 - (tp + fp) * (tp + fn) / n = 0 THEN 1 ELSE (tp - (tp + fp) * (tp + fn) / n) / ((2 * tp + fp + fn) / 2 - (tp + fp) * (tp + fn) / n) END, 9)::DOUBLE AS ari FROM pr", **PAIRS)
def pair_metrics(spark, sf):
    groups = b.items(spark, sf).select("itemid", F.when(F.col("itemid") % 3 == 0, (F.col("hostid") % 5).cast("int")).otherwise(-1).alias("clusterid"))
    return evaluate.cluster_metrics(groups, b.labels(spark, sf)).select("pair_tp", "pair_fp", "pair_fn", r("ari"))


# --- scans


@query("SELECT itemid, clock, round(avg(value), 9) AS value FROM (SELECT itemid, clock, value FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT itemid, clock, floor(value) FROM ev WHERE event_id % 2 = 1) WHERE clock <= " + str(ENDEP) + " GROUP BY itemid, clock")
def union_uint_float(spark, sf):
    rows = _database(spark, sf).get_history(0, ENDEP)
    return rows.groupBy("itemid", "clock").agg(F.round(F.avg("value"), 9).alias("value"))


@query("SELECT itemid, clock, " + ", ".join(f"round(CASE itemid % 2 WHEN 0 THEN {c} ELSE floor({c}) END, 9) AS {c}" for c in ("value_min", "value_avg", "value_max")) + f" FROM trends WHERE clock BETWEEN {START} AND {ENDEP}")
def union_trends(spark, sf):
    return _database(spark, sf).get_trends(START, ENDEP).select("itemid", "clock", r("value_min"), r("value_avg"), r("value_max"))


def _database(spark, sf):
    """The bindings as the tables of a monitoring database."""
    items, events = b.items(spark, sf), b.problem_events(spark, sf)
    hosts, raw = items.select("hostid", F.col("host_name").alias("name")).distinct(), b.raw_events(spark, sf)
    hours = lambda: stats.hourly_trends(b.history(spark, sf))
    tables = {
        "history": lambda: raw.where("event_id % 2 = 0").select("itemid", "clock", "value"),
        "history_uint": lambda: raw.where("event_id % 2 = 1").select("itemid", "clock", F.floor("value").alias("value")),
        "trends": lambda: hours().where("itemid % 2 = 0"),
        "trends_uint": lambda: hours().where("itemid % 2 = 1").select("itemid", "clock", *(F.floor(c).alias(c) for c in ("value_min", "value_avg", "value_max"))),
        "hosts": lambda: hosts,
        "items": lambda: items.select("itemid", "hostid", "key_", F.col("key_").alias("name"), "units"),
        "hosts_groups": lambda: items.select("hostid", F.xxhash64("group_name").alias("groupid")).distinct(),
        "hstgrp": lambda: items.select(F.xxhash64("group_name").alias("groupid"), F.col("group_name").alias("name")).distinct(),
        "events": lambda: events.join(hosts.select(F.col("name").alias("host_name"), "hostid"), "host_name").select(F.col("event_id").alias("eventid"), "clock", "severity", "name", F.col("hostid").alias("objectid"), F.lit(0).alias("source"), F.lit(0).alias("object"), F.lit(1).alias("value")),
        "triggers": lambda: hosts.select(F.col("hostid").alias("triggerid")),
        "functions": lambda: items.select(F.col("hostid").alias("triggerid"), "itemid"),
    }
    return JdbcSource(spark, Source(type="jdbc", options={"reader": lambda name: tables[name]()}))


@query(f"SELECT host_name, clock, severity, count(*)::BIGINT AS n FROM problems WHERE clock BETWEEN {ENDEP - DAY} AND {ENDEP} GROUP BY ALL")
def event_join_distinct(spark, sf):
    return _database(spark, sf).get_events(ENDEP - DAY, ENDEP).groupBy("host_name", "clock", "severity").agg(F.count("*").alias("n"))


@query("SELECT itemid FROM items WHERE (key_ GLOB 'net.*' OR key_ = 'proc.num[sshd]') AND group_name GLOB 'A*'")
def item_scan_like(spark, sf):
    return _database(spark, sf).get_item_ids(item_names=("net.*", "proc.num[sshd]"), group_names=("A*",))


@query("SELECT itemid, host_name, group_name, units FROM items")
def item_details(spark, sf):
    return _database(spark, sf).get_item_details().select("itemid", "host_name", "group_name", "units")


#: A supplier as an item, its line items' prices as samples: the largest series of the tables.
SUPPLY = {"sup": "SELECT l_suppkey AS itemid, epoch_us(l_shipdate::TIMESTAMP) // 1000000 AS clock, avg(l_extendedprice::DOUBLE) AS value FROM lineitem GROUP BY ALL"}


@query("SELECT itemid, cnt, last_clock, round(mean, 4) AS mean, round(std, 4) AS std, round(max_value, 4) AS max_value FROM sst", **SUPPLY, sst=stats_sql("sup", "value", 0, 2**31))
def supplier_window_stats(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("itemid"), (F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long") * DAY).alias("clock"), F.col("l_extendedprice").cast("double").alias("v"))
    hist = li.groupBy("itemid", "clock").agg(F.avg("v").alias("value"))
    return stats.window_stats(hist, 0, 2**31).select("itemid", "cnt", "last_clock", r("mean", 4), r("std", 4), r("max_value", 4))
