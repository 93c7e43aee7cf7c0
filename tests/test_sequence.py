"""Window expressions against plain loops."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import sequence as sq

SERIES = st.lists(st.integers(-20, 20), min_size=1, max_size=12)
MANY = st.lists(SERIES, min_size=1, max_size=6)
FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow], derandomize=True)


def frame(spark, many):
    return spark.createDataFrame([(i, 100 + 10 * k, float(v)) for i, s in enumerate(many) for k, v in enumerate(s)], "itemid long, clock long, value double")


@FEW
@given(MANY)
def test_cusum(spark, many):
    got = {r.itemid: r.s_max for r in sq.cusum_peak(frame(spark, many), F.col("value"), F.lit(1.5)).collect()}
    for i, s in enumerate(many):
        up = down = best = 0.0
        for x in s:
            up, down = max(0.0, up + x - 1.5), max(0.0, down - x - 1.5)
            best = max(best, up, down)
        assert abs(got[i] - best) < 1e-9


@FEW
@given(MANY)
def test_regime_start(spark, many):
    tol = 1
    got = {r.itemid: r.onset for r in sq.regime_start(frame(spark, many), F.abs("value") > 5, tol).collect()}
    for i, s in enumerate(many):
        out, run, onset = [abs(x) > 5 for x in s], 0, 100
        for k in range(len(s) - 1, -1, -1):
            run = run + 1 if out[k] else 0
            if run > tol:
                onset = 100 + 10 * (k + tol + 1) if k + tol + 1 < len(s) else None
                break
        assert got.get(i) == onset


@FEW
@given(MANY)
def test_runs(spark, many):
    df = frame(spark, many)
    hot = F.col("value") >= 3
    starts = {r.itemid: r.n for r in df.withColumn("s", sq.run_starts(hot)).groupBy("itemid").agg(F.sum("s").alias("n")).collect()}
    longest = {r.itemid: (r.n_out, r.longest) for r in sq.longest_run(df, hot).collect()}
    for i, s in enumerate(many):
        hits = "".join("x" if v >= 3 else " " for v in s).split()
        assert starts[i] == len(hits)
        assert longest[i] == (sum(map(len, hits)), max(map(len, hits), default=0))


@FEW
@given(MANY)
def test_trailing_mean_is_half_open(spark, many):
    rows = frame(spark, many).withColumn("m", sq.trailing_mean(F.col("value"), 20)).collect()
    for r in rows:
        s = many[r.itemid]
        k = (r.clock - 100) // 10
        want = s[max(0, k - 1) : k + 1]
        assert abs(r.m - sum(want) / len(want)) < 1e-9


@FEW
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-9, 9)), min_size=1, max_size=9), min_size=1, max_size=5))
def test_linear_fill(spark, many):
    df = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, s in enumerate(many) for k, v in enumerate(s)], "itemid long, bucket long, value double")
    got = {(r.itemid, r.bucket): r.value for r in sq.linear_fill(df).collect()}
    for i, s in enumerate(many):
        known = [k for k, v in enumerate(s) if v is not None]
        for k in range(len(s)):
            if not known:
                assert got[i, k] is None
                continue
            a, b = max((x for x in known if x <= k), default=None), min((x for x in known if x >= k), default=None)
            want = s[b] if a is None else s[a] if b is None or a == b else s[a] + (s[b] - s[a]) * (k - a) / (b - a)
            assert abs(got[i, k] - want) < 1e-9


def test_average_rank(spark):
    df = spark.createDataFrame([(1, v) for v in (5.0, 1.0, 5.0, 2.0)], "itemid long, value double").withColumn("r", sq.average_rank("value"))
    assert sorted((r.value, r.r) for r in df.collect()) == [(1.0, 1.0), (2.0, 2.0), (5.0, 3.5), (5.0, 3.5)]
