import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted(ok):
        if i % every == 0:
            queries.setdefault(i, v)
    out = set()
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def run(spark, rows, k=5, every=7):
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k=k).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def f32(x):
    import numpy as np

    return float(np.float32(x))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(8)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]  # many ties
    rows += [(300, None), (301, []), (302, [0.5, float("nan")]), (303, [None, 0.5]), (None, rows[0][1]), (304, [float("inf")] * 8), (308, [0.25, -0.5])]
    assert run(spark, rows) == brute(rows, 5, 7)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 10)
    assert run(spark, rows) == brute(rows, 5, 7)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (7, [2.0]), (1, [3.0])]) == brute([(0, [1.0]), (7, [2.0]), (1, [3.0])], 5, 7)
    assert run(spark, [(0, [1.0])]) == set()
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, F.col("vec_id") % 7 == 0).count() == 0


def test_large_components(spark):
    rows = [(0, [2e6, 1.0]), (1, [2e6, 0.0]), (2, [3e6, 0.0]), (3, [-3e6, 5.0]), (7, [1e7, -1e7]), (8, [9e6, 1e6])]
    assert run(spark, rows) == brute(rows, 5, 7)
    far = [(0, [2.0**40, -(2.0**40)]), (1, [2.0**30, 2.0**30]), (2, [1.0, -1.0]), (4, [0.5, 0.0])]  # terms beyond a long, the sum within
    with pytest.raises(Exception, match="does not fit in a long"):
        run(spark, [(0, [2.0**30, 0.0]), (1, [2.0**30, 0.0])])
    with pytest.raises(OverflowError):
        run(spark, [(0, [1e30]), (1, [1.0])])
    assert run(spark, far) == brute(far, 5, 7)
    edge = [(0, [2.0**23 - 1, 1.0]), (1, [2.0**23, 0.0]), (2, [-(2.0**23), 0.0]), (3, [2.0**22, 2.0**22])]  # scores just within a long
    assert run(spark, edge) == brute(edge, 5, 7)
