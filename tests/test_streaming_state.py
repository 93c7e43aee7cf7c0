import random

from pyspark.sql import functions as F

from tidewatch.config import Changepoint
from tidewatch.functions.sequence import cusum_path
from tidewatch.plans.backtest import record_once
from tidewatch.streaming import fast as stream
from tidewatch.streaming.changepoint import changepoint_stream

SCHEMA = "itemid long, clock long"


def test_record_once_of_an_unordered_stream(spark, tmp_path):
    """Findings late by less than the delay: what the batch rule records, and no state once all has expired."""
    rng = random.Random(6)
    keep, delay, base = 1000, 600, 1_700_000_000
    rows = sorted({(i, base + rng.randrange(12_000)) for i in range(6) for _ in range(25)}, key=lambda r: r[1])
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(300))
    # the last rows push the watermark past every timer of the others
    batches = [arrival[k : k + 30] for k in range(0, len(arrival), 30)] + [[(99, base + 20_000)], [(99, base + 40_000)], [(99, base + 60_000)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/all/{k:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/all")
    q = stream.record_once(source, keep, delay).writeStream.format("memory").queryName("recorded").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.itemid, r.clock) for r in spark.table("recorded").collect() if r.itemid != 99)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("clock", "endep")
    assert got == sorted((r.itemid, r.endep) for r in record_once(df, keep).collect())
    assert len(got) > 30 and len(got) < len(rows)
    # only the last row's own item is held
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_change_points_of_an_unordered_stream(spark, tmp_path):
    """Sums, scores and onsets after every sample: the batch operator's, with samples late by less than the delay."""
    rng = random.Random(8)
    base_clock = 1_700_000_000
    rows = [(i, base_clock + 60 * k, rng.gauss(0, 1) + (3 if i == 1 and k > 60 else -3 if i == 2 and 30 < k < 50 else 0)) for i in range(4) for k in range(100)]
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(500))
    batches = [arrival[k : k + 60] for k in range(0, len(arrival), 60)] + [[(99, base_clock + 10_000_000 * k, 0.0)] for k in (1, 2, 3)]
    schema = "itemid long, clock long, value double"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/all/{k:03d}")
    base = spark.createDataFrame([(i, 0.1, 1.0, 0.5 + i) for i in range(4)], "itemid long, t_mean double, sigma double, w double").cache()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/all")
    cfg = Changepoint()
    q = changepoint_stream(source, base, cfg, 900).writeStream.format("memory").queryName("cusum").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.itemid, r.clock): r for r in spark.table("cusum").collect()}
    df = spark.createDataFrame(rows, schema).join(base, "itemid")
    want = cusum_path(df, (F.col("value") - F.col("t_mean")) * F.col("w"), cfg.cusum_k * F.col("sigma") * F.col("w")).collect()
    # samples without an item in `base` don't move the watermark's own item
    assert len(want) == 400 and {(r.itemid, r.clock) for r in want} == got.keys()
    for r in want:
        g = got[r.itemid, r.clock]
        assert abs(g.s - r.s) < 1e-9 and abs(g.s_max - r.s_max) < 1e-9 and g.onset == r.onset
        assert (g.score is None) == (g.s_max < 5.0) and (g.score is None or abs(g.score - min(1.0, g.s_max / 10)) < 1e-9)
    assert max(g.s_max for g in got.values()) > 5
