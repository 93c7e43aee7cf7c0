import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import repeats

SCHEMA = "doc_id long, text string, spans string, doc long"


def brute(rows, length=100):
    first = {}
    key = lambda i: (i is not None, i or 0)
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            k, at = raw[s : s + length], (key(i), s)
            if k not in first or at < first[k]:
                first[k] = at
    out = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < (key(i), s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def run(spark, rows, parts=4, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)
    return Counter(map(tuple, repeats.remove_repeats(df, **options).collect()))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))))
            if rng.random() < 0.3:  # part of a passage
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                parts.append(p[a : a + rng.randint(50, 200)])
        rows.append((rng.randint(0, 10_000), " ".join(parts)))
    rows += [(20_000, "ab" * 400), (20_001, "x" * 350), (20_002, "x" * 130 + "y" + "ab" * 60), (3, None), (4, ""), (None, passages[0]), (20_003, rows[5][1]), (20_004, rows[5][1]), (20_004, rows[5][1]), (20_005, passages[1] * 30)]
    rows += [(20_006, passages[2] + "0"), (20_006, "9" + passages[2])]  # one doc_id, two texts
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_hot_triggers(spark):
    """Every trigger with two phrases taken for hot: windows are dealt one by one."""
    rows = corpus(4)
    assert run(spark, rows, hot_least=1) == brute(rows) == run(spark, rows)


def test_one_footer_in_every_text(spark):
    """Shorter than a window, it repeats nothing by itself, but gives one trigger thousands of phrases."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    footer = " ".join(word() for _ in range(40))[:90]
    rows = [(i, " ".join(word() for _ in range(40)) + footer + f"{i:012d}") for i in range(1500)]
    assert run(spark, rows) == brute(rows) == run(spark, rows, hot_least=50)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)
    n = 16
    sizes = lambda blobs: sorted(r["n"] for r in blobs.groupBy("bucket").agg(F.sum(F.length("blob")).alias("n")).collect())
    texts = repeats._texts(df)
    parsed = texts.mapInArrow(repeats._parse(n), repeats._BLOBS)
    got = sizes(parsed)
    assert len(got) == n and got[-1] <= 3 * got[n // 2]
    found = parsed.groupBy("bucket").applyInArrow(repeats._dictionary(50), repeats._SPANS).cache()
    hot = np.sort(found.where("kind = 2").select("doc").toPandas()["doc"].to_numpy(np.int64).view(np.uint64))
    open_ = found.where("kind = 1").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    got = sizes(repeats._with_spans(texts, open_, "inner").select("doc_id", "th", "text", "spans").mapInArrow(repeats._to_compare(n, hot), repeats._BLOBS))
    assert len(hot) and len(got) == n and got[-1] <= 3 * got[n // 2]


def test_texts_beyond_a_chunk(spark):
    rng = random.Random(12)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(repeats.CHUNK + 5000))
    rows = [(1, long_), (2, long_[300:900]), (3, "z" * 700_000), (4, "q" + long_[repeats.CHUNK - 200 : repeats.CHUNK + 200])]
    got = {r[0]: r[2] for r in run(spark, rows, 2)}
    assert got == {1: 0, 2: 600, 3: 699_999, 4: 400}


def test_few_partitions(spark):
    rows = corpus(3)
    assert run(spark, rows, 2) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(1, None)]) == brute([(1, None)])
