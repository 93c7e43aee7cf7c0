import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import classifier as c
from tidewatch.llm.common import table
from tidewatch.llm.textops import Prefix, chain, mix

SF = "/root/testdata/sf0.1"


def chunk(texts):
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


def place(words):
    """The place of an n-gram, word by word."""
    raw, off = chunk(words)
    h = chain(raw, off[:-1], off[1:])
    n = np.array([len(words)])
    return int(mix(Prefix(h).of(np.array([0]), n) + np.uint64(len(words)))[0] >> np.uint64(64 - c.BITS))


def naive(text):
    words = re.findall(r"[A-Za-z0-9\u0080-\U0010FFFF]+|[^A-Za-z0-9\u0080-\U0010FFFF\x20\x09-\x0D]+", text)
    count = Counter(place(words[i : i + k]) for k in c.GRAMS for i in range(len(words) - k + 1))
    value = {p: 1 + math.log(n) for p, n in count.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    return {p: v / norm for p, v in value.items()}


def test_features_against_loops():
    texts = ["", "a a a a", "One two, two... three###", "é ü | x\ty\nz", " \n", "$$", "one two, two"]
    p, v, bounds = c.features(*chunk(texts))
    for k, t in enumerate(texts):
        got = dict(zip(p[bounds[k] : bounds[k + 1]].tolist(), v[bounds[k] : bounds[k + 1]].tolist()))
        assert got == pytest.approx(naive(t), rel=1e-5)


def test_updates_against_scalars():
    """Coordinate by coordinate, as the update is published."""
    rng = random.Random(2)
    docs = [(np.array(sorted(rng.sample(range(50), 5)), np.int32), np.array([rng.random() for _ in range(5)], np.float32), rng.randint(0, 1)) for _ in range(80)]
    leader, z, n = c.Leader(), Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= c.L1 else -(z[i] - math.copysign(c.L1, z[i])) / ((c.BETA + math.sqrt(n[i])) / c.ALPHA + c.L2)

    for at, x, y in docs:
        leader.learn(at, x, y)
        pairs = [*zip(at.tolist(), x.tolist()), (1 << c.BITS, 1.0)]
        w = {i: weight(i) for i, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
        for i, v in pairs:
            g = (p - y) * v
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / c.ALPHA
            z[i] += g - s * w[i]
            n[i] += g * g
    assert leader.weights(np.array([*range(50), 1 << c.BITS])) == pytest.approx([weight(i) for i in [*range(50), 1 << c.BITS]], abs=1e-9)


def test_defined_cases(spark):
    rng = random.Random(1)
    good, bad = "the of and to in is was for".split(), "### | $$$ !!".split()
    docs, labels = [], []
    for k in range(300):
        docs.append((k, " ".join(rng.choice(good if k % 3 else good + bad * 2) for _ in range(60))))
        labels.append((k, int(k % 3 > 0), 0))
    docs += [(900, None), (901, ""), (None, "the of"), (902, "the of and " * 400_000), (0, "twice ###"), (5, docs[5][1])]
    labels += [(None, 1, 0), (2, 0, 0), (3, None, 0), (7777, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS held_out", "2 AS place")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = c.score_quality(df, lab)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    one = {r.doc_id: r for r in rows}
    assert one[900].score == one[901].score and one[902].predicted == 1
    ok = [one[k].predicted == int(k % 3 > 0) for k in range(10, 300) if one[k].held_out]
    assert sum(ok) / len(ok) > 0.95
    assert c.score_quality(df.limit(0), lab).count() == 0
    # one class or none
    assert {r.score for r in c.score_quality(df, lab.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in c.score_quality(df, lab.where("quality = 0")).collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in c.score_quality(docs, labels).where("held_out").collect()}
    pairs = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got]
    assert len(pairs) > 1000
    assert sum(g.predicted == y for g, y in pairs) / len(pairs) > 0.96
    bad = [g.score for g, y in pairs if y == 0]
    fine = [g.score for g, y in pairs if y == 1]
    assert np.mean(np.array(bad)[:, None] < np.array(fine)) > 0.99
