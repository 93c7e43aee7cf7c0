import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import jaccard as jc

SCHEMA = "doc_id long, text string, s string, rep long"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    best = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return Counter((d, best[find(i)], links[i], len(sets[i])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    rows = []
    for g in range(n // 6):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                w[rng.randrange(len(w))] = word()
            rows.append((rng.randint(0, 10**6), " ".join(w)))
    rows += [(5, None), (6, ""), (7, " "), (None, rows[0][1]), (None, "only null rows here today"), (8, "One two"), (9, "one TWO"), (10, rows[3][1]), (10, rows[3][1]), (11, rows[9][1]), (11, "another text of eleven"), (12, "x " * 3000)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, jc.near_duplicates(df, **kw).collect()))


def test_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bucket", [2, 5])
def test_large_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(jc, "BUCKET", bucket)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = corpus(2, 30) + [(1000 + i, " ".join(x if rng.random() > 0.004 else f"n{i}" for x in base)) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def at_threshold(k):
    """Two texts of 96 and 120 shingles, the first within the second."""
    w = [f"p{k}w{i}" for i in range(124)]
    return " ".join(w[:100]), " ".join(w)


def test_recall_at_the_threshold(spark, monkeypatch):
    """All shared buckets are too large at the first level: a pair shares fewer, and must share enough nevertheless."""
    monkeypatch.setattr(jc, "BUCKET", 1)
    n, recall = 400, 0.9
    rows = [(2 * k + i, t) for k in range(n) for i, t in enumerate(at_threshold(k))]
    got = run(spark, rows, recall=recall)
    found = sum(c for (d, low, links, _), c in got.items() if d % 2 and links == 1 and low == d - 1)
    assert found >= recall * n - 3 * (n * recall * (1 - recall)) ** 0.5


def test_runs_give_recall_below_large_buckets():
    """Sampling as the operator does it, J = 400 / 500, one set within the other, leaves of the last level only."""
    rng = np.random.default_rng(6)
    runs, trials, lost = jc.runs_for(jc.RECALL), 4000, 0
    bar = np.uint64((1 << 64) * jc.DEN // (jc.NUM * 500))
    for _ in range(trials):
        g = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2)
        leaves = 0
        for r in range(runs):
            leaves += math.prod(int((jc.mix(g ^ jc._seed(r, level)) <= bar).sum()) for level in range(jc.LEVELS))
        lost += leaves < 3
    assert lost <= 1  # 0.04 expected


def test_passage_in_many_texts(spark, monkeypatch):
    """Texts that share a passage fill large buckets without being alike: these are split, not compared whole."""
    monkeypatch.setattr(jc, "BUCKET", 8)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join([*(f"a{i}w{k}" for k in range(30)), *shared, *(f"b{i}w{k}" for k in range(rng.randint(5, 30)))])) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 120, 7)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == Counter()
    assert run(spark, [(1, "")]) == Counter([(1, 1, 0, 0)])


def test_runs():
    assert jc.runs_for(0.99999) > jc.runs_for(0.99) >= 1


def test_texts_of_thue_morse_words_stay(spark):
    t = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    u = t.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, t), (2, u), (3, "other words stand here for once")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jc.keep_one_of_each_class(df).collect()) == [1, 2, 3]
    assert {r.doc_id: r.class_id for r in jc.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3}
