import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import jaccard, mixture

from .test_jaccard import brute, corpus

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_keeps_one_of_each_class(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    clash = jaccard.keep_one_of_each_class(df.withColumn("text_th", F.lit(7)).withColumn("lead_doc", F.lit("x")))
    assert clash.columns[-2:] == ["text_th", "lead_doc"] and {(r.text_th, r.lead_doc) for r in clash.collect()} == {(7, "x")}
    kept = jaccard.keep_one_of_each_class(df)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    alone = Counter((i, t) for i, t in rows if not (t or "").split())
    assert Counter({k: got[k] for k in alone}) == alone
    rest = {k: n for k, n in got.items() if k not in alone}
    assert set(rest.values()) == {1} and set(rest) <= set(rows)
    # as many as classes, none of them linked to another
    classes = {(c, n) for d, c, links, n in brute(rows) if n and links == 0} | {c for d, c, links, n in brute(rows) if links}
    assert len(rest) == len({c if isinstance(c, int) or c is None else ("alone", *c) for c in classes})
    assert all(links == 0 for _, _, links, _ in brute(list(rest)))


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    bad = ["zork", "blag", "frump"]
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randint(30, 120))]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        elif i % 7 == 0:
            w.insert(5, f"me{i}@mail.example.com")
        docs.append((i, " ".join(w), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"]), 0))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000 + k, docs[1][1], "en", "a", 0) for k in range(10)] + [(2000, None, None, None, None), (None, "words " * 60, "en", "a", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    cur = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = [cur.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, cur, str(tmp_path))
        if k < 4:
            assert out.columns == cur.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        cur = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(cur.count())
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] - 9 and sizes[3] == sizes[2] > sizes[4] == sizes[5]
    redacted = spark.read.parquet(f"{tmp_path}/2").collect()
    assert not any("@" in (r.text or "") for r in redacted) and any("[email]" in (r.text or "") for r in redacted)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, cur.collect()), key=repr)
    final = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((final[r.doc_id].text or "").encode()).hexdigest() for r in cur.collect())


def test_mixture_paths_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 50) + rng.choice(["", "a | b", "x@y.z"]), rng.choice(["en", "fr", None]), rng.choice(["a"] * 5 + ["b", "c", None]), 0) for i in range(400)]
    rows += [(None, None, None, None, None), (3, rows[3][1], "en", "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    near = sorted(map(tuple, mixture.mixture(df).collect()), key=repr)
    assert len(near) == len(rows)
    tokens = sum(r[4] for r in near)
    expect = sum(r[4] * r[5] for r in near)
    assert abs(expect - mixture.BUDGET * tokens) < 0.01 * tokens
    monkeypatch.setattr(mixture, "DRIVER_CELLS", 0)
    far = sorted(map(tuple, mixture.mixture(df, rounds=3).collect()), key=repr)
    monkeypatch.setattr(mixture, "DRIVER_CELLS", 10**6)
    near = sorted(map(tuple, mixture.mixture(df, rounds=3).collect()), key=repr)
    assert [r[:5] for r in far] == [r[:5] for r in near]
    assert all(abs(a[5] - b[5]) <= 1.1e-9 for a, b in zip(far, near))
    assert mixture.mixture(df.limit(0)).count() == 0
    kept = mixture.sample_documents(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in mixture.mixture(df).where("sampled").collect())


def test_raking_meets_targets():
    import numpy as np

    cells = [(s, l, t) for s in "ab" for l in ("en", "fr") for t in ("x", "y")]
    tokens = np.array([50, 10, 5, 5, 10, 10, 5, 5], float)
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"x": 0.3, "y": 0.7}}
    f = mixture.rake(cells, tokens, targets, {}, 60)
    for d, name in enumerate(mixture.DIMENSIONS):
        for v, want in targets[name].items():
            assert abs(sum(f[k] * tokens[k] for k, c in enumerate(cells) if c[d] == v) / tokens.sum() - want) < 1e-6
    lam = mixture.scale_for(list(zip(f, tokens)), 0.8)
    assert abs(sum(min(1, lam * a) * b for a, b in zip(f, tokens)) - 0.8 * tokens.sum()) < 1e-6


def test_marginals_topics_and_warnings(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 50), rng.choice(["en", "fr"]), rng.choice(["a"] * 5 + ["b"]), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("prob", F.lit("x")).withColumn("row", F.lit(1)).withColumn("topic", F.lit("y"))
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.7, "fr": 0.3}, "topic": {"0": 0.2, "1": 0.3, "2": 0.5}}
    got = {(r.dimension, r.value): r.reached for r in mixture.marginals(df, targets=targets, topic=F.col("n_chars"), budget=0.1).collect()}
    assert all(abs(got[d, v] - w) < 1e-6 for d, t in targets.items() for v, w in t.items())
    kept = mixture.sample_documents(df, topic=F.col("n_chars"))
    assert kept.columns == df.columns
    only = spark.createDataFrame([(1, "a b", "en", "a", 0), (2, "c d", "fr", "b", 0)], SCHEMA)
    with pytest.warns(UserWarning, match="marginals are off"):
        mixture.mixture(only, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "fr": 0.8}}).collect()
