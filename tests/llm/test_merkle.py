import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from tidewatch.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    row = list(row)
    if row[3] is not None:
        row[3] += more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def walk(levels, k):
    """[(sibling or '', whether it stands before)] of each level."""
    out = []
    for level in levels[:-1]:
        other = level[k ^ 1] if k ^ 1 < len(level) else ""
        out.append((other, k & 1))
        k >>= 1
    return out


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by_lang[lang]])
    top = tree([trees[v][-1][0] for v in langs])
    root, out = top[-1][0], []
    for place, lang in enumerate(langs):
        for k, r in enumerate(by_lang[lang]):
            steps = walk(trees[lang], k) + walk(top, place)
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for other, before in steps:
                node = h(other, node) if before else h(node, other)
            out.append((r[0], leaf(r), trees[lang][-1][0], root, h(*(s for s, _ in steps)), node, node == root))
    return Counter(out)


def rows(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    out = [(rng.choice([None, *range(n)]), pick("a", "b", None, ""), pick("en", "en", "en", "fr", None, "", "é"), pick(None, 0, 5), pick(None, "", "text é", f"t{k}")) for k in range(n)]
    return out + out[:5] + [(1, "a", "lone", 1, "x" * 2_000_000)]


def test_against_loops(spark):
    for n in (0, 3, 1500):
        got = merkle.manifest(spark.createDataFrame(rows(n), SCHEMA).repartition(5))
        assert got.columns == merkle.NAMES
        assert Counter(tuple(r) for r in got.collect()) == brute(rows(n))


def test_tampering_shows(spark):
    df = spark.createDataFrame([(k, "s", "en", 4, "text") for k in range(700)] + [(k, "s", "en", None, "text") for k in range(700, 800)], SCHEMA)
    got = merkle.manifest(df)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # a null n_chars stays as it is
    assert got.where((hit & (F.col("doc_id") < 700)) == F.col("verified")).count() == 0
    assert got.select("root").distinct().count() == 1 and got.where("folded_root <> root").count() > 50


def test_empty_and_clashing(spark):
    df = spark.createDataFrame(rows(20), SCHEMA)
    assert merkle.manifest(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS key", "2 AS pos", "'x' AS hash", "0 AS n")
    assert Counter(tuple(r) for r in merkle.manifest(clash).collect()) == brute(rows(20))


def test_sql_twin():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows(60)[:-1])
    cur = con.execute(merkle.oracle())
    names = [d[0] for d in cur.description]
    assert Counter(tuple(r[names.index(n)] for n in merkle.NAMES) for r in cur.fetchall()) == brute(rows(60)[:-1])
