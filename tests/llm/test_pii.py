import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import pii

SCHEMA = "doc_id long, text string, base string, th string, n_chars long, start int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m.group())]


def entity(k, v):
    return f"{k}:" + (v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v))


def brute(rows):
    """All spans of each text, by plain loops."""
    texts = {t or "" for _, t in rows}
    words = {t: {m.lower() for m in re.findall(r"(?<![^\W_])[^\W\d_]{4,}(?![^\W_])", t)} for t in texts}
    near, n_e, n_et = {}, defaultdict(set), defaultdict(set)
    for t in texts:
        found = base(t)
        near[t] = []
        for k, s, e, v in found:
            n_e[entity(k, v)].add(t)
            lo, hi = max(0, s - pii.CONTEXT), min(len(t), e + pii.CONTEXT)
            for m in re.finditer(r"(?<![^\W_])[^\W\d_]{4,}(?![^\W_])", t):
                x, y = m.span()
                if any(p <= y and x <= q for _, p, q, _ in found) or not (lo <= x and y <= s or e <= x and y <= hi):
                    continue
                near[t].append((entity(k, v), m.group().lower(), x, y))
                n_et[entity(k, v), m.group().lower()].add(t)
    n = len(texts)
    ratio = {}
    for (e, w), have in n_et.items():
        if len(have) >= pii.MIN_TEXTS and len(n_e[e]) < n:
            n_t = sum(w in x for x in words.values())
            ratio[e, w] = math.log(len(have) * n / (len(n_e[e]) * n_t)) / -math.log(len(n_e[e]) / n)
    out = {}
    for t in texts:
        best = defaultdict(float)
        for e, w, x, y in near[t]:
            best[x, y] = max(best[x, y], ratio.get((e, w), 0))
        terms = sorted(("removed" if r >= pii.REMOVE else "generalised", x, y) for (x, y), r in best.items() if r >= pii.GENERALISE)
        out[t] = ([x[:3] for x in base(t)], [x[:3] for x in base(t)] + terms)
    return out


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7)))
    entities = ["joe.x@mail.example.com", "+1 (523) 555-1055", "10.0.0.1", "4111 1111 1111 1111", "Amy@b.co"]
    clue = {e: word() + "clue" for e in entities}
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            e = rng.choice(entities)
            w.insert(rng.randint(0, len(w)), f"{clue[e]} {e}" if rng.random() < 0.8 else e)
        rows.append((i, " ".join(w)))
    signs = "a1.@-+ ()9%_é\n"
    rows += [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 50)))) for i in range(400)]
    odd = ["a@b.c@d.e", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "1.2.3", "4111-1111-1111-1111 4111111111111112", "5", "+1 () 2", "+12345678+123456789", "x" * 5000, "1 " * 3000, "+1" * 2000, "a.b" * 2000 + "@", "é@b.c", "999999999999999999999.1.1.1", "0" * 16, "12-", "1--2"]
    rows += [(2000 + i, t) for i, t in enumerate(odd)]
    rows += [(3000, None), (3001, ""), (None, rows[0][1]), (None, "mail joe.x@mail.example.com now"), (7, rows[7][1]), (7, rows[8][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", "h", 5, 1) for i, t in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    got = pii.personal_data(frame(spark, rows)).collect()
    expect = Counter()
    for i, t in rows:
        b, s = want[t or ""]
        c = Counter(k for k, *_ in b)
        expect[(i, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(listed(b).encode()).hexdigest(), listed(s))] += 1
    assert Counter(map(tuple, got)) == expect
    assert any("removed" in r.spans or "generalised" in r.spans for r in got)


def test_redaction(spark):
    rows = corpus(2)
    want = brute(rows)
    out = pii.redact(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "base", "th", "n_chars", "start"]
    expect = Counter()
    for i, t in rows:
        if t and want[t][1]:
            new, at = "", 0
            for s, e, k in sorted((s, e, k) for k, s, e in want[t][1]):
                if s >= at:
                    new += t[at:s] + {"removed": "", "generalised": "[term]"}.get(k, f"[{k}]")
                at = max(at, e)
            expect[i, new + t[at:], len(new + t[at:])] += 1
        else:
            expect[i, t, 5] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out.collect()) == expect


def test_entities_that_occur_once(spark):
    """Most personal data is unique: a term that stands only there gives it away, a common word doesn't."""
    rows = [(i, f"common words stand here too, copy number {i}") for i in range(60)]
    rows += [(100, "common zyxwvut a.b@c.example words"), (101, "words common qwertz +1 523 555 1055"), (102, "words common qwertz +1 523 555 1055")]
    want = brute(rows)
    got = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got == {i: listed(want[t][1]) for i, t in rows}
    assert got[100] == "email:15:28,removed:7:14"
    assert got[101] == got[102] == "phone:20:35,removed:13:19"


def test_work_follows_the_text(spark):
    """Four times the matches take about four times as long, not sixteen."""
    import time

    took = {}
    for n in (5_000, 10_000, 20_000):
        df = frame(spark, [(1, "10.1.2.3 abcde " * n)])
        start = time.time()
        rows = pii.redact(df).collect() if n == 10_000 else pii.found(df).collect()
        took[n] = time.time() - start
        assert len(rows[0].text) == 11 * n if n == 10_000 else len(rows[0].base) == n
    assert took[20_000] < 8 * took[5_000], took


def test_terms_are_counted_alike_however_many(spark, monkeypatch):
    df = frame(spark, corpus(4))
    few = sorted(map(tuple, pii.personal_data(df).collect()), key=repr)
    monkeypatch.setattr(pii, "TERMS_SENT", -1)
    assert few == sorted(map(tuple, pii.personal_data(df).collect()), key=repr) and any("removed" in r[-1] for r in few)


def test_clashing_names(spark):
    names = ("pii_doc", "pii_th", "pii_at", "pii_spans", "pii_pieces")
    df = spark.createDataFrame([(1, "write to a.b@c.example now", *names)], ["doc_id", "text", *names])
    got = pii.redact(df)
    assert got.columns == df.columns and tuple(got.first())[2:] == names and "[email]" in got.first().text


def test_empty_and_clean(spark):
    assert pii.personal_data(frame(spark, [])).count() == 0
    got = pii.personal_data(frame(spark, [(1, "no data at all")])).collect()
    assert [r.spans for r in got] == [""]


def test_no_python_in_the_plan(spark):
    plan = pii.personal_data(frame(spark, corpus(3)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_texts_with_a_match_are_those_with_spans(spark):
    texts = [t for _, t in corpus(5)] + ["a@b", "a@b.c", "@b.c", "x.a@b.c@d.e", "1.2.3.4", "1.2.3", "999.1.1.1", "4111 1111 1111 1111", "4111111111111", "411111111111", "+1 234 567 890", "+1", "1234567890123456789012", None, ""]
    df = frame(spark, list(enumerate(texts)))
    got = df.select("doc_id", pii.has_match(F.col("text")).alias("may"), F.size(pii.base_spans(F.coalesce("text", F.lit("")))).alias("n")).collect()
    assert all(r.may for r in got if r.n > 0) and sum(r.may for r in got) < len(got)
