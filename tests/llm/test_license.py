import random
from functools import lru_cache
from itertools import combinations

from tidewatch.llm import license as lic

SCHEMA = "doc_id long, text string, license string, coverage int"


def lcs(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def slow_patience(a, b):
    """The definition, by recursion and the best of all increasing subsequences."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + slow_patience(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + slow_patience(a[:-1], b[:-1])
    pairs = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if not pairs:
        return 0

    # of the longest ones, that whose second parts, from the last on, are smallest
    rising = lambda c: all(y < z for (_, y), (_, z) in zip(c, c[1:]))
    for n in range(len(pairs), 0, -1):
        if longest := [c for c in combinations(pairs, n) if rising(c)]:
            best = min(longest, key=lambda c: [y for _, y in c][::-1])
            break
    total, i, p = 0, 0, 0
    for x, y in [*best, (len(a), len(b))]:
        total += slow_patience(a[i:x], b[p:y]) + (x < len(a))
        i, p = x + 1, y + 1
    return total


def test_alignment():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))]
        pairs = lic.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) == slow_patience(a, b) <= lcs(tuple(a), tuple(b))
    same = lic.words_of(lic.TEMPLATES["mit"])
    assert len(lic.align(same, same)) == len(same)


def test_increasing_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        ys = rng.sample(range(20), rng.randint(0, 12))
        got = lic._increasing(list(enumerate(ys)))
        best = 0
        for mask in range(1 << len(ys)):
            pick = [y for k, y in enumerate(ys) if mask >> k & 1]
            best = max(best, len(pick)) if pick == sorted(pick) else best
        assert len(got) == best


def test_scan(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["the", "of", "und", "mit", "work", "xy", "license", "under"]) for _ in range(n))
    rows, want = [], {}
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        ws = text.split()
        rows.append((i, f"{noise(50)}\n{text}\n{noise(4000)}"))
        want[i] = name
        if len(ws) > 20:
            del ws[5], ws[10]
            ws[3] = "changed"
            rows.append((100 + i, f"{noise(3)} {' '.join(ws).upper()} {noise(3)}"))
            want[100 + i] = name
    rows += [(200, lic.TEMPLATES["mit-notice"] + "\n" + lic.TEMPLATES["mit-notice"]), (201, None), (202, ""), (203, "plain words only"), (None, lic.TEMPLATES["isc"]), (204, "x " * 100_000 + lic.TEMPLATES["cc-by-nc-4.0-notice"]), (200, "other text")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = lic.license_scan(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 200}
    for i, name in want.items():
        # the notice opens the longer header too
        assert by[i].license == name or (name == "apache-2.0-header" and i < 100 and by[i].coverage == 1), (i, by[i])
        assert by[i].coverage >= (0.85 if i >= 100 else 1.0)
    assert by[None].license == "isc" and by[204].license == "cc-by-nc-4.0-notice" and by[204].start_word == 100_000
    assert {by[k].license for k in (201, 202, 203)} == {None}
    assert sorted(str(r.license) for r in got if r.doc_id == 200) == ["None", "mit-notice"]
    assert lic.license_scan(df.limit(0)).count() == 0


def test_telling_words_and_texts(spark):
    rows = [
        ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0-notice"),
        ("this file is distributed under the BSD license", "bsd-notice"),
        ("the film was released under the title of the book", None),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0-notice"),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl-2.0-notice"),
        ("This work is licensed under the Example General Public License, version 9.", None),
    ]
    for name in ("bsd-2-clause", "bsd-3-clause", "mpl-2.0", "lgpl-2.1", "cc0-1.0"):
        ws = lic.bodies()[f"{name}-text"].split()
        rows.append((" ".join(["some words before"] * 40 + ws), f"{name}-text"))
    df = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(rows)], SCHEMA)
    got = {r.doc_id: r.license for r in lic.license_scan(df).collect()}
    assert got == {i: name for i, (_, name) in enumerate(rows)}


def test_scan_against_brute_force():
    """Never less than patience on the whole text, nor more than the longest common subsequence."""
    rng = random.Random(4)
    templates = {"a": "one two three four five six seven eight nine ten", "b": "red green two blue grey the of the", "c": "nine ten the of"}
    scanner = lic.Scanner(templates)
    found = 0
    for _ in range(400):
        text = []
        for t in rng.sample(sorted(templates), rng.randint(0, 2)):
            for w in templates[t].split():
                text += [w] * (rng.random() < 0.8) + ["x"] * rng.choice([0, 0, 0, 1, 9])
            text += rng.choices(["the", "of", "x", "ten", "y"], k=rng.randint(0, 4))
        got = scanner.scan(" ".join(text))
        least, most = {}, {}
        for name, t in templates.items():
            ws = t.split()
            own = [w for w in text if w in ws]
            need = -(-len(ws) * 6 // 10)
            least[name] = (n if (n := slow_patience(own, ws)) >= need else 0) / len(ws)
            most[name] = lcs(tuple(own), tuple(ws)) / len(ws)
        found += got is not None
        if got is None:
            assert not any(least.values())
        else:
            assert max(least.values()) <= got[1] <= most[got[0]] and got[1] >= lic.MIN_COVERAGE
            assert text[got[3]] in templates[got[0]].split()
    assert found > 100


def test_parts_far_apart_and_repeated(spark):
    ws = lic.TEMPLATES["mit"].split()
    apart = " ".join(ws[:40] + [f"w{k}" for k in range(600)] + ws[40:])
    copies = " x ".join([lic.TEMPLATES["isc"]] * 5)
    df = spark.createDataFrame([(1, apart, "x", 1), (2, copies, "x", 1)], SCHEMA)
    got = {r.doc_id: (r.license, r.coverage) for r in lic.license_scan(df).collect()}
    assert got == {1: ("mit", 1.0), 2: ("isc", 1.0)}
