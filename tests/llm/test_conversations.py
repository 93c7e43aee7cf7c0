import random
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest

from tidewatch.llm import conversations as cv

WS = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def blank(t):
    return not t.strip(WS)


def legal(initials):
    rest = initials.removeprefix("s")
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def begins(initials):
    """Whether a legal conversation begins so."""
    rest = initials.removeprefix("s")
    return rest == ("ua" * len(rest))[: len(rest)]


def cheapest(turns):
    """All edits of short conversations that cost no more than deleting every turn: (cost, audit, lines)."""
    faults, seen = [], set()
    for _, role, text in turns:
        faults.append("blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WS)[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    stack = [(0, 0, "", "", ())]
    while stack:
        i, cost, audit, initials, lines = stack.pop()
        if cost > (best[0] if best else 2 * len(turns)) or not begins(initials):
            continue
        if i == len(turns) and legal(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        for name in ("user", "assistant"):
            stack.append((i, cost + 5, audit + "I", initials + name[0], (*lines, f"{name}:")))
        if i < len(turns):
            _, role, text = turns[i]
            stack.append((i + 1, cost + 2, audit + "D", initials, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                stack.append((i + 1, cost + more, audit + "K", initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    stack.append((i + 1, cost + 1 + more, audit + "R", initials + name[0], (*lines, f"{name}:{text}")))
    return faults, best


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        got = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        got += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], sha256(t[2].encode()).hexdigest()))
        faults, (cost, audit, lines) = cheapest(turns)
        have = [t for t, _, _ in turns if t is not None]
        gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def corpus(seed, n, longest):
    rng = random.Random(seed)
    texts = ["A b.", "c d!", "No end", "", " \t", "So?", "a.b", "A b."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "u"])
            rows.append((conv, rng.choice([None, turn, turn, turn * 3]), role, rng.choice([*texts, None, f"{turn}."])))
    return rows


def test_against_all_edits(spark):
    rows = corpus(1, 150, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    for parts, block in ((1, 256), (5, 1), (3, 2)):
        got = cv.repair(cv.damage(df.repartition(parts)), block)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_long_conversations_by_blocks(spark):
    """One conversation of most rows, with repeated texts: whole in one task, by blocks, and as SQL."""
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"t{k}.", f"u{k}"])) for k in range(900)]
    rows += [(8, k, "user", "x.") for k in range(3)] + corpus(4, 20, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    cur = con.execute(cv.oracle())
    names = [d[0] for d in cur.description]
    want = Counter(tuple(r) for r in cur.fetchall())
    for parts, block in ((1, 1 << 20), (6, 16), (2, 256)):
        got = cv.repair(cv.damage(df.repartition(parts)), block)
        assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y."), (2, 0, "assistant", "z.")], SCHEMA)
    clash = df.selectExpr("*", "1 AS part", "'q' AS turns", "2 AS seq")
    got = {r.conv_id: r for r in cv.repair(clash).collect()}
    assert (got[1].audit, got[1].cost) == ("KK", 0) and got[1].repaired_sha256 == sha256(f"user:{'x' * 3_000_000}.\nassistant:y.".encode()).hexdigest()
    assert (got[2].audit, got[2].cost, got[2].repaired_sha256) == ("D", 2, sha256(b"").hexdigest())
    assert cv.repair(cv.damage(df.limit(0))).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = cv.repair(cv.damage(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA))).first()
    assert tuple(one) == (gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_ranks_order_strings(seed):
    """The ranks of a layer are those of the strings that the parents spell."""
    rng = random.Random(seed)
    kinds = [rng.randrange(len(cv.KINDS)) for _ in range(9)]
    cells, parents = cv.programme((cv.STEPS[k] for k in kinds), range(4))
    spelled = {c: "".join(cv.CODES[k] for _, _, k in cv.path(parents, *c)) for c in cells}
    for a in cells:
        for b in cells:
            assert (cells[a][1] < cells[b][1]) == (spelled[a] < spelled[b])
