import math
import random
import zlib

import numpy as np

from tidewatch.llm import toxicity as tx
from tidewatch.llm.textops import BYTE, mix

SCHEMA = "doc_id long, text string, score double, toxic int"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    bad = ["zork", "blag", "frump"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 200))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ".", ","])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, y, None))
    return docs, labels


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, 7.0, 3) for i, t in docs], SCHEMA).repartition(2)
    return tx.score_toxicity(d, spark.createDataFrame(labels, LABELS)).collect()


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "zork blag"), (1000, None), (1001, ""), (1002, " \n"), (1003, "word " * 50_000 + "zork blag frump"), (5, docs[5][1])]
    got = run(spark, docs + odd, labels + [(None, 1, 1, None), (7777, 1, 0, None)])
    assert len(got) == len(docs) + len(odd)
    y = {r[0]: r[2] for r in labels}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    right = sum((r.score >= 0.3) == (y[r.doc_id] == 1) for r in held)
    assert right >= 0.9 * len(held)
    by = {r.doc_id: r for r in got}
    assert not by[None].held_out and by[1000].score == by[1001].score == by[1002].score == 0
    assert by[1003].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_without_a_class_or_rows(spark):
    docs, labels = corpus(20)
    assert {r.score for r in run(spark, docs, [r for r in labels if not r[2]])} == {0.0}
    assert run(spark, [], labels) == []


def test_windows_cover_all_words():
    doc = np.repeat(np.arange(5), [0, 1, 32, 33, 100])
    start, length, of = tx.windows(doc, 5)
    seen = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)])
    assert set(seen.tolist()) == set(range(166)) and (length <= tx.WINDOW).all() and (length > 0).all()
    assert (doc[start] == of).all() and (doc[start + length - 1] == of).all()


def test_gradients():
    rng = np.random.default_rng(0)
    net = tx.ToxicityNet(np.arange(5, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, size = rng.integers(0, 6, 2 * tx.WINDOW), rng.integers(1, 5, 2 * tx.WINDOW)
    bounds = np.concatenate([[0], np.cumsum(size)])
    pair = rng.integers(0, 40, bounds[-1])
    start, length, y = np.array([0, tx.WINDOW]), np.array([5, tx.WINDOW]), np.array([1, 0])

    def loss():
        z = net.forward(net.gates(ids, tx.char_means(net.p["P"], pair, bounds)), start, length)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    chars = tx.char_means(net.p["P"], pair, bounds)
    z, kept = net.forward(net.gates(ids, chars), start, length, keep=True)
    grads = net.backward(tx._sigmoid(z) - y, kept, start, len(ids), ids, chars)
    grads["P"] = net.pair_gradient(grads.pop("chars"), pair, bounds)
    assert set(grads) == set(net.p)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for k in rng.integers(0, len(flat) if name != "P" else 40 * tx.CHAR_DIM, 3):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-3 - g.reshape(-1)[k]) < 2e-3 * (1 + abs(g.reshape(-1)[k])), name


def naive_score(net, text):
    """A text's score by plain loops: words, windows, both directions, attention."""
    m64, words = (1 << 64) - 1, []
    raw, word = text.encode(), []
    for k, b in enumerate([*raw, 32]):
        if b in (32, 9, 10, 11, 12, 13):
            if word:
                words.append(word)
            word = []
        else:
            word.append((b + 32 if 65 <= b <= 90 else b, (raw[k + 1] + 32 if 65 <= raw[k + 1] <= 90 else raw[k + 1]) if k + 1 < len(raw) else 0))

    def vector(word):
        h = 0
        for i, (b, _) in enumerate(word):
            value = int(BYTE[b]) if b >= 128 or chr(b).isalnum() else 0
            h = (h + value * pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64)) & m64
        h = int(mix(np.array([h], np.uint64))[0])
        row = next((k + 1 for k, v in enumerate(net.vocab.tolist()) if v == h), 0)
        chars = sum(net.p["P"][(n * 31 + b * 257) % tx.PAIRS] for b, n in word) / len(word)
        return net.p["E"][row] @ net.p["Wx"] + net.p["b"] + chars @ net.p["Wc"]

    sig = lambda x: 1 / (1 + math.exp(-x))
    best, k, lo = 0.0, tx.HIDDEN, 0
    xs = [vector(w) for w in words]
    while xs:
        win = xs[lo : lo + tx.WINDOW]
        states = [[], []]
        for d, u in enumerate((net.p["Uf"], net.p["Ub"])):
            h = [0.0] * k
            for x in win if d == 0 else win[::-1]:
                x, v = x[d * 3 * k : (d + 1) * 3 * k], np.array(h) @ u
                z, r = [sig(x[i] + v[i]) for i in range(k)], [sig(x[k + i] + v[k + i]) for i in range(k)]
                c = [math.tanh(x[2 * k + i] + r[i] * v[2 * k + i]) for i in range(k)]
                h = [z[i] * h[i] + (1 - z[i]) * c[i] for i in range(k)]
                states[d].append(h)
        both = [[*a, *b] for a, b in zip(states[0], states[1][::-1])]
        att = [math.exp(sum(a * s for a, s in zip(net.p["a"], st))) for st in both]
        logit = sum(a / sum(att) * sum(w * s for w, s in zip(net.p["w"], st)) for a, st in zip(att, both)) + net.p["c"][0]
        best = max(best, sig(logit))
        if lo + tx.WINDOW >= len(xs):
            break
        lo += tx.STRIDE
    return best


def test_scores_against_loops():
    docs, labels = corpus(120)
    net = tx.train([t for _, t in docs], [r[2] for r in labels])
    texts = ["", " ", docs[0][1], docs[1][1], "Zork, BLAG. caf\u00e9 \u6f22\u5b57", "a " * 33 + "frump", docs[7][1] + "\n" + docs[8][1]]
    raws = [t.encode() for t in texts]
    got = net.score_documents(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
    assert np.allclose(got, [naive_score(net, t) for t in texts], atol=2e-5)


def test_training_beats_the_start():
    """Marks that are words of their own each time: only their characters tell, which word odds can't see."""
    rng = random.Random(3)
    docs, y = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(10, 40))]
        y.append(int(i % 3 == 0))
        for _ in range(3 * y[-1]):
            words[rng.randrange(len(words))] = "xq" + "".join(rng.choice("abcdefg") for _ in range(5)) + "zq"
        docs.append(" ".join(words))
    held = [k for k in range(600) if k % 4 == 2]
    fit = [k for k in range(600) if k % 4 != 2]

    def right(epochs):
        net = tx.train([docs[k] for k in fit], [y[k] for k in fit], epochs=epochs)
        raws = [docs[k].encode() for k in held]
        score = net.score_documents(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
        return float(np.mean([max((score[i] >= t) == y[k] for t in (tx.THRESHOLD,)) for i, k in enumerate(held)]))

    assert right(tx.EPOCHS) >= 0.9 > right(0) + 0.1


def test_clashing_names_and_repeated_ids(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame([(i, t, 7.0) for i, t in docs + [(0, "again " + docs[0][1])] * 50], "doc_id long, text string, toxicity_score double")
    kept = tx.drop_toxic(d, spark.createDataFrame(labels, LABELS))
    assert kept.columns == d.columns and kept.select("toxicity_score").distinct().count() <= 1
