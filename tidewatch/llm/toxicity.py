"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Words enter by an embedding of the training vocabulary (unknown words share one) and by the mean of the embeddings of their
character pairs; both tables are trained with the rest. A GRU runs over each window of words in both directions, attention pools its states,
and a logistic unit scores the window. All overlapping windows of a text are scored; the text's score is the highest. A
document's label says only that some window is toxic, so training picks each toxic document's highest window anew.

Labels come from at most MAX_TRAIN_TOXIC and MAX_TRAIN_CLEAN labelled rows outside the held-out fold, chosen by a hash of
doc_id among texts of at most MAX_TRAIN_CHARS characters, one text for each doc_id: a bounded fit on the driver. Scoring is one pass without a
shuffle; only the network's weights are sent to the executors.

Defined cases: a null or empty text, or one of white space only, scores 0; a null doc_id is never held out and never
trains; documents of equal doc_id are scored each, and the first of their texts trains; very long texts are scored window by
window, whole; a score at the threshold is toxic; without toxic or without clean labels every score is 0; extra columns are
ignored or kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, text_chunks
from .textops import BYTE, WS, Prefix, mix, words

MAX_TRAIN_TOXIC = 800
MAX_TRAIN_CLEAN = 2000
MAX_TRAIN_CHARS = 20_000
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, PAIRS = 8, 8, 6, 4096
#: A word is known if it is in this share of the training texts, and in MIN_DOCS at least.
MIN_SHARE, MIN_DOCS = 1 / 300, 4
EPOCHS = 8
DECAY = 2e-3
THRESHOLD = 0.3
#: Bytes of text scored at a time.
CHUNK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and bytes of longer characters count in a word's hash; marks after a word don't change it.
_LETTER = BYTE[_LOWER].copy()
_LETTER[[b for b in range(128) if not chr(b).isalnum()]] = 0


def featurize(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of every word, the character pairs of all words one after another, and where each word's begin.

    A word's last pair is its last byte and what follows it, 0 at the end of a text.
    """
    s, e, doc = words(raw, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), doc, np.zeros(0, np.int16), np.zeros(1, np.int64)
    h = mix(Prefix(_LETTER[raw]).of(s, e, final=False))
    low = _LOWER[raw].astype(np.int32)
    after = np.append(low[1:], 0)
    after[offsets[1:][offsets[1:] > 0] - 1] = 0
    pair = ((after * 31 + low * 257) % PAIRS).astype(np.int16)
    bounds = np.concatenate([[0], np.cumsum(e - s)])
    return h, doc, pair[~WS[raw]], bounds


def char_means(table: np.ndarray, pair: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the pairs' embeddings of each word."""
    if len(bounds) < 2:
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[pair], bounds[:-1], axis=0) / np.diff(bounds)[:, None].astype(np.float32)


def windows(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and document of every window; each text's last window ends with its last word."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    of = np.repeat(np.arange(n_docs), k)
    j = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    return first[of] + j * STRIDE, np.minimum(WINDOW, n[of] - j * STRIDE), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class ToxicityNet:
    """The network; `vocab`: sorted hashes of known words, whose embeddings are rows 1.. (0: unknown)."""

    def __init__(self, vocab: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = lambda *s: (0.3 * rng.standard_normal(s)).astype(np.float32)
        self.vocab = vocab
        self.p = {"E": n(len(vocab) + 1, WORD_DIM), "Wx": n(WORD_DIM, 6 * HIDDEN), "Wc": 0.1 * n(CHAR_DIM, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32), "Uf": n(HIDDEN, 3 * HIDDEN), "Ub": n(HIDDEN, 3 * HIDDEN), "a": n(2 * HIDDEN), "w": n(2 * HIDDEN), "c": np.full(1, -1.0, np.float32)}
        self.p["P"] = rng.standard_normal((PAIRS, CHAR_DIM)).astype(np.float32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)

    def gates(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Each word's share of all gate inputs."""
        return (self.p["E"] @ self.p["Wx"] + self.p["b"])[ids] + chars @ self.p["Wc"]

    def block(self, ids: np.ndarray, pair: np.ndarray, bounds: np.ndarray, start: np.ndarray, length: np.ndarray, rng: np.random.Generator | None = None):
        """Gate inputs of the words of some windows, each window's words on their own; with `rng`, some words unknown."""
        at = (start[:, None] + np.minimum(np.arange(WINDOW)[None, :], length[:, None] - 1)).ravel()
        size = bounds[at + 1] - bounds[at]
        own = np.concatenate([[0], np.cumsum(size)])
        pairs = pair[np.arange(own[-1]) + np.repeat(bounds[at] - own[:-1], size)]
        bi, bc = ids[at], char_means(self.p["P"], pairs, own)
        if rng is not None:
            bi = np.where(rng.random(len(at)) < 0.1, 0, bi)
        return self.gates(bi, bc), np.arange(len(start)) * WINDOW, length, bi, bc, (pairs, own)

    def pair_gradient(self, chars: np.ndarray, pair: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of the table of pairs, from that of the words' means."""
        size = np.diff(bounds)
        each = np.repeat(chars / size[:, None], size, axis=0)
        return np.stack([np.bincount(pair, weights=each[:, k], minlength=PAIRS) for k in range(CHAR_DIM)], axis=1)

    def forward(self, g: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of the windows over the words' gate inputs; with `keep`, also what backward() needs."""
        p, n, k = self.p, len(start), HIDDEN
        last = len(g) - 1
        states = np.zeros((WINDOW, n, 2 * k), np.float32)
        saved: list = [[None] * WINDOW, [None] * WINDOW]
        for d, (u, steps) in enumerate(((p["Uf"], range(WINDOW)), (p["Ub"], range(WINDOW - 1, -1, -1)))):
            h = np.zeros((n, k), np.float32)
            for t in steps:
                on = (t < length).astype(np.float32)[:, None]
                x = g[np.minimum(start + t, last), d * 3 * k : (d + 1) * 3 * k]
                v = h @ u
                zr = _sigmoid(x[:, : 2 * k] + v[:, : 2 * k])
                z, r = zr[:, :k], zr[:, k:]
                c = np.tanh(x[:, 2 * k :] + r * v[:, 2 * k :])
                new = h + on * (1 - z) * (c - h)
                if keep:
                    saved[d][t] = (on, z, r, c, h, v[:, 2 * k :])
                h = new
                states[t, :, d * k : (d + 1) * k] = h
        mask = np.arange(WINDOW)[:, None] < length[None, :]
        s = np.where(mask, states @ p["a"], -1e9)
        s = np.exp(s - s.max(axis=0))
        att = s / s.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", att, states)
        logit = pooled @ p["w"] + p["c"][0]
        return (logit, (states, saved, att, pooled, mask)) if keep else logit

    def backward(self, dlogit: np.ndarray, kept, start: np.ndarray, words_: int, ids: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
        states, saved, att, pooled, _ = kept
        p, k = self.p, HIDDEN
        out = {"w": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["w"]
        datt = np.einsum("nk,tnk->tn", dpool, states)
        ds = att * (datt - (att * datt).sum(axis=0))
        out["a"] = np.einsum("tn,tnk->k", ds, states)
        dstates = att[:, :, None] * dpool + ds[:, :, None] * p["a"]
        dg = np.zeros((words_, 6 * k), np.float32)
        for d, (name, steps) in enumerate((("Uf", range(WINDOW - 1, -1, -1)), ("Ub", range(WINDOW)))):
            u = p[name]
            du, dh = np.zeros_like(u), np.zeros((len(start), k), np.float32)
            for t in steps:
                on, z, r, c, h, vn = saved[d][t]
                dh = dh + dstates[t, :, d * k : (d + 1) * k]
                dnew = on * dh
                dc = dnew * (1 - z) * (1 - c * c)
                dz = dnew * (h - c) * z * (1 - z)
                dr = dc * vn * r * (1 - r)
                dv = np.concatenate([dz, dr, dc * r], axis=1)
                du += h.T @ dv
                np.add.at(dg[:, d * 3 * k : (d + 1) * 3 * k], np.minimum(start + t, words_ - 1), np.concatenate([dz, dr, dc], axis=1))
                dh = dh * (1 - on) + dnew * z + dv @ u.T
            out[name] = du
        out["b"], out["Wc"] = dg.sum(axis=0), chars.T @ dg
        out["chars"] = dg @ p["Wc"].T  # of the words' means
        emb = p["E"][ids]
        out["Wx"] = emb.T @ dg
        out["E"] = np.zeros_like(p["E"])
        np.add.at(out["E"], ids, dg @ p["Wx"].T)
        return out

    def score_documents(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window score of each text; 0 without words."""
        n = len(offsets) - 1
        h, doc, pair, bounds = featurize(raw, offsets)
        best = np.zeros(n)
        if not len(h):
            return best
        g = self.gates(self.lookup(h), char_means(self.p["P"], pair, bounds))
        start, length, of = windows(doc, n)
        for lo in range(0, len(start), 4096):
            part = slice(lo, lo + 4096)
            np.maximum.at(best, of[part], _sigmoid(self.forward(g, start[part], length[part]).astype(np.float64)))
        return best


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 11) -> ToxicityNet | None:
    """Fits the network; None if one class is missing. With `epochs` 0, the start: word embeddings by the words' odds."""
    y = np.array(toxic, np.int64)
    parts = []
    for lo in range(0, len(texts), 100):
        raws = [t.encode() for t in texts[lo : lo + 100]]
        got = featurize(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
        parts.append((got[0], got[1] + lo, got[2], np.diff(got[3])))
    if not parts:
        return None
    h, doc, pair, size = map(np.concatenate, zip(*parts))
    bounds = np.concatenate([[0], np.cumsum(size)])
    del parts
    if y.min(initial=1) == y.max(initial=0) or not len(h):
        return None
    kinds, inv = np.unique(h, return_inverse=True)
    seen = np.unique(inv * np.int64(len(y)) + doc)
    df = np.bincount(seen // len(y), minlength=len(kinds))
    pos = np.bincount(seen // len(y), weights=y[seen % len(y)], minlength=len(kinds))
    known = df >= max(MIN_DOCS, MIN_SHARE * len(y))
    net = ToxicityNet(kinds[known], seed)
    ids = net.lookup(h)
    neg = df - pos
    odds = np.log(((pos + 0.3) / (y.sum() + 0.6)) / ((neg + 0.3) / ((1 - y).sum() + 0.6)))
    odds = np.maximum(odds - 1.3 * np.sqrt(1 / (pos + 0.5) + 0.3 / (neg + 0.5)), np.minimum(odds, 0))[known]
    net.p["E"][1:, 0] = np.clip(odds, -2, 4)  # a start that tells which window made a document toxic
    net.p["E"][0] = 0
    start, length, of = windows(doc, len(y))
    lead = np.concatenate([[0], np.cumsum(np.maximum(net.p["E"][ids, 0], 0))])
    score = lead[start + length] - lead[start]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    epochs = int(np.clip(24_000 // len(y), epochs, 60)) if epochs else 0  # small samples need more rounds for as many steps
    for epoch in range(epochs):
        if epoch:
            score = np.concatenate([net.forward(*net.block(ids, pair, bounds, start[lo : lo + 4096], length[lo : lo + 4096])[:3]) for lo in range(0, len(start), 4096)])
        o = np.lexsort((-score, of))
        rank = np.empty(len(o), np.int64)
        rank[o] = np.arange(len(o)) - np.searchsorted(of[o], of[o])
        use = np.flatnonzero((rank == 0) | ((y[of] == 0) & ((rank == 1) | (rng.random(len(of)) < 0.05))))
        rng.shuffle(use)
        # a toxic label without any window that looks toxic is taken for noise, more so as training goes on
        trust = np.maximum(0.03, _sigmoid(score[use] - (0 if epoch else 1)) ** min(1.0, 0.3 + 2 * epoch / epochs))
        weight = np.where(y[of[use]] == 1, 2.0 * trust, 1.0)
        for lo in range(0, len(use), 256):
            b = use[lo : lo + 256]
            g, s0, _, bi, bc, own = net.block(ids, pair, bounds, start[b], length[b], rng)
            logit, kept = net.forward(g, s0, length[b], keep=True)
            d = ((_sigmoid(logit) - y[of[b]]) * weight[lo : lo + 256] / len(b)).astype(np.float32)
            grads = net.backward(d, kept, s0, len(bi), bi, bc)
            grads["P"] = net.pair_gradient(grads.pop("chars"), *own)
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for k, gr in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * gr
                v2[k] = 0.99 * v2[k] + 0.01 * gr * gr
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                net.p[k] *= np.float32(1 - rate * DECAY * (1 if k in "EP" else 5))
    return net


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityNet | None:
    """The network from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    order = [F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary")), F.col("doc_id")]
    chosen = {}
    for label, n in ((1, MAX_TRAIN_TOXIC), (0, MAX_TRAIN_CLEAN)):
        for r in known.where(F.col("toxic") == label).orderBy(*order).limit(n).collect():
            chosen.setdefault(r.doc_id, label)
    if len(set(chosen.values())) < 2:
        return None
    text = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen)) & (F.length("text") <= MAX_TRAIN_CHARS) & F.col("text").isNotNull())
    # a row for each chosen doc_id
    rows = sorted((r.doc_id, r.text) for r in text.groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    return train([t for _, t in rows], [chosen[i] for i, _ in rows]) if rows else None


def _scored(docs: DataFrame, net: ToxicityNet | None) -> tuple[DataFrame, str]:
    """All columns of `docs` and, last, the text's score; the name of that column."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # of a size that the constants above bound
    (name,) = free_names(docs, "toxicity_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for lo, hi, raw, off in text_chunks(b, limit=CHUNK):
                score = m.score_documents(raw, off) if m else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), pa.array(score)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored, name = _scored(docs.select("doc_id", "text"), fit(docs, labels))
    score = F.col(name)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that are not predicted toxic."""
    scored, name = _scored(docs, fit(docs, labels))
    return scored.where(F.col(name) < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
