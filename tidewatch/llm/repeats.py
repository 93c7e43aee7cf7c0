"""Removal of repeated byte strings by prefix-free parsing.

Parse. A TRIGGER-byte string is a trigger where its rolling hash is 0 modulo MODULUS. A LENGTH-byte window belongs to the
first trigger inside it; in stretches without any, windows belong to the lowest hash inside them, so that no phrase grows
without bound. A text so falls into phrases: the windows of one trigger, with all their bytes. Equal windows have equal
triggers at equal places, wherever they stand.

Dictionary. Equal phrases hold equal windows, so of each distinct phrase only the first occurrence in corpus order
(doc_id, then start) can hold a first window; all windows of later occurrences are repeats. Distinct phrases with a trigger
of their own have nothing left to compare.

Suffix arrays. The windows of a trigger are what stands before it (the end of a dictionary phrase) and what follows it
(the parse from here on). Per range of triggers, the distinct phrases' ends, read backwards, and the parse's continuations
are sorted as bytes, with the lengths that neighbours have in common. The window that begins d bytes before its trigger
equals another one if they lie in one run of the first array at depth d and in one of the second at depth LENGTH - d;
of each such class, all but the first in corpus order are repeats.

No key makes a task. A batch of texts settles its own repeats first. Of each trigger it sends one row to the trigger's
range: the phrase, if it has one only, or else how many; several phrases go by their own hash, as they need no comparison
to be known to share a trigger. A trigger with more phrases than a fair share (at most HOT_KEYS of them in the whole corpus)
has its windows dealt one by one by their own hash instead, each batch sending each distinct window once.

Phrases are identified by 160 bits (trigger, two hashes of the phrase), windows of ranges by their bytes, those of hot
triggers by 96 bits. Memory is bounded by a batch and by a range, whose number follows the input.

Defined cases: null texts count as empty, texts shorter than LENGTH keep all; texts beyond a chunk are parsed alone; null
doc_ids come first; rows of equal doc_id are taken for the same place in the order, so that a string in one is a repeat of
another's only if it starts earlier in its text; extra columns are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, text_chunks
from .textops import BYTE2, Prefix, mix

LENGTH = 100
TRIGGER = 24
MODULUS = 64
#: Bytes of text parsed at a time.
CHUNK = 1 << 19
#: A trigger with more distinct phrases is hot; there are HOT_KEYS of them at most, the largest.
HOT_LEAST, HOT_KEYS = 2048, 500_000

_DEEP = LENGTH - TRIGGER
_NULL = -(1 << 63)  # stands for a null doc_id: it sorts first
_SEG = np.dtype([("key", "<u8"), ("h", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("th", "<u4"), ("n", "<u1")])
_SPAN = np.dtype([("doc", "<i8"), ("th", "<u4"), ("start", "<u4"), ("end", "<u4")])
_MARK = np.dtype([("key", "<u8"), ("n", "<u4")])
_ROW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("th", "<u4"), ("start", "<u4"), ("d", "<u1"), ("n", "<u1")])
_WINDOW = np.dtype([("h", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("start", "<u4"), ("th", "<u4")])
#: Kinds of blobs: one phrase of a trigger, spans, phrases that are known to share their trigger, numbers of these; rows to
#: compare, windows of hot triggers.
ALONE, SPANS, SHARING, MARKS, ROWS, WINDOWS = range(6)
_BLOBS = "bucket int, kind int, blob binary"
_SPANS = "doc long, th long, start long, stop long, kind int"
#: Kinds of spans: bytes to remove; a phrase whose windows are to be compared; a trigger (doc) with `start` phrases.
REMOVE, COMPARE, HOT = 0, 1, 2


def _triggers(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(g & np.uint64(MODULUS - 1) == 0)


def phrases(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Trigger hash, two hashes, document, first window's start and number of windows of every phrase."""
    z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(raw)
    s = np.flatnonzero(np.diff(offsets) >= length)
    if not len(s):
        return u, u, u, z, z, z
    pre = Prefix(raw)
    at = np.arange(n - k + 1)
    g = pre.of(at, at + k)
    low, have = g, 1
    w = length - k + 1
    while 2 * have <= w:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = w - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    starts = np.concatenate([np.arange(offsets[d], offsets[d + 1] - length + 1) for d in s])
    marks = np.append(_triggers(g), 2 * n)
    place = marks[np.searchsorted(marks, starts)]
    has = place <= starts + (length - k)
    place[~has] = -1
    m = np.where(has, g[np.minimum(place, len(g) - 1)], low[starts])
    first = np.ones(len(starts), bool)
    first[1:] = (starts[1:] != starts[:-1] + 1) | (m[1:] != m[:-1]) | (place[1:] != place[:-1]) | (~has[1:] & (g[starts[:-1]] == m[:-1]))
    lo = np.flatnonzero(first)
    count = np.diff(np.append(lo, len(starts)))
    begin = starts[lo]
    end = begin + count - 1 + length
    h2 = Prefix(BYTE2[raw]).of(begin, end)
    return m[lo], pre.of(begin, end), h2, np.searchsorted(offsets, begin, "right") - 1, begin, count


def _firsts(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order, and whether each sorted row has an equal one earlier in the corpus."""
    o = np.lexsort((start, doc, h2, h))
    k, k2, d, s = h[o], h2[o], doc[o], start[o]
    head = np.ones(len(o), bool)
    head[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    at = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))
    return o, (d != d[at]) | (s != s[at])


def _merge(spans: np.ndarray) -> np.ndarray:
    """Spans of each document joined where they touch."""
    o = np.lexsort((spans["start"], spans["th"], spans["doc"]))
    s = spans[o]
    if not len(s):
        return s
    same = (s["doc"][1:] == s["doc"][:-1]) & (s["th"][1:] == s["th"][:-1])
    group = np.concatenate([[0], np.cumsum(~same)]).astype(np.int64)
    reach = np.maximum.accumulate(s["end"].astype(np.int64) + (group << 33)) - (group << 33)  # farthest end so far, by document
    new = np.ones(len(s), bool)
    new[1:] = ~same | (s["start"][1:] > reach[:-1])
    at = np.flatnonzero(new)
    out = s[at].copy()
    out["end"] = reach[np.append(at[1:], len(s)) - 1]
    return out


def _spanning(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _SPAN)
    out["doc"], out["th"], out["start"], out["end"] = a["doc"], a["th"], start, end
    return out


def _send(parts: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> Iterator[pa.RecordBatch]:
    """Blobs by kind and bucket; parts: kind, rows and what they are dealt by."""
    for kind, a, by in parts:
        b = (mix(by.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        o = np.argsort(b, kind="stable")
        a, b = a[o], b[o]
        cut = np.searchsorted(b, np.arange(n + 1))
        used = np.flatnonzero(np.diff(cut))
        if len(used):
            yield _blobs(used, kind, [_pack(a[cut[i] : cut[i + 1]]) for i in used])


def _blobs(buckets: np.ndarray, kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), kind, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _pack(a: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a[c]).tobytes() for c in a.dtype.names)


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for c in kind.names:
        out[c] = np.frombuffer(blob, kind[c], n, at)
        at += n * kind[c].itemsize
    return out


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc_id").fill_null(_NULL).to_numpy(), (batch.column("th").to_numpy() & 0xFFFFFFFF).astype(np.uint32)


def _settle(parts: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """A batch's own repeats, and its distinct phrases."""
    segs = np.concatenate(parts)
    o, again = _firsts(segs["h"], segs["h2"], segs["doc"], segs["start"])
    segs = segs[o]
    gone, segs = segs[again], segs[~again]
    keys, inverse, count = np.unique(segs["key"], return_inverse=True, return_counts=True)
    several = count[inverse] > 1
    marks = np.empty(int((count > 1).sum()), _MARK)
    marks["key"], marks["n"] = keys[count > 1], count[count > 1]
    local = _merge(_spanning(gone, gone["start"], gone["start"] + gone["n"] - 1 + LENGTH))
    yield from _send([(ALONE, segs[~several], segs["key"][~several]), (MARKS, marks, marks["key"]), (SHARING, segs[several], segs["h"][several]), (SPANS, local, local["doc"])], n)


def _parse(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, th = _ids(b)
            parts = []
            for lo, _, raw, off in text_chunks(b, limit=CHUNK):
                key, h, h2, doc, begin, count = phrases(raw, off)
                a = np.empty(len(key), _SEG)
                a["key"], a["h"], a["h2"], a["doc"], a["th"], a["start"], a["n"] = key, h, (h2 >> np.uint64(32)).astype(np.uint32), doc_ids[lo + doc], th[lo + doc], begin - off[doc], count
                parts.append(a)
            if parts:
                yield from _settle(parts, n)

    return run


def _gathered(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    kinds, blobs = table.column("kind").to_pylist(), table.column("blob")
    return np.concatenate([np.zeros(0, dtype), *(_unpack(x.as_py(), dtype) for k, x in zip(kinds, blobs) if k == kind)])


def _dictionary(least: int):
    """Of one bucket: spans that repeat an earlier phrase, the phrases that share their trigger with others, and triggers
    with more than `least` phrases."""

    def run(table: pa.Table) -> pa.Table:
        whole = lambda s: _spanning(s, s["start"], s["start"] + s["n"] - 1 + LENGTH)
        gone, left = [_gathered(table, SPANS, _SPAN)], []
        marks = _gathered(table, MARKS, _MARK)
        for kind in (ALONE, SHARING):
            segs = _gathered(table, kind, _SEG)
            o, again = _firsts(segs["h"], segs["h2"], segs["doc"], segs["start"])
            segs = segs[o]
            gone.append(whole(segs[again]))
            segs = segs[~again]
            if kind == ALONE:
                # an equal phrase at the same place, of a repeated row, is no other phrase
                new = np.ones(len(segs), bool)
                new[1:] = (segs["h"][1:] != segs["h"][:-1]) | (segs["h2"][1:] != segs["h2"][:-1])
                keys, inverse = np.unique(np.concatenate([segs["key"], marks["key"]]), return_inverse=True)
                count = np.bincount(inverse, weights=np.concatenate([new, marks["n"]]), minlength=len(keys)).astype(np.int64)
                segs = segs[count[inverse[: len(segs)]] > 1]
            left.append(whole(segs))
        gone, left = _merge(np.concatenate(gone)), np.concatenate(left)
        hot = np.zeros(int((count > least).sum()), _SPAN)
        hot["doc"], hot["start"] = keys[count > least].view(np.int64), np.minimum(count[count > least], (1 << 32) - 1)
        return _spans(np.concatenate([gone, left, hot]), np.repeat([REMOVE, COMPARE, HOT], [len(gone), len(left), len(hot)]))

    return run


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each run, one after another."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _to_compare(n: int, hot: np.ndarray):
    """The phrases to compare, with their bytes, dealt by trigger; those of hot triggers window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, th = _ids(b)
            spans = b.column("spans")
            cut, pairs = spans.offsets.to_numpy(), spans.flatten()
            begin, stop = pairs.field("start").to_numpy(), pairs.field("stop").to_numpy()
            windows = [np.zeros(0, _WINDOW)]
            for lo, hi, raw, off in text_chunks(b, limit=CHUNK):
                a, e = cut[lo] - cut[0], cut[hi] - cut[0]
                if a == e:
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                s, size = begin[a:e] + off[doc], stop[a:e] - begin[a:e]
                pre = Prefix(raw)
                grams = s[:, None] + np.arange(_DEEP + 1)[None, :]
                g = pre.of(grams.ravel(), grams.ravel() + TRIGGER).reshape(grams.shape)
                on = g & np.uint64(MODULUS - 1) == 0
                d = np.where(on.any(axis=1), on.argmax(axis=1), g.argmin(axis=1))
                row = np.empty(len(s), _ROW)
                row["key"], row["doc"], row["th"], row["start"], row["d"], row["n"] = g[np.arange(len(s)), d], doc_ids[lo + doc], th[lo + doc], s - off[doc], d, size - LENGTH + 1
                at = np.minimum(np.searchsorted(hot, row["key"]), max(len(hot) - 1, 0))
                is_hot = hot[at] == row["key"] if len(hot) else np.zeros(len(s), bool)
                yield from _rows(row[~is_hot], raw, s[~is_hot], size[~is_hot], n)
                if is_hot.any():
                    many = row["n"][is_hot].astype(np.int64)
                    w = _ragged(s[is_hot], many)
                    x = np.empty(len(w), _WINDOW)
                    of = np.repeat(np.flatnonzero(is_hot), many)
                    x["h"], x["h2"] = pre.of(w, w + LENGTH), (Prefix(BYTE2[raw]).of(w, w + LENGTH) >> np.uint64(32)).astype(np.uint32)
                    x["doc"], x["th"], x["start"] = row["doc"][of], row["th"][of], w - off[doc[of]]
                    windows.append(x)
            x = np.concatenate(windows)
            o, again = _firsts(x["h"], x["h2"], x["doc"], x["start"])
            x = x[o]
            local = _merge(_spanning(x[again], x["start"][again], x["start"][again] + LENGTH))
            yield from _send([(WINDOWS, x[~again], x["h"][~again]), (SPANS, local, local["doc"])], n)

    return run


def _rows(row: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Blobs of rows: their number, the rows, then their bytes."""
    if not len(row):
        return
    bucket = (mix(row["key"]) % np.uint64(n)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    used, lead = np.unique(bucket[o], return_index=True)
    blobs = []
    for lo, hi in zip(lead, np.append(lead[1:], len(o))):
        k = o[lo:hi]
        blobs.append(len(k).to_bytes(4, "little") + _pack(row[k]) + raw[_ragged(start[k], size[k])].tobytes())
    yield _blobs(used, ROWS, blobs)


def _sorted_lcp(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of rows of bytes, by key, and what each has in common with the one before (-1: another key)."""
    whole = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), text], axis=1)
    o = np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")
    k, t = key[o], text[o]
    lcp = np.full(len(o), -1, np.int64)
    if len(o) > 1:
        differ = t[1:] != t[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
        lcp[1:][k[1:] != k[:-1]] = -1
    return o, lcp


def equal_windows(row: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Spans of the windows that equal an earlier one of their trigger's; rows' bytes begin at `start` in `text`."""
    place = row["start"].astype(np.int64) + row["d"]
    o = np.lexsort((place, row["doc"]))  # from here on, rows are in corpus order
    row, start, place = row[o], start[o], place[o]
    d, n, m = row["d"].astype(np.int64), row["n"].astype(np.int64), len(row)
    new = np.ones(m, bool)
    new[1:] = (row["doc"][1:] != row["doc"][:-1]) | (place[1:] != place[:-1])
    rank = np.cumsum(new)
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    j = np.arange(_DEEP)[None, :]
    before = padded[np.where(j < d[:, None], start[:, None] + d[:, None] - 1 - j, len(text))]  # the phrase's end, backwards
    j = np.arange(LENGTH)[None, :]
    after = padded[np.where(j < (n + LENGTH - 1 - d)[:, None], start[:, None] + d[:, None] + j, len(text))]  # the parse from here on
    dictionary, common_before = _sorted_lcp(row["key"], before)
    parse, common_after = _sorted_lcp(row["key"], after)
    again = np.zeros((m, _DEEP + 2), bool)
    left, right = np.empty(m, np.int64), np.empty(m, np.int64)
    for depth in range(_DEEP + 1):
        on = (d - n < depth) & (depth <= d)
        if on.sum() < 2:
            continue
        left[dictionary], right[parse] = np.cumsum(common_before < depth), np.cumsum(common_after < LENGTH - depth)
        k = np.flatnonzero(on)
        both = left[k] * (m + 1) + right[k]
        s = np.argsort(both, kind="stable")
        both, k = both[s], k[s]
        head = np.ones(len(k), bool)
        head[1:] = both[1:] != both[:-1]
        lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
        again[k, depth + 1] = rank[k] != rank[k[lead]]
    r, low = np.nonzero(again[:, 1:] & ~again[:, :-1])  # runs of depths
    _, high = np.nonzero(again[:, 1:] & ~np.concatenate([again[:, 2:], np.zeros((m, 1), bool)], axis=1))
    return _spanning(row[r], place[r] - high, place[r] - low + LENGTH)


def _compare(table: pa.Table) -> pa.Table:
    """Of one bucket: the windows that an earlier one equals."""
    gone = [_gathered(table, SPANS, _SPAN)]
    heads, texts = [np.zeros(0, _ROW)], [b""]
    for k, blob in zip(table.column("kind").to_pylist(), table.column("blob")):
        if k == ROWS:
            blob = blob.as_py()
            size = 4 + int.from_bytes(blob[:4], "little") * _ROW.itemsize
            heads.append(_unpack(blob[4:size], _ROW))
            texts.append(blob[size:])
    row = np.concatenate(heads)
    if len(row):
        size = row["n"].astype(np.int64) + LENGTH - 1
        gone.append(equal_windows(row, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size))
    x = _gathered(table, WINDOWS, _WINDOW)
    o, again = _firsts(x["h"], x["h2"], x["doc"], x["start"])
    x = x[o][again]
    gone.append(_spanning(x, x["start"], x["start"] + LENGTH))
    gone = _merge(np.concatenate(gone))
    return _spans(gone, np.full(len(gone), REMOVE))


def _spans(s: np.ndarray, kind: np.ndarray) -> pa.Table:
    return pa.table([pa.array(s["doc"]), pa.array(s["th"].astype(np.int64)), pa.array(s["start"].astype(np.int64)), pa.array(s["end"].astype(np.int64)), pa.array(kind.astype(np.int32))], names=["doc", "th", "start", "stop", "kind"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc_ids, _ = _ids(b)
        spans = b.column("spans").to_pylist()
        out = []
        for lo, hi, raw, off in text_chunks(b):
            for i in range(lo, hi):
                text = raw[off[i - lo] : off[i - lo + 1]].tobytes()
                removed, runs, reach, kept, at = 0, 0, -1, hashlib.sha256(), 0
                for s in sorted(spans[i] or [], key=lambda x: x["start"]):
                    if s["start"] > reach:
                        runs += 1
                    if s["stop"] > reach:
                        removed += s["stop"] - max(s["start"], reach)
                        kept.update(text[at : max(at, s["start"])])
                        at = reach = s["stop"]
                kept.update(text[at:])
                out.append((len(text), removed, runs, kept.hexdigest()))
        cols = [pa.array(x) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Joins the documents' spans."""
    return texts.withColumn("doc", F.coalesce("doc_id", F.lit(_NULL))).join(spans, ["doc", "th"], how)


def repeated_spans(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc (doc_id, or the lowest long for null), th (hash of the text) and spans, an array of (start, stop) in bytes to
    remove, of every document that has any; spans may overlap."""
    texts = _texts(docs)
    n = 4 * max(2, texts.rdd.getNumPartitions())
    found = materialize(texts.mapInArrow(_parse(n), _BLOBS).groupBy("bucket").applyInArrow(_dictionary(hot_least), _SPANS), "repeats-phrases")
    release(docs.sparkSession)
    # HOT_KEYS numbers at most: the largest triggers
    hot = found.where(F.col("kind") == HOT).orderBy(F.col("start").desc(), "doc").limit(HOT_KEYS).select("doc").toPandas()["doc"].to_numpy(np.int64)
    pair = F.struct("start", "stop")
    open_ = found.where(F.col("kind") == COMPARE).groupBy("doc", "th").agg(F.collect_list(pair).alias("spans"))
    compared = _with_spans(texts, open_, "inner").select("doc_id", "th", "text", "spans").mapInArrow(_to_compare(n, np.sort(hot.view(np.uint64))), _BLOBS)
    again = materialize(compared.groupBy("bucket").applyInArrow(_compare, _SPANS), "repeats-windows")
    release(docs.sparkSession)
    gone = found.where(F.col("kind") == REMOVE).unionByName(again)
    return gone.groupBy("doc", "th").agg(F.collect_list(pair).alias("spans"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)).alias("th"))


def remove_repeats(docs: DataFrame, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spans = materialize(repeated_spans(docs, hot_least), "repeats-spans")
    joined = _with_spans(_texts(docs), spans, "left").select("doc_id", "th", "text", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: remove_repeats() over `documents` as DuckDB SQL: every window of every text.
ORACLE_SQL = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(doc_id, {_NULL}) AS d, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT id, d, s, b[s + 1 : s + {LENGTH}] AS x FROM (SELECT *, unnest(range(0, octet_length(b) - {LENGTH} + 1)) AS s FROM t WHERE octet_length(b) >= {LENGTH})),
f AS (SELECT id, s, (d, s) > min((d, s)) OVER (PARTITION BY x) AS again FROM w),
r AS (SELECT id, s, coalesce(s > lag(s) OVER (PARTITION BY id ORDER BY s) + {LENGTH}, true) AS fresh FROM f WHERE again),
g AS (SELECT id, s, sum(fresh::INTEGER) OVER (PARTITION BY id ORDER BY s) AS k FROM r),
p AS MATERIALIZED (SELECT id, k, min(s) AS lo, max(s) + {LENGTH} AS hi FROM g GROUP BY ALL),
q AS (SELECT id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY id ORDER BY lo), 0) AS done FROM p),
k AS (SELECT id, sum(hi - lo) AS gone, count(*) AS runs, string_agg(hex(b[done + 1 : lo]), '' ORDER BY lo) || hex(any_value(b)[max(hi) + 1 : octet_length(any_value(b))]) AS kept FROM q JOIN t USING (id) GROUP BY id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256 FROM t LEFT JOIN k USING (id)"""
