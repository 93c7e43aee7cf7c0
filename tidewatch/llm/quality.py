"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

Every text is cut into words (`[^\\x20\\x09-\\x0D]+`) as bytes. Rolling hashes give all 3- and 5..10-word windows and all
lines; the characters of words inside windows that occur twice or more in the text, and of lines that repeat an earlier
line, are measured against all characters in words. Words and lines of equal hashes are compared as bytes. One pass over
the texts, no shuffle.

Defined cases: a null or empty text has no word (base_failed, not kept); rows of equal doc_id are judged apart; a null
doc_id is passed through; a share that is just at its bound passes; texts of any length are measured whole, one at a time
beyond a chunk; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks
from .textops import Prefix, covered, identities, later, repeated, words

#: The largest shares of characters in repeated n-grams and lines, by n, as published for web corpora.
DUP_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_SHARE = 0.30
DUP_LINE_CHAR_SHARE = 0.20
MAX_SYMBOLS_PER_WORD = 0.10

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"
)


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of a chunk."""
    n = len(offsets) - 1
    s, e, doc = words(raw, offsets)
    lead = np.zeros(len(raw) + 1, np.int64)  # code points: bytes that don't continue one
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    wchars = lead[e] - lead[s]
    count = lambda d, w=None: np.bincount(d, weights=w, minlength=n).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": count(doc, wchars)}

    sym = np.zeros(256, bool)
    sym[list(b"#*$%&|<>")] = True
    at = np.flatnonzero(sym[raw])
    out["n_symbols"] = count(np.searchsorted(offsets, at, "right") - 1)

    ls, le, ldoc = _lines(raw, offsets)
    inside = np.searchsorted(s, le) - np.searchsorted(s, ls)  # words of a line
    ls, le, ldoc = ls[inside > 0], le[inside > 0], ldoc[inside > 0]
    dup = later(identities(raw, ls, le), ldoc)
    out["n_lines"], out["n_dup_lines"] = count(ldoc), count(ldoc[dup])
    chars = np.concatenate([[0], np.cumsum(wchars)])
    lchars = chars[np.searchsorted(s, le)] - chars[np.searchsorted(s, ls)]
    out["dup_line_chars"] = count(ldoc[dup], lchars[dup])

    h = identities(raw, s, e)
    pre = Prefix(h)
    at, before = np.flatnonzero(doc[: max(len(h) - 2, 0)] == doc[2:]), 3
    for k in (3, *DUP_NGRAM_SHARE):
        # a window can repeat only where the shorter ones inside it do
        for shift in range(1, k - before + 1):
            at = at[twice[at + shift]]
        at, before = at[repeated(pre.of(at, at + k), doc[at])], k
        twice = np.zeros(len(h) + k, bool)
        twice[at] = True
        hit = covered(at, k, len(h))
        if k == 3:
            out["n_repeat_words"] = count(doc[hit])
        else:
            out[f"dup{k}"] = count(doc[hit], wchars[hit])
    return out


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nl = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], nl + 1]))
    doc = np.searchsorted(offsets, starts, "right") - 1
    ok = starts < len(raw)  # the rest are empty
    # after a final \n the next start is the next document's; equal starts give empty lines, which have no word
    starts, doc = starts[ok], doc[ok]
    nxt = np.append(nl, len(raw))
    ends = np.minimum(nxt[np.searchsorted(nl, starts)], offsets[np.minimum(doc + 1, len(offsets) - 1)])
    keep = np.ones(len(starts), bool)
    keep[1:] = starts[1:] != starts[:-1]
    return starts[keep], ends[keep], doc[keep]


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    bad = m["n_dup_lines"] > DUP_LINE_SHARE * m["n_lines"]
    bad |= m["dup_line_chars"] > DUP_LINE_CHAR_SHARE * m["word_chars"]
    bad |= m["n_symbols"] > MAX_SYMBOLS_PER_WORD * m["n_words"]
    for k, share in DUP_NGRAM_SHARE.items():
        bad |= m[f"dup{k}"] > share * m["word_chars"]
    return base, ~base & ~bad


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, off in text_chunks(batch):
            m = measure(raw, off)
            base, kept = verdict(m)
            dups = np.stack([m[f"dup{k}"] for k in DUP_NGRAM_SHARE], axis=1)
            k = dups.shape[1]
            cols = [batch.column("doc_id").slice(lo, hi - lo)] + [pa.array(m[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            cols += [pa.array(base), pa.array(kept), pa.array(m["dup_line_chars"]), pa.ListArray.from_arrays(pa.array(np.arange(0, k * (hi - lo) + 1, k, dtype=np.int32)), pa.array(dups.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", "dup_ngram_chars"])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its measures, `base_failed` and `kept`; dup_ngram_chars is by n from 5 to 10."""
    return docs.select("doc_id", "text").mapInArrow(_run, SCHEMA)


def oracle() -> str:
    """The measures and verdicts of `documents` as DuckDB SQL."""
    gram = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    ns = (3, *DUP_NGRAM_SHARE)
    hits = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY id, g{n}) > 1 AS r{n}" for n in ns)
    inside = ", ".join(f"max(r{n}::INTEGER) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in ns)
    dups = ", ".join(f"coalesce(sum(length(w)) FILTER (c{n} = 1), 0)::BIGINT AS d{n}" for n in DUP_NGRAM_SHARE)
    bad = " OR ".join(f"d{n} > {share} * word_chars" for n, share in DUP_NGRAM_SHARE.items())
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
ws AS MATERIALIZED (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM t)),
g AS MATERIALIZED (SELECT id, i, w, {", ".join(f"{gram(n)} AS g{n}" for n in ns)} FROM ws WINDOW o AS (PARTITION BY id ORDER BY i)),
h AS MATERIALIZED (SELECT id, i, w, {hits} FROM g), c AS (SELECT id, w, {inside} FROM h),
m AS MATERIALIZED (SELECT id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (c3 = 1) AS n_repeat_words, {dups} FROM c GROUP BY id),
l AS (SELECT id, line, row_number() OVER (PARTITION BY id, line) AS k FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
n AS MATERIALIZED (SELECT id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (k > 1), 0) AS dup_line_chars FROM l GROUP BY id),
a AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(d{n}, 0) AS d{n}" for n in DUP_NGRAM_SHARE)} FROM t LEFT JOIN m USING (id) LEFT JOIN n USING (id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars, [{", ".join(f"d{n}" for n in DUP_NGRAM_SHARE)}] AS dup_ngram_chars,
  NOT (base_failed OR n_dup_lines > {DUP_LINE_SHARE} * n_lines OR dup_line_chars > {DUP_LINE_CHAR_SHARE} * word_chars OR n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words OR {bad}) AS kept FROM b"""
