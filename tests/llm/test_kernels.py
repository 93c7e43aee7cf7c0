"""Operators that work on one text at a time, against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import bpe, quality, textops, tokenfile
from tidewatch.llm.common import scratch_path
from tidewatch.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept int"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
ODD = "abcdeXYZ 0123 \n\t'sStrevl!?.,<>é ü 漢字   \u0085\x1c\x0b😀́-_/\\ßİΣς²½ⅧÅ#*$%&|"


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    out = ["", " ", "\n", "a", "word " * 700, "x" * 70_000, "a b c d e " * 60 + "\n" + "same line here\n" * 5, "<|endoftext|> x <|startoftext|>"]
    out += ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["\n".join(" ".join(rng.choice(["a", "bb", "cé", "d.", "e#"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    return out


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t), "clash", 1) for i, t in enumerate(texts)] + [(None, None, None, None, None, None, None), (5, None, "en", "s", 0, "x", 0), (0, texts[3], None, "s", 0, "x", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def brute_quality(text):
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    c = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(3)}
    out = {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
    out["base_failed"] = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
    bad = out["base_failed"] or out["n_symbols"] > quality.MAX_SYMBOLS_PER_WORD * len(ws) or out["n_dup_lines"] > quality.DUP_LINE_SHARE * len(lines)
    seen, chars = set(), 0
    for x in lines:
        chars += sum(map(len, WORD.findall(x))) if x in seen else 0
        seen.add(x)
    bad = bad or chars > quality.DUP_LINE_CHAR_SHARE * out["word_chars"]
    for n, share in quality.DUP_NGRAM_SHARE.items():
        grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
        c = Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(n)}
        bad = bad or sum(len(ws[i]) for i in hit) > share * out["word_chars"]
    return out | {"kept": not bad}


def test_quality_against_loops(spark):
    df, rows = frame(spark, odd_texts())
    got = quality.repetition_rules(df).collect()
    want = Counter((r[0], *sorted(brute_quality(r[1] or "").items())) for r in rows)
    keys = sorted(brute_quality(""))
    assert Counter((r.doc_id, *((k, r[k]) for k in keys)) for r in got) == want
    assert quality.repetition_rules(df.limit(0)).count() == 0


def test_thue_morse_stretches_differ(spark, monkeypatch):
    """Stretches that collide under every polynomial modulo 2**64."""
    t = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    u = t.translate(str.maketrans("ab", "ba"))
    texts = [f"{t}\n{u}\n", f"x y {t} q w x y {u} z", f"{t}\n{u}\n{t}", " ".join([t, u] * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.repetition_rules(df).collect()}
    assert [(got[i].n_dup_lines, got[i].dup_line_chars, got[i].n_repeat_words) for i in range(4)] == [(0, 0, 0), (0, 0, 0), (1, 1024, 0), (0, 0, 6)]
    # equal hashes of different stretches are told apart by their bytes
    raw = np.frombuffer("ab cd ab ef ab ".encode(), np.uint8)
    s = np.arange(0, 15, 3)
    monkeypatch.setattr(textops, "chain", lambda raw, s, e: np.zeros(len(s), np.uint64))
    h = textops.identities(raw, s, s + 2)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    df, rows = frame(spark, odd_texts())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.bpe_digests(df, path).collect())) == want
    enc = bpe.encode_documents(df, path)
    assert enc.columns == [*df.columns, "ids_"] and bpe.encode_documents(df.drop("ids"), path).columns[-1] == "ids"
    back = bpe.decode_documents(enc, path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert bpe.bpe_digests(df.limit(0), path).count() == 0


def test_forced_cuts():
    """The table's cuts are in no token, and they do the cutting."""
    c = bpe.codec(tokenizer_path("byte_bpe_50k.json"))
    joined = {b[i : i + 2] for b in c.token_bytes.values() for i in range(len(b) - 1) if not b.startswith(b"<|")}
    forced = {bytes(divmod(int(k), 256)) for k in np.flatnonzero(c.cut)}
    assert len(forced) > 10_000 and not forced & joined
    text = "The first words, then (more) words; 12 numbers.\n\nAnother line\twith  spaces here and \u00e9t\u00e9." * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    edges = c.cuts(raw, np.array([0, len(raw)]))
    assert c.cut[raw[edges[1:-1] - 1].astype(int) << 8 | raw[edges[1:-1]]].all()  # all cuts are the table's
    spaces = sum(text[k] == " " and text[k - 1] != " " for k in range(1, len(text)))
    assert len(edges) > spaces  # and every space after something else is one


def test_bpe_by_chunks(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, c = Tokenizer.from_file(path), bpe.ForcedBoundaryCodec(path)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)  # starts anew again and again
    rng = random.Random(4)
    pieces = ["'s", "'", "x'll", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "\x85", "<|endoftext|>", "<|end", "|>", "!", "!'s", "a", "B", "9", "\u00e9", "\u6f22", "\U0001f600", "-", "_", ".", "\x1c", "\x00", "word", "longerword" * 3]
    for _ in range(300):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        raws = [t.encode() for t in texts]
        got = c.encode_all(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    df, rows = frame(spark, odd_texts())
    got = tokenfile.token_files(df, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, Counter()
    for r in order:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(map(tuple, got)) == want
    assert tokenfile.token_files(df.limit(0), path).count() == 0
    out = scratch_path(spark, "shards")
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 5000)  # here for the positions; the workers' own is larger
    tokenfile.write_token_files(df, path, out)
    shards = spark.read.schema(tokenfile.SHARD_SCHEMA).parquet(out)
    every = np.concatenate([np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in order])
    some = [1, int(every[7]), int(every[100]), 48_999]
    count = {r.token: r.n for r in tokenfile.count_tokens(shards, some).collect()}
    assert count == {t: int((every == t).sum()) for t in some}
    where = Counter((r.token, r["at"]) for r in tokenfile.locate_tokens(shards, some).collect())
    assert where == Counter((t, int(k)) for t in set(some) for k in np.flatnonzero(every == t))
    asked = [0, 5, 4999, 5000, len(every) - 1, len(every) + 10]
    got = {r["at"]: r.token for r in tokenfile.read_tokens(shards, spark.createDataFrame([(a,) for a in asked], "at long")).collect()}
    assert got == {a: int(every[a]) for a in asked if a < len(every)}


def test_frequent_token_is_located_in_batches(monkeypatch):
    """Of a token that stands everywhere in a shard, each block is unpacked once a batch and plane, not once an occurrence."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49_000, 1 << 20).astype(np.uint32)
    ids[rng.random(len(ids)) < 0.28] = 17
    m = tokenfile.WaveletMatrix.load(tokenfile.WaveletMatrix.build(ids))
    unpacked, block = [], tokenfile.WaveletMatrix._block
    monkeypatch.setattr(tokenfile.WaveletMatrix, "_block", lambda self, level, k: unpacked.append(1) or block(self, level, k))
    found = [*m.occurrences(17)]
    assert (np.concatenate(found) == np.flatnonzero(ids == 17)).all() and max(map(len, found)) <= tokenfile.LOCATE_BATCH
    assert len(unpacked) <= (len(found) + 2) * m.bits * -(-len(ids) // tokenfile.BLOCK_BITS)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (100, 2), (70_000, 40_000), (33_000, 1 << 20)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = (top * rng.random(n) ** 3).astype(np.uint32)
    m = tokenfile.WaveletMatrix.load(tokenfile.WaveletMatrix.build(ids))
    assert (m.decode() == ids).all()
    for i in rng.integers(0, n, 20).tolist() if n else []:
        t = int(ids[i])
        assert m.access(i) == t
        assert m.rank(t, i) == int((ids[:i] == t).sum())
        assert m.select(t, m.rank(t, i)) == i
        for batch in (1, 7, 1 << 16) if n <= 100 else (5000, 1 << 16):
            assert np.concatenate([*m.occurrences(t, batch)]).tolist() == np.flatnonzero(ids == t).tolist()
    assert m.rank(1 << 30, n) == 0 and not [*m.occurrences(1 << 30)] and not [*m.occurrences(-1)]
    with pytest.raises(IndexError):
        m.select(top + 1, 0)
