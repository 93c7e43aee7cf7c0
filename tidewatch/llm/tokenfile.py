"""Token-ID output: one wavelet matrix per shard, read back without the texts.

Documents are dealt by ranges of doc_id, encoded, and written shard after shard in ascending doc_id order. A shard's ids
become a wavelet matrix: one bit-plane per bit of the ids, each a stable partition of the plane above, with ones counted
before every block. From that one compressed payload any token can be read, counted up to a position or located by
occurrence, without the sequence being unpacked. Shards are rows of a Parquet table in shared storage.

Defined cases: a null or empty text has only the end id; rows of equal doc_id follow each other by text; null doc_ids
come first; an empty table gives no shard; other columns are ignored; a text is never cut over shards, so a very long one
makes a longer shard.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import scratch_path

#: A shard is closed at this many ids.
SHARD_IDS = 4 << 20
BLOCK_BITS = 1 << 15
CACHE_ENTRIES = 500_000
#: Positions of a token that are looked up, and sent to Spark, at a time.
LOCATE_BATCH = 1 << 16
_workers: dict[str, "WordCodec"] = {}


class WaveletMatrix:
    """Succinct sequence of non-negative integers: access, rank and select from compressed bit-planes."""

    def __init__(self, n: int, planes: list[bytes], ones: list[np.ndarray], blocks: list[list[tuple[int, int]]]):
        self.n, self._planes, self._ones, self._blocks = n, planes, ones, blocks
        self.bits = len(planes)
        self._zeros = [n - int(o[-1]) for o in ones]

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        """The payload: header, then each plane's ones before every block and its blocks, compressed where that helps."""
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        out = [struct.pack("<QII", n, bits, BLOCK_BITS)]
        cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        width = BLOCK_BITS // 8
        for level in range(bits - 1, -1, -1):
            on = (cur & cur.dtype.type(1 << level)) != 0
            packed = np.packbits(on)
            full = np.zeros(-(-len(packed) // width) * width, np.uint8)
            full[: len(packed)] = packed
            per = np.bitwise_count(full.view(np.uint64)).reshape(-1, width // 8).sum(axis=1, dtype=np.int64)
            ones = np.concatenate([[0], np.cumsum(per)]).astype("<u8")
            blocks, kept = [], []
            for k in range(0, len(packed), width):
                raw = packed[k : k + width].tobytes()
                small = zlib.compress(raw, 1) if _skewed(int(per[k // width]), min(BLOCK_BITS, n - k * 8)) else raw
                kept.append(small if len(small) < len(raw) else raw)
                blocks.append(len(kept[-1]))
            out += [struct.pack("<I", len(blocks)), ones.tobytes(), np.array(blocks, "<u4").tobytes(), *kept]
            cur = np.concatenate([cur[~on], cur[on]])
        return b"".join(out)

    @classmethod
    def load(cls, payload: bytes) -> "WaveletMatrix":
        n, bits, width = struct.unpack_from("<QII", payload)
        if width != BLOCK_BITS:
            raise ValueError("unknown block size")
        at, planes, ones, blocks = 16, [], [], []
        for _ in range(bits):
            (count,) = struct.unpack_from("<I", payload, at)
            at += 4
            ones.append(np.frombuffer(payload, "<u8", count + 1, at).astype(np.int64))
            at += 8 * (count + 1)
            sizes = np.frombuffer(payload, "<u4", count, at)
            at += 4 * count
            ends = at + np.cumsum(sizes.astype(np.int64))
            blocks.append(list(zip([at, *ends[:-1].tolist()], ends.tolist())) if count else [])
            at = int(ends[-1]) if count else at
            planes.append(payload)
        return cls(n, planes, ones, blocks)

    def _block(self, level: int, k: int) -> np.ndarray:
        lo, hi = self._blocks[level][k]
        size = min(BLOCK_BITS, self.n - k * BLOCK_BITS)
        raw = self._planes[level][lo:hi]
        if len(raw) < (size + 7) // 8:
            raw = zlib.decompress(raw)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size).view(bool)

    def _rank1(self, level: int, i: int) -> int:
        k, r = divmod(i, BLOCK_BITS)
        return int(self._ones[level][k]) + (int(np.count_nonzero(self._block(level, k)[:r])) if r else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = bool(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            one = self._rank1(level, i)
            value = value << 1 | bit
            i = self._zeros[level] + one if bit else i - one
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of `token` among the first i ids."""
        if token >> self.bits:
            return 0
        lo, hi = 0, min(i, self.n)
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self._zeros[level] + a, self._zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of `token`; IndexError if there are fewer."""
        if k < 0 or k >= self.rank(token, self.n):
            raise IndexError(k)
        start = 0
        for level in range(self.bits):
            a = self._rank1(level, start)
            start = self._zeros[level] + a if token >> (self.bits - 1 - level) & 1 else start - a
        pos = start + k
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                pos = self._select(level, pos - self._zeros[level], True)
            else:
                pos = self._select(level, pos, False)
        return pos

    def _select(self, level: int, k: int, bit: bool) -> int:
        ones = self._ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self._block(level, b) == bit)[k - int(before[b])])

    def occurrences(self, token: int, batch: int = LOCATE_BATCH) -> Iterator[np.ndarray]:
        """All positions of `token`, ascending, in batches: one way down for its interval of the last plane, then up again
        for a whole batch, whose order no plane changes, so that each block is unpacked once a batch and plane."""
        if token < 0 or token >> self.bits or not self.n:
            return
        bits = [token >> (self.bits - 1 - level) & 1 for level in range(self.bits)]
        lo, hi = 0, self.n
        for level, bit in enumerate(bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self._zeros[level] + a, self._zeros[level] + b) if bit else (lo - a, hi - b)
        for at in range(lo, hi, batch):
            pos = np.arange(at, min(at + batch, hi), dtype=np.int64)
            for level in range(self.bits - 1, -1, -1):
                pos = self._select_all(level, pos - self._zeros[level], True) if bits[level] else self._select_all(level, pos, False)
            yield pos

    def _select_all(self, level: int, ks: np.ndarray, bit: bool) -> np.ndarray:
        """_select() of ascending numbers."""
        ones = self._ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        held = np.searchsorted(before, ks, "right") - 1
        blocks, starts = np.unique(held, return_index=True)
        out = np.empty(len(ks), np.int64)
        for b, i, j in zip(blocks.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ks)]):
            out[i:j] = b * BLOCK_BITS + np.flatnonzero(self._block(level, b) == bit)[ks[i:j] - before[b]]
        return out

    def decode(self) -> np.ndarray:
        """The whole sequence: the partitions are undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            on = np.concatenate([self._block(level, k) for k in range(len(self._blocks[level]))]) if self.n else np.zeros(0, bool)
            up = np.empty(self.n, kind)
            z = self._zeros[level]
            up[~on] = cur[:z]
            up[on] = cur[z:] | kind(1 << (self.bits - 1 - level))
            cur = up
        return cur


def _skewed(ones: int, size: int) -> bool:
    """Whether compressing a block may pay: its bits are far from even."""
    return abs(2 * ones - size) > 0.2 * size


class WordCodec:
    """Encoder of a lower-casing word BPE file, word by word.

    White space always separates words and nothing else of the text matters for a word, so a word's ids are looked up;
    new words go through the library. Texts for which that may not hold are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.no_padding()
        self._lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = 1 + max(t["id"] for t in spec["added_tokens"])
        self._merge = self._merger(spec["model"])
        self._known: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        #: Words of these signs are cut at the edges of their letters: pre-tokens end there anyway.
        self._cut = re.compile("[!-&(-~ß-öø-ÿ]+")
        self._letters = re.compile("[a-zß-öø-ÿ]+")
        #: Lower-casing of these depends on what follows, or white space is seen differently.
        self._odd = re.compile("[Σİ]")

    def _merger(self, model: dict):
        """A compiled merge loop for words of letters that take one or two bytes in UTF-8.

        It works on single bytes, so the last symbol of a word, which carries the word-end mark, becomes another byte:
        a capital for a letter (texts are lower-cased), a low byte for a continuation byte.
        """
        import tiktoken

        alphabet = byte_alphabet()
        end = model["end_of_word_suffix"]

        fit = bytes([*range(97, 123), 0xC3, *range(0x80, 0xC0)])

        def symbols(raw: bytes, final: bool) -> bytes | None:
            if not raw or raw.translate(None, fit):
                return None
            if not final:
                return raw
            last = raw[-1]
            return raw[:-1] + bytes([last - 32 if last < 0x80 else last - 0x80]) if last != 0xC3 else None

        def of(token: str) -> bytes | None:
            final = token.endswith(end)
            word = token[: -len(end)] if final else token
            return symbols(bytes(alphabet[c] for c in word), final) if all(c in alphabet for c in word) else None

        ranks = {bytes([x]): x for x in range(256)}
        ids = {ranks[s]: i for t, i in model["vocab"].items() if (s := of(t)) and len(s) == 1}
        for m in model["merges"]:
            t = "".join(m.split(" ") if isinstance(m, str) else m)
            if (s := of(t)) and s not in ranks:
                ids[len(ranks)] = model["vocab"][t]
                ranks[s] = len(ranks)
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

        written = {r: struct.pack("<I", i) for r, i in ids.items()}

        def merge(word: str) -> bytes:
            return b"".join([written[r] for r in core.encode_single_piece(symbols(word.encode(), True))])

        return merge

    def _bytes(self, text: str) -> bytes:
        return np.array(self._lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():  # nearly all are letters, or letters and a mark
            if word.isalpha():
                return self._merge(word)
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return (self._known.get(word[:-1]) or self._merge(word[:-1])) + self._part(word[-1], self._bytes)
        if not self._cut.fullmatch(word):
            return self._bytes(word)
        out, at = [], 0
        for m in self._letters.finditer(word):
            if m.start() > at:
                out.append(self._part(word[at : m.start()], self._bytes))
            out.append(self._part(m.group(), self._merge))
            at = m.end()
        if at < len(word):
            out.append(self._part(word[at:], self._bytes))
        return b"".join(out)

    def _part(self, part: str, make) -> bytes:
        got = self._parts.get(part)
        if got is None:
            if len(self._parts) >= CACHE_ENTRIES:
                self._parts.clear()
            got = self._parts[part] = make(part)
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        plain = text.isascii()
        if "<|" in text or any(x in text for x in "\x1c\x1d\x1e\x1f") or not plain and self._odd.search(text):
            return self._bytes(text)
        if not plain and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        words = text.lower().split()
        known = self._known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) >= CACHE_ENTRIES:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self._word(w)
            return b"".join([known[w] for w in words])


def codec(path: str) -> WordCodec:
    if path not in _workers:
        _workers[path] = WordCodec(path)
    return _workers[path]


SHARD_SCHEMA = "part int, seq int, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 1) -> None:
    """Writes the shards of all texts to the table `out`, in ascending doc_id order by (part, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, c = TaskContext.get().partitionId(), 0, codec(path)
        end = np.array([end_id], "<u4").tobytes()
        kind = np.uint16 if max(c.size, end_id + 1) <= 1 << 16 else np.uint32
        ids: list[np.ndarray] = []
        who: list[int | None] = []

        def shard() -> pa.RecordBatch:
            payload = WaveletMatrix.build(np.concatenate(ids))
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([who], pa.list_(pa.int64())), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_ids", "n_tokens", "payload"])

        have = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                got = np.frombuffer(c.encode(text.as_py() or "") + end, "<u4").astype(kind)
                if have and have + len(got) > SHARD_IDS:
                    yield shard()
                    seq, ids, who, have = seq + 1, [], [], 0
                ids.append(got)
                who.append(doc_id)
                have += len(got)
        if ids:
            yield shard()

    slim = docs.select("doc_id", "text")
    n = max(1, slim.rdd.getNumPartitions())
    dealt = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    dealt.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(out)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, first): how many ids stand before each shard. Parts are summed first; what is summed up in one task is a
    row for each part, that is for each few hundred million bytes of text."""
    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sized = shards.select("part", "seq", size.alias("n"))
    before = lambda *order: F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n")).select("part", before("part").alias("ahead"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("within", within).join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("within")).alias("first"))


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = WaveletMatrix.load(b.column("payload")[k].as_py()).decode().astype("<u4")
                n = np.array(b.column("n_tokens")[k].as_py(), np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist())]
                where = [pa.array(np.full(len(n), b.column(c)[k].as_py()), pa.int32()) for c in ("part", "seq")]
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values, *where, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "doc_ids", "n_tokens", "payload").mapInArrow(run, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _asked(shards: DataFrame, asked: DataFrame, column: str, answer) -> DataFrame:
    """Every shard with the values of `column` that are asked of it; answer(matrix, value) gives one number for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                m = WaveletMatrix.load(b.column("payload")[k].as_py())
                values = b.column("asked")[k].as_py()
                where = [pa.array(np.full(len(values), b.column(c)[k].as_py()), t) for c, t in (("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*where, pa.array(values, pa.int64()), pa.array([answer(m, v) for v in values], pa.int64())], names=["part", "seq", "first", column, "answer"])

    sized = shards.join(shard_starts(shards), ["part", "seq"]).join(asked, ["part", "seq"])
    return sized.select("part", "seq", "first", "payload", "asked").mapInArrow(run, f"part int, seq int, first long, {column} long, answer long")


def _of_all_shards(shards: DataFrame, tokens: list[int]) -> DataFrame:
    return shards.select("part", "seq", F.array(*(F.lit(t).cast("long") for t in sorted(set(tokens)))).alias("asked"))


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each token in all files, by rank."""
    found = _asked(shards, _of_all_shards(shards, tokens), "token", lambda m, t: m.rank(t, m.n))
    return found.groupBy("token").agg(F.sum("answer").alias("n"))


def locate_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, at): the positions of every occurrence of each token in the files' one sequence, by select; a shard's come in
    batches, so that a frequent token needs no more memory than a rare one."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                m, part, seq = WaveletMatrix.load(b.column("payload")[k].as_py()), b.column("part")[k].as_py(), b.column("seq")[k].as_py()
                for t in wanted:
                    for x in m.occurrences(t):
                        same = lambda v, kind: pa.array(np.full(len(x), v), kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([same(part, pa.int32()), same(seq, pa.int32()), same(t, pa.int64()), pa.array(x)], names=["part", "seq", "token", "x"])

    found = shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, token long, x long")
    # a row a shard, small beside the occurrences, which stay where they are
    return found.join(shard_starts(shards), ["part", "seq"]).select("token", (F.col("first") + F.col("x")).alias("at"))


def read_tokens(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """(at, token) of the positions asked for (at), by access; those beyond the files have no row."""
    sized = shard_starts(shards).join(shards.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")), ["part", "seq"])
    # positions meet shards by the few million ids that a shard and its neighbours lie in
    cell = lambda c: F.floor(c / SHARD_IDS)
    spread = sized.withColumn("cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.greatest(F.col("n") - 1, F.lit(0))))))
    met = positions.select("at").distinct().withColumn("cell", cell(F.col("at"))).join(spread, "cell").where("at >= first AND at < first + n")
    asked = met.groupBy("part", "seq").agg(F.collect_list(F.col("at") - F.col("first")).alias("asked"))
    found = _asked(shards, asked, "x", lambda m, i: m.access(i))
    return found.select((F.col("first") + F.col("x")).alias("at"), F.col("answer").alias("token"))


def token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes the documents' token files to shared storage and reads them back."""
    spark = docs.sparkSession
    out = scratch_path(spark, "token-files")
    write_token_files(docs, path, out, end_id)
    return read_token_files(spark.read.schema(SHARD_SCHEMA).parquet(out))
