"""BPE encoding and decoding by forced-boundary splitting.

Merges join neighbouring symbols only, so two bytes that no vocabulary token holds side by side always end up in different
tokens: a certain cut. A table of all 65,536 pairs of bytes tells where; texts are cut there as bytes, a chunk of documents
at a time. A cut must leave pre-tokens as they are, too: none inside a character, none after white space before something
else (a run of white space leaves its last character to the next word), none before an apostrophe that may open a
contraction. Tokens of such vocabularies never cross from one kind of character to the next, so most cuts fall before white
space and between words and marks.

The fragments repeat a lot: each chunk's distinct ones are looked up, new ones are encoded on their own, and the
concatenation of the fragments' ids is exactly what encoding the whole text gives.

Defined cases: a null or empty text has no ids (the digests are those of the empty string); the strings of special
tokens in a text become their ids, as in the library; texts beyond a chunk are encoded alone; rows of equal doc_id stay
apart; other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_names, text_chunks
from .textops import mix

#: ASCII white space as pre-token patterns see it, and control characters that some take for white space.
SPACES, ODD = b"\t\n\v\f\r ", bytes(range(0x1C, 0x20))
#: Bytes of text that are cut at a time.
CHUNK = 1 << 19
#: Bytes that a worker's known fragments take at most, about; then it starts anew.
CACHE_BYTES = 24 << 20
_workers: dict[str, "ForcedBoundaryCodec"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.no_padding()
        self._lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        every = b"\0".join(self.token_bytes.values())
        pairs = np.frombuffer(every, np.uint8).astype(np.int32)
        edge = np.zeros(len(pairs), bool)  # the separators aren't part of tokens
        edge[np.cumsum([len(b) + 1 for b in self.token_bytes.values()])[:-1] - 1] = True
        pairs = (pairs[:-1] << 8 | pairs[1:])[~edge[:-1] & ~edge[1:]]
        #: True where a pair of bytes is a certain cut.
        self.cut = self._allowed()
        self.cut[pairs] = False
        self._piece = self._merger(spec, special)
        self.token_bytes |= {i: t.encode() for t, i in special.items()}
        self._special = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(special, key=len, reverse=True))) if special else None
        self._start_anew()

    def _start_anew(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._size: list[int] = []
        self._listed: list[str] = []
        self._decoded: list[bytes] = []
        self._held = 0

    @staticmethod
    def _allowed() -> np.ndarray:
        """Pairs of bytes between which a cut changes no pre-token."""
        x, y = np.divmod(np.arange(65536), 256)
        space, odd = np.isin(np.arange(256), list(SPACES)), np.isin(np.arange(256), list(ODD))
        word = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
        inside = y & 0xC0 == 0x80
        plain = (x < 128) & ~space[x] & ((y != ord("'")) | word[x])
        return ~inside & ~odd[x] & ~odd[y] & (space[y] | plain)

    def _merger(self, spec: dict, special: dict[str, int]):
        """Encodes a fragment that is one pre-token by a compiled merge loop over the vocabulary's ranks, where ids are in
        the order of merges; None where they aren't."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or ids != sorted(ids) or sum(len(b) == 1 for b in self.token_bytes.values()) != 256:
            return None
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str="x", mergeable_ranks={b: i for i, b in self.token_bytes.items()}, special_tokens={})._core_bpe.encode_single_piece

    def _encode_fragment(self, fragment: bytes) -> list[int]:
        text = fragment.decode()
        if self._piece is not None:
            core = text[1:] if text[0] == " " else text
            if core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # a space and letters are one pre-token
                return self._piece(fragment)
        return self._lib.encode(text, add_special_tokens=False).ids

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin, in order, and the end: documents' starts, certain cuts, and the edges of special tokens."""
        at = np.zeros(len(raw) + 1, bool)
        at[1:-1] = self.cut[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        at[offsets] = True
        if self._special is not None and ord("<") in raw:
            for m in self._special.finditer(raw.tobytes()):
                if m.end() > offsets[np.searchsorted(offsets, m.start(), "right")]:
                    continue  # put together of two documents
                at[m.start() + 1 : m.end()] = False
                at[m.start()] = at[m.end()] = True
        return np.flatnonzero(at)

    def fragments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each fragment's place among the known ones, and where each document's fragments begin and end."""
        if self._held > CACHE_BYTES:
            self._start_anew()
        edges = self.cuts(raw, offsets)
        if len(raw) == 0:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        start, size = edges[:-1], np.diff(edges)
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        first = np.where(np.arange(16)[None, :] < size[:, None], np.lib.stride_tricks.sliding_window_view(padded, 16)[start], 0)
        lead = np.ascontiguousarray(first, np.uint8).view(np.uint64)
        key = mix(lead[:, 0] + mix(lead[:, 1] + np.uint64(1))) + size.astype(np.uint64)
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        # long fragments, and any two that the key confuses, are told apart by their bytes
        odd = np.flatnonzero((size > 16) | (lead != lead[at[inverse]]).any(axis=1) | (size != size[at[inverse]]))
        data = raw.tobytes()
        slots = np.fromiter(map(self._known, (data[a : a + n] for a, n in zip(start[at].tolist(), size[at].tolist()))), np.int64, len(at))[inverse]
        slots[odd] = [self._known(data[a : a + n]) for a, n in zip(start[odd].tolist(), size[odd].tolist())]
        return slots, np.searchsorted(start, offsets)

    def _known(self, fragment: bytes) -> int:
        slot = self._slot.get(fragment)
        if slot is None:
            ids = self._encode_fragment(fragment)
            slot = self._slot[fragment] = len(self._size)
            back = b"".join(map(self.token_bytes.__getitem__, ids))
            self._size.append(len(ids))
            self._listed.append(",".join(map(str, ids)))
            self._decoded.append(fragment if back == fragment else back)
            self._held += 240 + len(fragment) + len(self._listed[-1])
        return slot

    def digests(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[str], list[str]]:
        """Of each text: number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded text."""
        slots, bounds = self.fragments(raw, offsets)
        counts = np.concatenate([[0], np.cumsum(np.array(self._size, np.int64)[slots])]) if len(slots) else np.zeros(1, np.int64)
        numbers, ids, texts = np.diff(counts[bounds]).tolist(), [], []
        listed, decoded = self._listed, self._decoded
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mine = slots[lo:hi].tolist()
            ids.append(hashlib.sha256(",".join([listed[k] for k in mine]).encode()).hexdigest())
            text = b"".join([decoded[k] for k in mine]).decode("utf-8", "replace")
            texts.append(hashlib.sha256(text.encode()).hexdigest())
        return numbers, ids, texts

    def encode_all(self, raw: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        slots, bounds = self.fragments(raw, offsets)
        own = [",".join([self._listed[k] for k in slots[lo:hi].tolist()]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return [list(map(int, x.split(","))) if x else [] for x in own]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def rest(self) -> None:
        """Between two tasks: the known fragments go, and freed memory goes back to the system."""
        self._start_anew()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def codec(path: str) -> ForcedBoundaryCodec:
    """The codec of a vocabulary file, one for each worker process."""
    if path not in _workers:
        _workers[path] = ForcedBoundaryCodec(path)
    return _workers[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """All columns of `docs` and, last, an array of the text's token ids: `ids`, or a name like it that is free."""
    (name,) = free_names(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo, hi, raw, off in text_chunks(b, limit=CHUNK):
                ids = pa.array(c.encode_all(raw, off), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in b.columns), ids], names=[*b.schema.names, name])
        c.rest()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `text` decoded from its last column, the ids, which goes."""
    name = encoded.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            names = b.schema.names[:-1]
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                text = pa.array([c.decode(i or []) for i in part.column(name).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([text if n == "text" else part.column(n) for n in names], names=names)

    return encoded.mapInArrow(run, T.StructType(encoded.schema.fields[:-1]))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo, hi, raw, off in text_chunks(b, limit=CHUNK):
                n, ids, decoded = c.digests(raw, off)
                cols = [b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.rest()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
