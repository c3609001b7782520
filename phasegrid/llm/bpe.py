"""Operator 5: byte-level BPE, encoding and decoding.

Encoding keeps a priority queue of (merge rank, position) over a doubly linked
list of symbols; an entry whose pair has changed since it was pushed is stale
and is skipped.  Decoding concatenates vocabulary strings.  A word (pretoken)
is encoded once for each worker and kept in a bounded cache.

Cases: null and empty texts give no ids; the special token's string inside a
text is the special token, as in the tokenizers library; equal texts give equal
rows; a text of any length is encoded whole, word by word, in linear space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published word pattern of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on whose class (letter, number, space, other) every Unicode
#: version since 6.0 agrees; other texts are split by the reference library.
SETTLED = re.compile("[\x00-ɏΑ-ΡΣ-ωА-я‐-‧‰-›€ぁ-ゖァ-ヺ一-龥]*")

#: Cache entries: merging a word here is dear, ranking one in the library cheap.
CACHE_WORDS, CACHE_RANKED = 400_000, 150_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """What a byte-level BPE tokenizer file holds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        back = {c: b for b, c in byte_letters().items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text = {i: bytes(back[c] for c in s) for s, i in model["vocab"].items()}
        self.bytes: list[bytes] = [b""] * (1 + max([*text, *self.specials.values()]))
        for i, s in text.items():
            self.bytes[i] = s
        for s, i in self.specials.items():
            self.bytes[i] = s.encode()
        self.byte_id = [model["vocab"][byte_letters()[b]] for b in range(256)]
        vocab = model["vocab"]
        #: left id << 20 | right id -> rank; the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        byte_id, rank_of = self.byte_id, self.ranks.get
        ids = [byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        # A queue entry is rank << 32 | place; -1 marks a symbol that is gone.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push, made = heapq.heappop, heapq.heappush, self.made
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ids.append(-1)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or rank_of(left << 20 | ids[j]) != entry >> 32 or ids[j] < 0:
                continue  # stale: one of its symbols has been merged
            ids[i], ids[j] = new, _ = made[entry >> 32], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 20 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 20 | new)) is not None:
                push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]


class _Chunks(dict):
    """Text without inner spaces -> its ids as little-endian uint32 bytes, bounded."""

    def __init__(self, encode, most: int = CACHE_WORDS):
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self.encode(chunk)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


class Encoder:
    """Whole texts to ids; `chunks.encode` may be another encoder of text without inner spaces."""

    def __init__(self, path: str):
        self.path, self.vocab = path, Vocabulary(path)
        self.split = regex.compile(WORDS)
        self.special = re.compile("|".join(map(re.escape, sorted(self.vocab.specials, key=len, reverse=True)))) if self.vocab.specials else None
        self.words = _Chunks(lambda w: array("I", self.vocab.merge(w.encode())).tobytes())
        self.chunks = _Chunks(self._chunk)
        self._library = None

    def _chunk(self, chunk: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.split.findall(chunk)])

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def _unsettled(self, text: str) -> bytes:
        """Split by the library's own word rule, merged here."""
        at, parts = 0, []
        for _, (a, b) in self.library().pre_tokenizer.pre_tokenize_str(text):
            assert a == at
            parts.append(self.words[text[a:b]])
            at = b
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if not text.isascii() and not SETTLED.fullmatch(text):
            return self._unsettled(text)
        if "  " in text:
            return self._chunk(text)
        # Without double spaces, a word always begins at each space.
        first, *rest = text.split(" ")
        chunks = self.chunks
        parts = [chunks[first]] if first else []
        parts += [chunks[" " + c] for c in rest]
        return b"".join(parts)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        parts, at = [], 0
        for m in self.special.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.array([self.vocab.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*parts, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        strings = self.vocab.bytes
        data = b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str = "merge") -> Encoder:
    """One for each worker process."""
    if (path, kind) not in _ENCODERS:
        if kind == "merge":
            _ENCODERS[path, kind] = Encoder(path)
        else:
            from phasegrid.llm.packing import ranked_chunks

            own = Encoder(path)
            own.chunks = _Chunks(ranked_chunks(own.vocab), CACHE_RANKED)
            _ENCODERS[path, kind] = own
    return _ENCODERS[path, kind]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [np.frombuffer(e.ids(t or ""), "<u4").astype("<i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [None if x is None else e.decode(np.array(x, "<u4").tobytes()).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode, every text."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = e.ids(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)
