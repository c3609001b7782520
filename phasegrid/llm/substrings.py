"""Operator 7: repeated passages by seed and extend.

Seeds are winnowed anchors: the smallest hash of 10 consecutive words in every
26 of them, so equal windows of 35 words have the same anchor at the same place.
Anchors are counted over the corpus (packed blocks, one entry for each block);
those that occur once are settled.  The others' occurrences are joined: each
goes with the words round it, as far as a window with this anchor reaches, to
the shard of the anchor's hash - once for each block and different context, with
the number of its places.  There all occurrences of an anchor are extended to
the left and to the right a word at a time: occurrences with the same words so
far stay in one class, so a match is extended for all that share it at once and
no pair is formed.  A left and a right extension that together have 35 words are
a repeat if their class has two places; repeats that overlap or touch make the
maximal repeats, whose words go.

Words are compared, not hashes; an anchor's hash only says where to meet.  `keep`
says what stays of a repeat: "none" (every occurrence goes) or "first" (the one
in the smallest doc_id, leftmost, stays).

Cases: null and blank texts have no words and stay as they are; texts shorter
than a window are kept; repeats inside one document count; equal texts lose the
same words under "none"; an empty table gives no rows; rows that repeat a
doc_id are separate documents; a null doc_id is the smallest and stays null.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from phasegrid.llm.common import MESSAGE, MESSAGE_ARROW, Block, Post, Scratch, frames, minimizers, mix, pack_u64, row_schemas, split_by_bucket, to_blocks, unframe, unpack_u64, window_hash

ANCHOR, WINDOW = 10, 35
#: Text bytes for each bucket; a bucket takes about 1 kB for each context of 47 words.
BUCKET_BYTES = 8_000_000


class Sequence:
    """The hashed words of a block, one document after another."""

    def __init__(self, block: Block, window: int = WINDOW, anchor: int = ANCHOR):
        self.window = window
        words = [t.split() for t in block.texts()]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.words = words
        total = int(self.counts.sum())
        flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, total)
        self.doc = np.repeat(np.arange(len(words)), self.counts)
        n = max(0, total - window + 1)
        #: Starts of windows that lie in one document.
        self.starts = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :][:n]) if n else np.zeros(0, np.int64)
        seeds = mix(window_hash(flat, anchor, 0xD1B54A32D192ED03)) if n else np.zeros(0, np.uint64)
        self.place = minimizers(seeds, window - anchor + 1)[self.starts] if n else np.zeros(0, np.int64)
        #: Mixed again: the smallest hashes of their windows would all go to the first buckets.
        self.anchor = mix(~seeds[self.place])

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, count): consecutive windows of a document with their anchor at one place, as ranges of `starts`."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.concatenate([[True], (np.diff(self.place) != 0) | (np.diff(self.starts) != 1)])
        first = np.flatnonzero(cut)
        return first, np.diff(np.append(first, len(self.starts)))


def _often(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, sorted, and whether each occurs more than once."""
    values, counts = np.unique(h, return_counts=True)
    return values, counts > 1


def _seeds(s: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a block by occurrence: a place counts once."""
    _, once = np.unique(s.place, return_index=True)
    return _often(s.anchor[once])


def _send_seeds(buckets: int):
    def work(block: Block):
        values, often = _seeds(Sequence(block))
        for b, x, y in split_by_bucket(values, buckets):
            yield b, frames(pack_u64(values[x:y]), np.packbits(often[x:y]).tobytes())

    return work


def _shared(blobs: list[bytes]) -> list[bytes]:
    """For each value of each message: whether it occurs twice in the corpus."""
    got = [unframe(x) for x in blobs]
    values = [unpack_u64(v) for v, *_ in got]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(v)).astype(bool) for (_, f, *_), v in zip(got, values, strict=True)]
    every = np.concatenate(values)
    table, index = np.unique(every, return_inverse=True)
    often = np.bincount(index, minlength=len(table)) > 1
    often[index[np.concatenate(flags)]] = True
    reply, at = often[index], 0
    out = []
    for v in values:
        out.append(np.packbits(reply[at : at + len(v)]).tobytes())
        at += len(v)
    return out


def _flags(values: np.ndarray, replies: dict[int, bytes], buckets: int) -> np.ndarray:
    out = np.zeros(len(values), bool)
    for b, x, y in split_by_bucket(values, buckets):
        out[x:y] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=y - x).astype(bool)
    return out


class Contexts:
    """A block's runs whose anchor occurs elsewhere, and their different contexts in the order of the anchors.

    A context is the words of all windows of a run, joined by one space.
    """

    def __init__(self, s: Sequence, replies: dict[int, bytes], buckets: int, ids: np.ndarray):
        values, _ = _seeds(s)
        hit = _flags(values, replies, buckets)
        first, count = s.runs()
        use = hit[np.searchsorted(values, s.anchor[first])] if len(values) else np.zeros(0, bool)
        first, count = first[use], count[use]
        order = np.lexsort((first, ids[s.doc[s.starts[first]]], s.anchor[first]))
        self.first, self.count = first[order], count[order]
        start = s.starts[self.first]
        flat = list(chain.from_iterable(s.words))
        index: dict[bytes, int] = {}
        texts = (b" ".join(flat[a : a + n]) for a, n in zip(start.tolist(), (self.count + s.window - 1).tolist(), strict=True))
        #: Of each run its context.
        self.which = np.fromiter((index.setdefault(t, len(index)) for t in texts), np.int64, len(start))
        self.texts = list(index)
        seen = np.unique(self.which, return_index=True)[1]
        self.anchors = s.anchor[self.first[seen]]
        self.offsets = (s.place[self.first] - start)[seen].astype("<i4")
        self.places = np.bincount(self.which, minlength=len(index)).astype("<i4")
        self.least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, ids[s.doc[start]])

    def messages(self, buckets: int):
        for b, x, y in split_by_bucket(self.anchors, buckets):
            heads = (self.anchors[x:y].astype("<u8"), self.offsets[x:y], self.places[x:y], self.least[x:y].astype("<i8"))
            yield b, frames(*(h.tobytes() for h in heads), zstandard.ZstdCompressor(level=3).compress(b"\n".join(self.texts[x:y])))


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of the different (class so far, next word)."""
    order = np.lexsort((word, before))
    a, b = before[order], word[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(order)])
    return out


def extend(anchor: np.ndarray, offset: np.ndarray, places: np.ndarray, least: np.ndarray, texts: list[bytes], length: int = ANCHOR, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each context and window of it: whether it has two places, and the rank of the first context with it.

    `least` ranks the contexts; of equal ranks the earlier.  Windows that a context doesn't have are False.
    """
    n, reach = len(texts), window - length
    size = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t.split(b" ")), np.int64, int(size.sum()))
    at = begin + offset
    core = _classes(np.zeros(n, np.int64), anchor.view(np.int64))
    for k in range(length):
        core = _classes(core, flat[at + k])

    def side(step: int, room: np.ndarray, origin: np.ndarray) -> list[np.ndarray]:
        out = [core.astype(np.int32)]
        for k in range(1, reach + 1):
            own = np.flatnonzero(room >= k)
            here = np.full(n, -1, np.int32)
            here[own] = _classes(out[-1][own], flat[origin[own] + step * k])
            out.append(here)
        return out

    left = side(-1, offset, at)
    right = side(1, size - offset - length, at + length - 1)
    twice, first = np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), np.int32)
    by_rank = np.lexsort((np.arange(n), least))
    for k in range(reach + 1):  # k words to the left of the anchor: window number offset - k
        own = by_rank[(left[k][by_rank] >= 0) & (right[reach - k][by_rank] >= 0)]
        if not len(own):
            continue
        group = _classes(left[k][own], right[reach - k][own])
        twice[own, offset[own] - k] = np.bincount(group, places[own])[group] > 1
        lead = np.full(group.max() + 1, n)
        np.minimum.at(lead, group, np.arange(len(own)))
        first[own, offset[own] - k] = own[lead][group]
    return twice, first


def _shard(blobs: list[bytes]) -> list[bytes]:
    """For each context of each message: which of its windows repeat, and of which it is the first place."""
    got = [unframe(x) for x in blobs]
    anchor, offset, places, least = (np.concatenate([np.frombuffer(g[k], kind) for g in got]) for k, kind in enumerate(("<u8", "<i4", "<i4", "<i8")))
    bodies = [zstandard.ZstdDecompressor().decompress(g[4]).split(b"\n") for g in got]
    # Equal contexts of several blocks are one, with all their places.
    index: dict[bytes, int] = {}
    which = np.fromiter((index.setdefault(t, len(index)) for t in chain.from_iterable(bodies)), np.int64, len(anchor))
    del bodies
    by_rank = np.lexsort((np.arange(len(which)), least))
    lead = np.full(len(index), len(which))
    np.minimum.at(lead, which[by_rank], np.arange(len(which)))
    lead = by_rank[lead]  # of each context, its first message entry
    total = np.bincount(which, places).astype(np.int64)
    # Ranks of contexts: the place of their first entry among all.
    rank = np.empty(len(which), np.int64)
    rank[by_rank] = np.arange(len(which))
    twice, first = extend(anchor[lead], offset[lead].astype(np.int64), total, rank[lead], list(index))
    own = (first[which] == which[:, None]) & (lead[which] == np.arange(len(which)))[:, None] & twice[which]
    out, at = [], 0
    for g in got:
        part = slice(at, at + len(g[0]) // 8)
        out.append(frames(*(np.packbits(x, axis=1).tobytes() for x in (twice[which[part]], own[part]))))
        at = part.stop
    return out


def covered(s: Sequence, doomed: np.ndarray) -> np.ndarray:
    """Words under a doomed window."""
    n = len(s.doc)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s.starts[doomed], 1)
    np.add.at(edge, s.starts[doomed] + s.window, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_words(docs: DataFrame, scratch: Scratch, emit, schema: str, arrow: pa.Schema, keep: str = "none", doc_id: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """`emit(block, sequence, gone)` for each block; `gone` marks the words to remove."""
    blocks, raw = to_blocks(docs, scratch, doc_id, text, whole_rows=whole_rows)
    post = Post(blocks, raw, BUCKET_BYTES)
    buckets = post.buckets
    first = keep == "first"

    seeds = scratch.keep(post.answer(post.send(_send_seeds(buckets)), _shared), "seeds")

    def occurrences(block: Block, replies: dict[int, bytes]) -> pa.Table:
        s = Sequence(block)
        c = Contexts(s, replies, buckets, block.ids)
        runs = (zstandard.ZstdCompressor(level=3).compress(x.astype("<i4").tobytes()) for x in (c.first, c.count, c.which))
        return post.table(block.block, [(-1, frames(*runs)), *c.messages(buckets)])

    asked = scratch.keep(post.receive(seeds, occurrences, MESSAGE, MESSAGE_ARROW), "occurrences")
    own = scratch.keep(asked.where("bucket < 0"), "own")
    found = scratch.keep(post.answer(asked.where("bucket >= 0"), _shard), "extended")
    scratch.drop("seeds", "occurrences")

    def finish(block: Block, replies: dict[int, bytes]) -> pa.Table:
        s = Sequence(block)
        start, count, which = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i4").astype(np.int64) for x in unframe(replies.pop(-1)))
        width = -(-(WINDOW - ANCHOR + 1) // 8)
        bits = [np.concatenate([np.zeros((0, width), np.uint8), *(np.frombuffer(unframe(replies[b])[k], np.uint8).reshape(-1, width) for b in sorted(replies))]) for k in (0, 1)]
        run = np.repeat(np.arange(len(start)), count)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        at = start[run] + inner  # places in s.starts

        def flag(x: np.ndarray) -> np.ndarray:
            return x[which[run], inner >> 3] >> (7 - (inner & 7)).astype(np.uint8) & 1 > 0

        hit = flag(bits[0])
        if first:
            # Of the places of a repeat that this block has the first of, the one in its smallest document, leftmost.
            mine = np.flatnonzero(flag(bits[1]))
            words = list(chain.from_iterable(s.words))
            begin = s.starts[at[mine]]
            order = np.lexsort((begin, block.ids[s.doc[begin]]))
            seen: set[bytes] = set()
            for k in order.tolist():
                a = begin[k]
                text = b" ".join(words[a : a + WINDOW])
                if text not in seen:
                    seen.add(text)
                    hit[mine[k]] = False
        doomed = np.zeros(len(s.starts), bool)
        doomed[at[hit]] = True
        return emit(block, s, covered(s, doomed))

    return post.receive(found.union(own), finish, schema, arrow)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _kept(s: Sequence, gone: np.ndarray):
    at = 0
    for words, n in zip(s.words, s.counts.tolist(), strict=True):
        drop = gone[at : at + n]
        yield words, drop
        at += n


def _digest(block: Block, s: Sequence, gone: np.ndarray) -> pa.Table:
    rows = [(len(w), int(d.sum()), hashlib.sha256(b" ".join([x for x, y in zip(w, d.tolist(), strict=True) if not y])).hexdigest()) for w, d in _kept(s, gone)]
    n, k, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"doc_id": block.id_column(), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(k, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return repeated_words(docs, scratch, _digest, DIGEST, DIGEST_ARROW)


def clean(docs: DataFrame, scratch: Scratch, keep: str = "first", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the words, the others joined by one space; those left without words are dropped."""
    columns = docs.columns
    schema, arrow = row_schemas(docs)

    def emit(block: Block, s: Sequence, gone: np.ndarray) -> pa.Table:
        new, drop = {}, set()
        for k, (w, d) in enumerate(_kept(s, gone)):
            if d.any():
                new[k] = b" ".join([x for x, y in zip(w, d.tolist(), strict=True) if not y]).decode()
                if d.all():
                    drop.add(k)
        return block.rows(columns, new, drop, text)

    return repeated_words(docs, scratch, emit, schema, arrow, keep, doc_id, text, whole_rows=True)
