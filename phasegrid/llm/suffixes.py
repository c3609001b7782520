"""Operator 3: repeated byte strings by suffix arrays.

Every 50-byte string of the corpus is named by a winnowed anchor (the smallest
hash of 20 bytes in it).  Anchors that only one document holds are settled by a
count over the corpus.  The text round each shared anchor - all the 50-byte
strings that it names - goes to the shard of the anchor's hash, once for each
block of documents and different content, with the smallest doc_id that has it.
So equal strings always meet in one place and a shard's size follows the input.

A shard sorts its suffixes by Larsson-Sadakane refinement in numpy: ranks by
eight bytes first, then doubling over the groups that are still unsorted.
Common prefixes are Kasai's, in the order of the text: a suffix whose left
neighbour extends its match has one less, the others are compared directly.
Neighbours with 50 bytes in common form a group, which gives its strings their
smallest doc_id.  An anchor whose texts don't fit one suffix array is sorted in
several, whose sorted strings are merged by binary search.

Cases: null and empty texts have no bytes and nothing removed; texts under 50
bytes are kept; repeats inside one document alone are kept; the smallest doc_id
keeps its copy, all others lose theirs; rows that repeat a doc_id count as one
document; a null doc_id is the smallest and stays null; NUL bytes are ordinary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from phasegrid.llm.common import CHUNK, MESSAGE, MESSAGE_ARROW, Block, Post, Scratch, frames, minimizers, mix, pack_u64, split_by_bucket, to_blocks, unframe, unpack_u64, window_hash
from phasegrid.llm.substrings import _shared

ANCHOR, WINDOW = 20, 50
BLOCK = 2_000_000
#: Raw text for each shard, and the most bytes that one suffix array sorts.
SHARD_TEXT, ARRAY_BYTES = 3_000_000, 600_000
NEVER = np.iinfo(np.int64).max

#: A number for each byte value.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Runs:
    """Consecutive windows of a document that have their anchor at the same place."""

    def __init__(self, block: Block, window: int = WINDOW, anchor: int = ANCHOR):
        data = np.frombuffer(block.body, np.uint8)
        n = max(0, len(data) - window + 1)
        valid = np.zeros(n, bool)
        for a, z in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True):
            if z - a >= window:
                valid[a : z - window + 1] = True
        starts, lens, hashes = [], [], []
        for at in range(0, n, CHUNK):
            part = BYTE[data[at : at + CHUNK + window - 1]]
            h = mix(window_hash(part, anchor, 0xD1B54A32D192ED03))
            place = minimizers(h, window - anchor + 1)
            ok = valid[at : at + len(place)]
            edge = np.empty(len(place) + 1, bool)
            edge[0] = edge[-1] = True
            edge[1:-1] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
            cut = np.flatnonzero(edge)
            first, length = cut[:-1], np.diff(cut)
            use = ok[first]
            starts.append(first[use] + at)
            lens.append(length[use])
            # Mixed again: the smallest hashes of their windows would all go to the first shards.
            hashes.append(mix(~h[place[first[use]]]))
        #: A chunk's edge may cut a run in two: each part is a run of its own.
        self.start = np.concatenate([np.zeros(0, np.int64), *starts])
        self.count = np.concatenate([np.zeros(0, np.int64), *lens])
        self.hash = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.doc = np.searchsorted(block.starts, self.start, side="right") - 1
        # Empty documents share a start; the last of them is the one with bytes.


def _seeds(r: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different anchors, sorted, and whether two documents here have each."""
    doc = ids[r.doc]
    order = np.lexsort((doc, r.hash))
    h, doc = r.hash[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    return h[at], doc[at] != doc[last]


def _send_seeds(shards: int):
    def work(block: Block):
        values, often = _seeds(Runs(block), block.ids)
        for b, x, y in split_by_bucket(values, shards):
            yield b, frames(pack_u64(values[x:y]), np.packbits(often[x:y]).tobytes())

    return work


def _squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _open(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _contexts(post: Post):
    """Second round: the different texts round shared anchors, to their shards."""

    shards = post.buckets

    def work(block: Block, replies: dict[int, bytes]) -> pa.Table:
        r = Runs(block)
        values, _ = _seeds(r, block.ids)
        shared = np.zeros(len(values), bool)
        for b, x, y in split_by_bucket(values, shards):
            shared[x:y] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=y - x).astype(bool)
        use = np.flatnonzero(shared[np.searchsorted(values, r.hash)]) if len(values) else np.zeros(0, np.int64)
        use = use[np.argsort(r.hash[use], kind="stable")]
        start, count, h, doc = r.start[use], r.count[use], r.hash[use], block.ids[r.doc[use]]
        # Different texts in the order of first sight, anchors ascending.
        index: dict[bytes, int] = {}
        body = block.body
        which = np.fromiter((index.setdefault(body[a : a + c + WINDOW - 1], len(index)) for a, c in zip(start.tolist(), count.tolist(), strict=True)), np.int64, len(use))
        texts = list(index)
        least = np.full(len(texts), NEVER)
        np.minimum.at(least, which, doc)
        seen = np.unique(which, return_index=True)[1]
        anchors = h[seen]
        out = [(-1, frames(*(_squeeze(x.astype("<i4").tobytes()) for x in (start, count, which))))]
        for b, x, y in split_by_bucket(anchors, shards):
            lens = np.array([len(t) for t in texts[x:y]], "<i4").tobytes()
            out.append((b, frames(anchors[x:y].astype("<u8").tobytes(), lens, least[x:y].astype("<i8").tobytes(), _squeeze(b"".join(texts[x:y])))))
        return post.table(block.block, out)

    return work


# ---------------------------------------------------------------- suffix arrays


def words8(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number in text order (zeros past the end)."""
    x = np.concatenate([t, np.zeros(7, np.uint8)]).astype(np.uint64)
    out, size = x, 1
    while size < 8:
        out = out[: len(out) - size] << np.uint64(8 * size) | out[size:]
        size *= 2
    return out[: len(t)]


def suffix_array(t: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in order: refine groups of equal rank, doubling the depth."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    key = words8(t) if words is None else words
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    single = new & np.append(new[1:], True)
    todo = np.flatnonzero(~single)  # places of sa in groups that are still unsorted
    while len(todo):
        at = sa[todo]
        # Past the end the shorter suffix is the smaller one.
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, n - at - depth)
        own = rank[at]
        order = np.lexsort((after, own))
        at, own, after = at[order], own[order], after[order]
        sa[todo] = at
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        rank[at] = todo[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        single = fresh & np.append(fresh[1:], True)
        todo = todo[~single]
        depth *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """lcp[j]: bytes that suffixes sa[j-1] and sa[j] share; lcp[0] is 0."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    w = words8(t) if words is None else words
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    left = np.maximum(before - 1, 0)
    own = np.ones(n, bool)  # not one less than its left neighbour's
    own[1:] = (before[1:] <= 0) | (t[:-1] != t[left[1:]])
    i = np.flatnonzero(own & (before >= 0))
    j, got, live = before[i], np.zeros(len(i), np.int64), np.arange(len(i))
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        inside = (a < n) & (b < n)
        x = np.where(inside, w[np.minimum(a, n - 1)] ^ w[np.minimum(b, n - 1)], np.uint64(2**64 - 1))
        odd = x.astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        same = np.where(x == 0, 8, odd.argmax(1))
        same = np.minimum(same, np.maximum(n - np.maximum(a, b), 0))
        got[live] += same
        live = live[same == 8]
    reach = np.zeros(n, np.int64)
    reach[i] = i + got
    plcp = np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
    plcp[sa[0]] = 0
    return plcp[sa]


def least_documents(texts: list[bytes], least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: the smallest doc_id with it.

    Also the sorted different windows (as fixed-length strings) and theirs, for
    merging with other arrays.
    """
    t = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # FF is in no UTF-8 text
    lens = np.array([len(x) for x in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    owner = np.full(len(t), -1)
    counts = lens - window + 1
    places = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    owner[places] = np.repeat(np.arange(len(texts)), counts)
    w = words8(t)
    sa = suffix_array(t, w)
    group = np.cumsum(common_prefixes(t, sa, w) < window) - 1
    doc = np.where(owner[sa] >= 0, least[owner[sa]], NEVER)
    best = np.full(group[-1] + 1, NEVER)
    np.minimum.at(best, group, doc)
    of = np.empty(len(t), np.int64)
    of[sa] = group
    firsts = np.full(len(best), -1)
    firsts[of[places]] = places
    real = np.flatnonzero(firsts >= 0)
    return best[of[places]], firsts[real], best[real]


def windows_at(t: bytes, places: np.ndarray, window: int = WINDOW) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(t, np.uint8), window)
    return np.ascontiguousarray(view[places]).view(f"S{window}").ravel()


def solve_shard(anchors: np.ndarray, texts: list[bytes], least: np.ndarray, array_bytes: int = ARRAY_BYTES) -> list[np.ndarray]:
    """For each different text (sorted by anchor) the smallest doc_id of each of its windows."""
    out: list[np.ndarray] = [np.full(len(t) - WINDOW + 1, d) for t, d in zip(texts, least.tolist(), strict=True)]
    edges = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1], [True]])).tolist()

    def solve(held: list[int]) -> tuple[np.ndarray, np.ndarray]:
        docs, firsts, best = least_documents([texts[k] for k in held], least[held])
        at = 0
        for k in held:
            out[k] = docs[at : at + len(out[k])].copy()
            at += len(out[k])
        return firsts, best

    held, room = [], 0
    for a, z in zip(edges, edges[1:], strict=False):
        if z - a < 2:
            continue  # a lone text's windows occur nowhere else
        size = sum(len(texts[k]) + 1 for k in range(a, z))
        if held and room + size > array_bytes:
            solve(held)
            held, room = [], 0
        if size <= array_bytes:
            held += range(a, z)
            room += size
            continue
        # One anchor's texts in several arrays: sorted strings of each are sought
        # in the merged table by binary search.
        parts, part, room_ = [], [], 0
        for k in range(a, z):
            part.append(k)
            room_ += len(texts[k]) + 1
            if room_ > array_bytes:
                parts.append(part)
                part, room_ = [], 0
        parts += [part] if part else []
        table, best = np.zeros(0, f"S{WINDOW}"), np.zeros(0, np.int64)
        for part in parts:
            firsts, docs = solve(part)
            own = windows_at(b"\xff".join([texts[k] for k in part]) + b"\xff", firsts)
            merged = np.unique(np.concatenate([table, own]))
            low = np.full(len(merged), NEVER)
            low[np.searchsorted(merged, table)] = best
            np.minimum.at(low, np.searchsorted(merged, own), docs)
            table, best = merged, low
        for k in range(a, z):
            out[k] = best[np.searchsorted(table, windows_at(texts[k], np.arange(len(out[k]))))]
    if held:
        solve(held)
    return out


def _shard(blobs: list[bytes]) -> list[bytes]:
    """For each text of each message: the smallest doc_id of each window."""
    index: dict[bytes, int] = {}
    anchors, docs, which = [], [], []
    for blob in blobs:
        h, lens, least, body = unframe(blob)
        body = _open(body)
        ends = np.cumsum(np.frombuffer(lens, "<i4"))
        own = []
        for a, z, x in zip([0, *ends[:-1].tolist()], ends.tolist(), np.frombuffer(h, "<u8").tolist(), strict=True):
            k = index.setdefault(body[a:z], len(index))
            if k == len(anchors):
                anchors.append(x)
            own.append(k)
        which.append(np.array(own, np.int64))
        docs.append(np.frombuffer(least, "<i8"))
    texts = list(index)
    least = np.full(len(texts), NEVER)
    for own, d in zip(which, docs, strict=True):
        np.minimum.at(least, own, d)
    order = np.argsort(np.array(anchors, np.uint64), kind="stable")
    solved = solve_shard(np.array(anchors, np.uint64)[order], [texts[k] for k in order.tolist()], least[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [_squeeze(np.concatenate([solved[back[k]] for k in own.tolist()]).astype("<i8").tobytes()) for own in which]


# ---------------------------------------------------------------- results

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _doomed(block: Block, replies: dict[int, bytes]) -> np.ndarray:
    """Bytes of the block's body that go."""
    start, count, which = (np.frombuffer(_open(x), "<i4").astype(np.int64) for x in unframe(replies.pop(-1)))
    edge = np.zeros(len(block.body) + 1, np.int64)
    if len(which):
        # Windows of the different texts, in the order that they were sent in.
        size = np.zeros(which.max() + 1, np.int64)
        size[which] = count
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        best = np.concatenate([np.frombuffer(_open(replies[b]), "<i8") for b in sorted(replies)])
        doc = block.ids[np.searchsorted(block.starts, start, side="right") - 1]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gone = best[np.repeat(begin[which], count) + inner] < np.repeat(doc, count)
        at = (np.repeat(start, count) + inner)[gone]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _digest(block: Block, gone: np.ndarray) -> pa.Table:
    n, removed, runs, sha = [], [], [], []
    for a, z in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True):
        own = spans(gone[a:z])
        kept, at = [], a
        for x, y in own:
            kept.append(block.body[at : a + x])
            at = a + y
        kept.append(block.body[at:z])
        n.append(z - a)
        removed.append(sum(y - x for x, y in own))
        runs.append(len(own))
        sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
    return pa.table({"doc_id": block.id_column(), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


SPANS = "doc_id long, start long, stop long"
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _spans(block: Block, gone: np.ndarray) -> pa.Table:
    rows = [(k, x, y) for k, (a, z) in enumerate(zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True)) for x, y in spans(gone[a:z])]
    k, x, y = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"doc_id": block.id_column().take(pa.array(k, pa.int64())), "start": pa.array(x, pa.int64()), "stop": pa.array(y, pa.int64())})


def repeated_bytes(docs: DataFrame, scratch: Scratch, emit, schema: str, arrow: pa.Schema, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`emit(block, gone)` for each block; `gone` marks the bytes to remove."""
    blocks, raw = to_blocks(docs, scratch, doc_id, text, BLOCK)
    post = Post(blocks, raw, SHARD_TEXT)
    seeds = scratch.keep(post.answer(post.send(_send_seeds(post.buckets)), _shared), "seeds")
    asked = scratch.keep(post.receive(seeds, _contexts(post), MESSAGE, MESSAGE_ARROW), "contexts")
    own = scratch.keep(asked.where("bucket < 0"), "own")
    solved = scratch.keep(post.answer(asked.where("bucket >= 0"), _shard), "solved")
    scratch.drop("seeds", "contexts")
    return post.receive(solved.union(own), lambda block, replies: emit(block, _doomed(block, replies)), schema, arrow)


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return repeated_bytes(docs, scratch, _digest, DIGEST, DIGEST_ARROW)


def removed_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, stop): byte ranges that repeat a document with a smaller doc_id."""
    return repeated_bytes(docs, scratch, _spans, SPANS, SPANS_ARROW)
