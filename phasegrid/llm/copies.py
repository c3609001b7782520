"""Near copies of whole documents, for the pipeline: SimHash of five-word shingles, Jaccard 0.8 or more.

Operator 10's method with longer fingerprints: of 64 bits a pair at similarity
0.8 differs in up to 14, where no look-up by segment is selective.  Here a
fingerprint has 460 segments of 26 bits.  Such a pair differs in 15 % of the bits
(less than acos(8/9) / pi), so it agrees in some segment with probability 0.998;
sets under 32 shingles, whose bits differ in up to 19 %, have 920 segments.
Each segment's table holds (value, document); documents found at one value are
verified by the distance of a whole part of 256 bits (at most 88, where pairs at
0.8 have 39 or, if short, 48 on average and unlike ones 128), and then by the exact Jaccard
similarity of the whole sets.  Values of the first 16 segments go first; of the
others only those that still join different components are compared, so a large
group of copies isn't compared once a segment.  Documents of equal sets are one
node with several places.

Cases: words are runs without blanks, A-Z in lower case; fewer than five words
are one shingle; documents without words are copies of each other; different
sets of fewer than four shingles can't reach 0.8; a null doc_id takes no part
and stays; the first of each component, by doc_id, stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import NO_ID, Block, Post, Scratch, components, frames, mix, pack_u64, partitions, shuffled, split_by_bucket, to_blocks, unframe, unpack_u64, window_hash
from phasegrid.llm.lines import ROWS_PER_TASK, TILE, TILE_BYTES, Sets, _verify
from phasegrid.llm.simhash import first_rows, segment_values, wide_fingerprint

WORDS = 5
#: Segments, those of short sets, bits of each, shingles of a short set, segments of the first round.
SEGMENTS, MORE, WIDTH, SHORT, FIRST = 460, 920, 26, 32, 16
#: 64-bit words of the part that is compared whole, and bits of it that may differ.
PART, DISTANCE = 4, 88
#: Raw bytes of a block, which bounds its keys, and those that count for a document's keys in a bucket.
BLOCK_BYTES, BUCKET_BYTES, KEY_BYTES = 2_000_000, 16_000_000, 4_000
LOW = np.uint64(0xFFFFFFFF)


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The different shingles of each text as sorted hashes."""
    words = [t.lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64)
    h = mix(window_hash(flat, WORDS, 0x9E3779B97F4A7C15))
    out = []
    for w, z in zip(words, ends.tolist(), strict=True):
        if len(w) >= WORDS:
            out.append(np.unique(h[z - len(w) : z - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w))] if w else [], np.uint64))
    return out


class Texts:
    """The documents of a block; `hash` names their sets."""

    def __init__(self, block: Block):
        self.block = block
        self.bare = list(block.texts())
        self.sets = sets_of(self.bare)
        self.hash = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in self.sets], np.uint64)

    def different(self) -> np.ndarray:
        """One index for each different set that can be like another, in the order of its hash."""
        at = np.flatnonzero((self.block.ids != NO_ID) & np.array([len(s) >= 4 for s in self.sets], bool))
        return at[np.unique(self.hash[at], return_index=True)[1]]

    def prints(self, at: np.ndarray, words: int) -> np.ndarray:
        return np.array([wide_fingerprint(self.sets[k], words) for k in at.tolist()], np.uint64).reshape(len(at), words)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents' segments with their values, ascending, and a tag of the document of each."""
        at = self.different()
        short = np.array([len(self.sets[k]) < SHORT for k in at.tolist()], bool)
        key, tag = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for own, n in ((at[~short], SEGMENTS), (at[short], MORE)):
            for part in np.array_split(own, -(-len(own) // 1000) or 1):
                key.append(segment_values(self.prints(part, -(-n * WIDTH // 64)), n, WIDTH).ravel())
                tag.append(np.repeat(self.hash[part] & LOW, n))
        every, tags = np.concatenate(key), np.concatenate(tag).astype("<u4")
        order = np.argsort(every)
        return every[order], tags[order]

    @staticmethod
    def shingles(texts: list[bytes]) -> Sets:
        own = sets_of(texts)
        return Sets(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own), len(own))


def _met(blobs: list[bytes]) -> list[bytes]:
    """Of each message, the keys that two different documents have, and their tags."""
    got = [unframe(b) for b in blobs]
    values = [unpack_u64(v) for v, _ in got]
    tags = [np.frombuffer(t, "<u4") for _, t in got]
    every, tag = np.concatenate(values), np.concatenate(tags)
    order = np.lexsort((tag, every))
    h, t = every[order], tag[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    size = np.diff(np.append(begin, len(h)))
    met = np.zeros(len(h), bool)
    met[order] = np.repeat(t[begin] != t[begin + size - 1], size)
    out, at = [], 0
    for v, own in zip(values, tags, strict=True):
        hit = met[at : at + len(v)]
        out.append(frames(pack_u64(v[hit]), own[hit].tobytes()))
        at += len(v)
    return out


CANDIDATES = "line long, keys array<long>, part binary, text binary"
CANDIDATES_ARROW = pa.schema([("line", pa.int64()), ("keys", pa.list_(pa.int64())), ("part", pa.binary()), ("text", pa.binary())])


def _candidates(block: Block, replies: dict[int, bytes]) -> pa.Table | None:
    """The documents with a key that another has, and those keys."""
    got = [unframe(x) for x in replies.values()]
    if not sum(len(t) for _, t in got):
        return None
    keys, tags = np.concatenate([unpack_u64(v) for v, _ in got]), np.concatenate([np.frombuffer(t, "<u4") for _, t in got])
    order = np.argsort(tags, kind="stable")
    keys, tags = keys[order].view(np.int64), tags[order]
    x = Texts(block)
    at = x.different()
    low = (x.hash[at] & LOW).astype("<u4")
    begin, end = np.searchsorted(tags, low), np.searchsorted(tags, low, side="right")
    hit = np.flatnonzero(end > begin)
    part = x.prints(at[hit], PART).astype("<u8")
    lists = [keys[a:z].tolist() for a, z in zip(begin[hit].tolist(), end[hit].tolist(), strict=True)]
    return pa.table({"line": x.hash[at[hit]].view(np.int64), "keys": pa.array(lists, pa.list_(pa.int64())), "part": pa.array([p.tobytes() for p in part], pa.binary()), "text": pa.array([x.bare[k] for k in at[hit].tolist()], pa.binary())})


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key's documents, those with another at DISTANCE or less; whole keys come in one partition."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    key, line = t.column("key").to_numpy(), t.column("line").to_numpy()
    order = np.argsort(key, kind="stable")
    key, line = key[order], line[order]
    part = np.frombuffer(b"".join(t.column("part").to_pylist()), "<u8").reshape(-1, PART)[order]
    near, at, gap = np.zeros(len(key), bool), np.arange(len(key)), 1
    while len(at := at[at + gap < len(key)]) and len(at := at[key[at] == key[at + gap]]):
        both = at[np.bitwise_count(part[at] ^ part[at + gap]).sum(1, dtype=np.int64) <= DISTANCE]
        near[both] = near[both + gap] = True
        gap += 1
    yield pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(line[near])], ["key", "line"])


def _edges(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of similar documents among those of one key; groups that recur are compared once, large ones as pairs of tiles."""
    sized = scratch.keep(rows.join(shuffled(texts.select("line", F.length("text").cast("long").alias("size"))), "line"), "sized")
    groups = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("bytes") / TILE_BYTES)).cast("long").alias("tiles")
    once = scratch.keep(groups.groupBy("n", "sum").agg(F.min("key").alias("key"), F.min("bytes").alias("bytes")).select("key", "n", "bytes", tiles), "groups")
    n, size = once.agg(F.sum(F.col("n") * F.col("tiles")), F.sum(F.col("bytes") * F.col("tiles"))).first()
    tasks = max(partitions(rows.sparkSession), -(-(n or 0) // ROWS_PER_TASK), -(-(size or 0) // (2 * TILE_BYTES)))
    dealt = sized.join(shuffled(once.select("key", "tiles")), "key").withColumn("tile", F.pmod(F.xxhash64("line"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = (F.least("tile", "other") * (1 << 20) + F.greatest("tile", "other")).alias("pair")
    dealt = dealt.select("key", pair, "line").join(shuffled(texts.select("line", "text")), "line")
    return scratch.keep(dealt.repartition(tasks, "key", "pair").mapInArrow(lambda batches: _verify(batches, Texts), "a long, b long"), "edges")


def near_components(post: Post, scratch: Scratch) -> DataFrame:
    """(node, root) of the sets that are similar to others."""
    buckets = post.buckets

    def keys(block: Block):
        key, tag = Texts(block).keys()
        for b, x, y in split_by_bucket(key, buckets):
            yield b, frames(pack_u64(key[x:y]), tag[x:y].tobytes())

    met = scratch.keep(post.answer(post.send(keys), _met), "met")
    found = scratch.keep(post.receive(met, _candidates, CANDIDATES, CANDIDATES_ARROW), "candidates")
    scratch.drop("met")
    texts = scratch.keep(found.groupBy("line").agg(F.first("keys").alias("keys"), F.first("part").alias("part"), F.first("text").alias("text")), "texts")
    scratch.drop("candidates")
    rows = texts.select("line", "part", F.explode("keys").alias("key"))
    # Values of very many documents aren't narrowed by distance: nearly all of theirs have some near.
    crowded = scratch.keep(rows.groupBy("key").count().where(F.col("count") > TILE).select("key"), "crowded")
    few = rows.join(shuffled(crowded), "key", "left_anti").repartition("key").mapInArrow(_near, "key long, line long")
    rows = scratch.keep(few.union(rows.join(shuffled(crowded), "key", "left_semi").select("key", "line")), "near")
    segment = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    edges = _edges(rows.where(segment < FIRST), texts, scratch)
    root = scratch.keep(components(edges, scratch), "root")
    named = rows.where(segment >= FIRST).join(shuffled(root), rows["line"] == root["node"], "left").select("key", "line", F.coalesce("root", "line").alias("root"))
    apart = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    more = _edges(named.select("key", "line").join(shuffled(apart), "key", "left_semi"), texts, scratch)
    return components(edges.union(more), scratch)


def keep_one(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document, by doc_id, of each component of near copies, and those without a doc_id."""
    blocks, raw = to_blocks(docs, scratch, doc_id, text, BLOCK_BYTES, whole_rows=True)
    count = blocks.agg(F.sum("n_docs")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b in Block.of(t):
                name = Texts(b).hash.view(np.int64)
                yield pa.RecordBatch.from_arrays([b.id_column(), pa.array(name), pa.array(np.full(len(name), b.block)), pa.array(np.arange(len(name)))], ["doc_id", "fp", "block", "place"])

    found = scratch.keep(blocks.mapInArrow(run, "doc_id long, fp long, block long, place long"), "names")
    root = near_components(Post(blocks, max(raw, count * KEY_BYTES), BUCKET_BYTES), scratch)
    names = found.where("doc_id is not null").select("fp").distinct()
    owned = names.join(shuffled(root), names["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("component_id"))
    return first_rows(docs, blocks, found, owned, text)
