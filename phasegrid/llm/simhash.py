"""Operator 10: SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into segments.  Each segment has a table of its
own: rows (segment, value, fingerprint).  Two fingerprints within a distance of
D differ by at most D // segments bits in some segment, so each fingerprint
enumerates, segment by segment, the values in a Hamming ball of that radius,
fetches the table's rows at those values, and every row fetched is verified by
the complete distance.  For the production distance 2 that is two segments of 32
bits and radius 1: 66 look-ups a fingerprint, two table rows.

A value that more than `hot` different fingerprints share would make every look-up
there long.  Such crowded values stay out of the tables; their fingerprints meet
each other at whole keys instead, in balls of half the distance round both, where
a key holds a bounded number of fingerprints and each is linked with the smallest.
A pair of which one value is crowded and the other isn't is found at the other's,
so no link is lost.  Connected components follow.

Cases: null, empty and all-blank texts have fingerprint zero and link like any
other; one or two words are one shingle; repeated shingles count each time;
equal texts have equal rows; ties between components go to the smallest doc_id;
a null doc_id takes no part in links and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import M2, MESSAGE, Block, Scratch, components, messages, mix, receive, row_schemas, shuffled, to_blocks

SEED = 42
#: Bits that may differ, segments, and fingerprints that one value of a segment may have in its table.
DISTANCE, SEGMENTS, HOT = 2, 2, 256


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned number."""
    parts = text.lower().split()  # bytes: A-Z only, and blanks 20 and 09-0D only
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: n - 1]]
    stops = ends[min(words, len(parts)) - 1 :]
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter((hash_(joined[a : b - 1], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # memory stays bounded for very long texts
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


#: Factors that derive further hashes from one.
FACTORS = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """A longer fingerprint: majority bits of as many 64-bit words, hashes derived from each shingle's own."""
    out, step = [], max(1, (1 << 20) // len(h))  # memory stays bounded for very long texts
    for at in range(0, words, step):
        x = h[:, None] * FACTORS[at : min(at + step, words)]
        x ^= x >> np.uint64(32)
        x *= M2
        x ^= x >> np.uint64(29)
        out.append(majority(x))
    return np.concatenate(out)


def majority(x: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows, counted in binary by full adders over whole words."""
    planes, level = [], x
    while len(level):
        carries = [level[:0]]
        while (m := len(level) // 3) > 0:
            a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            odd = a ^ b
            carries.append((a & b) | (c & odd))
            level = np.concatenate([odd ^ c, level[3 * m :]])
        if len(level) == 2:
            carries.append(level[:1] & level[1:])
            level = level[:1] ^ level[1:]
        planes.append(level[0])
        level = np.concatenate(carries)
    over, equal = np.zeros_like(x[0]), ~np.zeros_like(x[0])
    for k in reversed(range(len(planes))):
        if len(x) // 2 >> k & 1:
            equal &= planes[k]
        else:
            over |= equal & planes[k]
            equal &= ~planes[k]
    return over


def segment_values(prints: np.ndarray, segments: int, width: int) -> np.ndarray:
    """The value of each segment of each fingerprint, with the segment's number below it, as one uint64."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : segments * width]
    packed = np.packbits(bits.reshape(len(prints), segments, width), axis=2)
    wide = np.zeros((len(prints), segments, 4), np.uint8)
    wide[:, :, : packed.shape[2]] = packed
    return wide.view(">u4")[:, :, 0].astype(np.uint64) << np.uint64(32) | np.arange(segments, dtype=np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint((t.as_py() or "").encode(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most `radius` of the low `bits` bits, as signed longs."""
    masks = [sum(1 << k for k in at) for r in range(radius + 1) for at in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _each(rows: list[tuple[int, ...]], names: str) -> Column:
    """One row for each of the constants, in columns of these names."""
    return F.explode(F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(r, names.split(), strict=True))) for r in rows)))


def segment_rows(table: DataFrame, segments: int, radius: int) -> DataFrame:
    """(segment, value, rep, fp): every value within `radius` of each segment's own."""
    width = -(-64 // segments)
    sizes = [min(width, 64 - s * width) for s in range(segments)]
    rows = [(s, s * width, (1 << n) - 1 if n < 64 else -1, m) for s, n in enumerate(sizes) for m in ball(n, radius)]
    df = table.select("rep", "fp", _each(rows, "segment shift low mask").alias("k"))
    value = F.expr("(shiftrightunsigned(fp, int(k.shift)) & k.low) ^ k.mask")
    return df.select("k.segment", value.alias("value"), "rep", "fp")


def near_links(table: DataFrame, scratch: Scratch, distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(a, b): documents whose fingerprints, connected at `distance` or fewer differing bits, are linked.

    `table` is (rep, fp), each fp once.
    """
    at = ["segment", "value"]
    own = segment_rows(table, segments, 0)
    crowded = scratch.keep(own.groupBy(*at).count().where(F.col("count") > hot).select(*at), "crowded")
    index = scratch.keep(own.join(shuffled(crowded), at, "left_anti"), "index")
    probes = segment_rows(table, segments, distance // segments)
    met = probes.join(shuffled(index.select(*at, F.col("rep").alias("other"), F.col("fp").alias("its"))), at)
    met = met.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("its"))) <= distance) & (F.col("rep") != F.col("other")))
    crowd = own.join(shuffled(crowded), at, "left_semi").select("rep", "fp").distinct()
    return met.select(F.col("rep").alias("a"), F.col("other").alias("b")).union(whole_links(crowd, distance))


def whole_links(table: DataFrame, distance: int) -> DataFrame:
    """(a, b) of fingerprints within `distance`: both meet at a key half-way, where the smallest stands for all."""
    inner = distance // 2
    rows = [(m, int((m & (1 << 64) - 1).bit_count() <= inner)) for m in ball(64, distance - inner)]
    keys = table.select("rep", "fp", _each(rows, "mask inner").alias("k")).select("rep", F.col("fp").bitwiseXOR(F.col("k.mask")).alias("key"), F.col("k.inner").alias("inner"))
    first = F.min(F.when(F.col("inner") == 1, F.col("rep"))).over(Window.partitionBy("key"))
    return keys.select("rep", first.alias("first")).where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))


def owners(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component_id) of each fingerprint of (doc_id, fp, ...)."""
    table = scratch.keep(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")).select("rep", "fp"), "table")
    root = components(near_links(table, scratch), scratch)
    return table.join(shuffled(root), table["rep"] == root["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    found = scratch.keep(fingerprints(docs, words, doc_id, text), "fingerprints")
    name = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return found.join(shuffled(owners(found, scratch)), "fp", "left").select("doc_id", name, own)


def keep_one(docs: DataFrame, scratch: Scratch, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document, by doc_id, of each component, and those without a doc_id."""
    blocks, _ = to_blocks(docs, scratch, doc_id, text, whole_rows=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for b in Block.of(t):
                fp = np.array([fingerprint(x, words) for x in b.texts()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.id_column(), pa.array(fp), pa.array(np.full(len(fp), b.block)), pa.array(np.arange(len(fp)))], ["doc_id", "fp", "block", "place"])

    found = scratch.keep(blocks.mapInArrow(run, "doc_id long, fp long, block long, place long"), "fingerprints")
    return first_rows(docs, blocks, found, owners(found, scratch), text)


def first_rows(docs: DataFrame, blocks: DataFrame, found: DataFrame, owned: DataFrame, text: str) -> DataFrame:
    """Of the documents (doc_id, fp, block, place) the first of each component (fp, component_id), and those without a doc_id."""
    columns = docs.columns
    schema, arrow = row_schemas(docs)
    first = found.where("doc_id is not null").join(shuffled(owned), "fp").groupBy("component_id").agg(F.min(F.struct("doc_id", "block", "place")).alias("k"))
    stay = first.select("k.block", "k.place").union(found.where("doc_id is null").select("block", "place"))

    def note(t: pa.Table) -> pa.Table:
        return messages([0], [t.column("block")[0].as_py()], [np.sort(t.column("place").to_numpy()).astype("<i8").tobytes()])

    def emit(b: Block, replies: dict[int, bytes]) -> pa.Table:
        kept = set(np.frombuffer(replies.get(0, b""), "<i8").tolist())
        return b.rows(columns, {}, {k for k in range(len(b.ids)) if k not in kept}, text)

    return receive(blocks, stay.groupBy("block").applyInArrow(note, MESSAGE), emit, schema, arrow)
