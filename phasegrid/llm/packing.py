"""Operator 1: best-fit packing with certified bounds.

Documents become pieces of at most `capacity` tokens; full pieces fill a
sequence each.  The rest is packed by best-fit decreasing inside partitions.
Dual-feasible functions give each partition a lower bound: one whose bin count
equals the bound is certified and left alone.  The others break their bins with
the widest gaps, exchange the documents (a new deal over fewer partitions) and
rerun best-fit decreasing.  A round's result is taken only if it saves bins; bins
that saved none keep their place, and the next widest have their turn.  Rounds
end when the total meets the bound of all pieces, or every open bin of an
uncertified partition has taken part in vain.

Cases: null and empty texts are the end token alone; equal texts are separate
pieces; ties in length are packed in order of doc_id; an empty table gives no
rows; a text of any length is cut into whole pieces, the first the shorter one.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.bpe import Vocabulary, encoder
from phasegrid.llm.common import Scratch

#: Pieces that one partition packs, about.
GROUP = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def ranked_chunks(v: Vocabulary):
    """A chunk's ids by tiktoken over the file's vocabulary (the same merges as ranks)."""
    import tiktoken

    from phasegrid.llm.bpe import WORDS

    special = set(v.specials.values())
    ranks = {b: i for i, b in enumerate(v.bytes) if i not in special and b}
    code = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda chunk: array("I", code.encode_ordinary(chunk)).tobytes()


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, "ranked")
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = e.ids(t.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, v in zip(out, (doc, k, x, y - x, zlib.crc32(memoryview(ids)[4 * x : 4 * y])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """Bins needed for counts[x] items of length x, capacity len(counts)-1.

    Two families of dual-feasible functions: one drops items below e and rounds
    up those above capacity - e; the other counts multiples of capacity/(k+1).
    """
    c = len(counts) - 1
    x = np.arange(c + 1)
    total = int(counts.sum())
    if not total:
        return 0
    best = -(-int((counts * x).sum()) // c)
    # f_e: items > c - e count as c, items < e as 0, others as their length.
    at_least = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([np.cumsum((counts * x)[::-1])[::-1], [0]])
    for e in range(1, c // 2 + 1):
        big = at_least[c - e + 1]
        best = max(best, -(-int(big * c + mass[e] - mass[c - e + 1]) // c))
    for k in range(1, 100):
        scaled = x * (k + 1)
        u = np.where(scaled % c == 0, x * k, scaled // c * c)  # times k*c / k
        best = max(best, -(-int((counts * u).sum()) // (k * c)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item, and the fill of each bin.

    `space[r]` stacks the open bins with r places left; bit r of `has` says
    whether there are any, so the tightest bin is the lowest set bit from x up.
    """
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    space: list[list[int]] = [[] for _ in range(capacity + 1)]
    has, bins = 0, 0
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        open_ = has >> x
        if open_:
            r = x + ((open_ & -open_).bit_length() - 1)
            b = space[r].pop()
            if not space[r]:
                has &= ~(1 << r)
        else:
            r, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - r
        if r > x:
            space[r - x].append(b)
            has |= 1 << (r - x)
    fill = np.bincount(where, lengths, minlength=bins).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    return where, offset, fill


PLACED = f"{PIECES}, part long, turn int, bin long, offset long, fill long, certified boolean"


def _place(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t.column("length").to_numpy()
        where, offset, fill = best_fit(lengths, capacity)
        sure = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        cols = {c: t.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "turn")}
        return pa.table(cols | {"bin": where, "offset": offset, "fill": fill[where], "certified": np.full(len(where), sure)})

    return run


def pack(found: DataFrame, scratch: Scratch, capacity: int = 1024) -> DataFrame:
    """The pieces (a table, read more than once) with sequence_id and offset.

    sequence_id: below 0 for full pieces; else round, partition and bin.
    """
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    counts = np.zeros(capacity + 1, np.int64)
    for length, count in found.where(F.col("length") < capacity).groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = count
    goal = lower_bound(counts)
    full = found.where(F.col("length") == capacity).select(*own, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def deal(df: DataFrame, rows: int, turn: int) -> DataFrame:
        n = max(1, -(-rows // GROUP))
        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(n)).cast("long")
        return df.select(*own, part.alias("part"), F.lit(turn).alias("turn")).repartition(n, "part").groupBy("part").applyInArrow(_place(capacity), PLACED)

    def bins(df: DataFrame) -> int:
        return df.where(F.col("offset") == 0).count()

    pool = scratch.keep(deal(found.where(F.col("length") < capacity), int(counts.sum()), 0), "packed")
    used, done, turn = bins(pool), [], 0
    while used > goal:
        turn += 1
        # The bins with the widest gaps move, about a quarter of the pieces, so
        # each new partition gathers what several could not close.
        open_ = (F.col("fill") < capacity) & ~F.col("certified")
        fills = pool.where(open_).groupBy("fill").agg(F.count("*").alias("n")).orderBy("fill").collect()  # at most `capacity` rows
        room, rows, most = max(GROUP, sum(r["n"] for r in fills) // 4), 0, 0
        for r in fills:
            if rows and rows + r["n"] > room:
                break
            rows, most = rows + r["n"], r["fill"]
        gaps = open_ & (F.col("fill") <= most)
        moving = pool.where(gaps)
        if not rows or moving.select("part", "turn").distinct().limit(2).count() < 2:
            break  # what one partition has packed, another deal packs no better
        before = bins(moving)
        again = scratch.keep(deal(moving, rows, turn), f"packed{turn}")
        after = bins(again)
        done.append(pool.where(~open_))
        if after < before:
            pool, used = scratch.keep(pool.where(open_ & ~gaps).union(again), f"pool{turn}"), used - before + after
        else:
            done.append(moving)
            pool = scratch.keep(pool.where(open_ & ~gaps), f"pool{turn}")
        scratch.drop(f"packed{turn}")
    out = full
    for df in (*done, pool):
        number = F.shiftleft(F.col("turn").cast("long"), 48) + F.shiftleft("part", 24) + F.col("bin")
        out = out.union(df.select(*own, number.alias("sequence_id"), "offset"))
    return out


def pack_documents(docs: DataFrame, path: str, scratch: Scratch, capacity: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(scratch.keep(pieces(docs, path, capacity, end, doc_id, text), "pieces"), scratch, capacity)
