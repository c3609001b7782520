"""Operator 6: embedding near-duplicates by sign hashing.

Equal vectors are merged first.  Random hyperplanes give each different vector
a code in each of several tables; the number of hyperplanes follows the number
of vectors and the number of tables follows from the recall wanted at the
threshold itself.  What is shuffled to the tables is an id and the signs of all
hyperplanes (some 25 bytes).  Vectors that share a code in a table meet there,
and their signs tell which can be near: a pair at the threshold differs in more
signs than `slack` standard deviations allow with probability 3e-7.  Only
vectors with such a partner fetch their values, for that bucket, and every pair
is verified by its exact cosine in double precision.  A pair counts in the first
table where it meets.  A task emits, for each vector, the links counted there
and one edge to the smallest vector of its local component - never the pairs.
Buckets beyond `TILE` vectors are dealt out as pairs of tiles.  Distributed
connected components follow.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths do not link; equal vectors link
with each other; rows that repeat a vec_id are one node with the links of all; a null vec_id
links with nothing and keeps nulls; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import Scratch, components, mix, partitions

COSINE, RECALL, BUCKET, TILE, SLACK, SEED = 0.9, 0.99, 64, 2048, 5.0, 20240
ROWS_PER_TASK = 60_000
#: Rows of a bucket that are compared at a time.
STEP = 512


class Plan(NamedTuple):
    """Hyperplanes in a table, tables, and the most signs of all in which near vectors differ."""

    bits: int
    tables: int
    apart: int


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, slack: float = SLACK) -> Plan:
    """For n different vectors."""
    bits = min(48, max(2, round(math.log2(max(n, 1) / BUCKET + 1))))
    odds = math.acos(cosine) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - odds) ** bits))
    m = bits * tables
    return Plan(bits, tables, math.ceil(m * odds + slack * math.sqrt(m * odds * (1 - odds))))


@lru_cache(maxsize=4)
def planes(d: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).standard_normal((count, d)).T


def signs(x: np.ndarray, p: Plan) -> np.ndarray:
    """The side of each row of each hyperplane."""
    return x @ planes(x.shape[1], p.bits * p.tables) > 0


def codes(sides: np.ndarray, p: Plan) -> np.ndarray:
    """The code of each row in each table."""
    return sides.reshape(len(sides), p.tables, p.bits) @ (np.int64(1) << np.arange(p.bits, dtype=np.int64))


def keys(code: np.ndarray, d: int) -> np.ndarray:
    """Table number above 48 bits of table, dimension and code."""
    table = np.arange(code.shape[1], dtype=np.uint64)
    h = mix(mix(code.astype(np.uint64) + np.uint64(d) * np.uint64(0x9E3779B97F4A7C15)) + table)
    return (table << np.uint64(48) | h >> np.uint64(16)).view(np.int64)


def values(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length; the first byte tells single from double precision."""
    return np.array([np.frombuffer(v, "<f4" if v[0] == 4 else "<f8", offset=1) for v in raw], np.float64)


def prepare(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): v the vector's numbers as bytes, in single precision where that holds them, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = x.values if x.is_valid and k is not None else None
                v = None if x is None or x.null_count or not len(x) else x.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if v is None or not np.isfinite(v).all() or not v.any():
                    out.append(None)
                    continue
                with np.errstate(over="ignore"):
                    single = v.astype("<f4")
                out.append(b"\4" + single.tobytes() if (single == v).all() else b"\x08" + v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return table.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


def _blocks(key: np.ndarray, pair: np.ndarray, tile: np.ndarray, rep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """For each bucket or pair of tiles: its rows, and pairs of row ranges to compare."""
    order = np.lexsort((rep, tile, pair, key))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(pair[order]) != 0), [True]]))
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if z - a < 2:
            continue
        rows = order[a:z]
        one = pair[rows[0]] >> 20 == pair[rows[0]] & (1 << 20) - 1
        split = z - a if one else int((tile[rows] == tile[rows[0]]).sum())
        left = [(s, min(s + STEP, split)) for s in range(0, split, STEP)]
        right = left if one else [(s, min(s + STEP, z - a)) for s in range(split, z - a, STEP)]
        yield rows, one, [(x, y) for x in left for y in right if not one or y[0] >= x[0]]


def _fresh(i: np.ndarray, j: np.ndarray, code: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs share the code of this table and of none before."""
    out = np.empty(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        s = slice(a, a + (1 << 16))
        same = code[i[s], : table + 1] == code[j[s], : table + 1]
        out[s] = same[:, table] & ~same[:, :table].any(1)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


LINKS = "rep long, links long, peer long"
MEMBERS = "key long, rep long, sketch binary"


def _dealt(rows: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
    """Buckets that one tile holds stay whole; larger ones become pairs of tiles."""
    large = sizes.where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).cast("long").alias("tiles"))
    df = rows.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    df = df.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = F.least("tile", "other") * (1 << 20) + F.greatest("tile", "other")
    return df.withColumn("pair", pair).drop("other", "tiles").repartition(tasks, "key", "pair")


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(batches)
    t = pa.Table.from_batches(got) if got else None
    return t if t is not None and t.num_rows else None


def members(different: DataFrame, p: Plan, sketched: bool = True) -> DataFrame:
    """(key, rep, sketch): each vector in each table, with the signs of all hyperplanes."""
    width = -(-p.bits * p.tables // 64) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            shape = np.array([(len(v), v[0]) for v in raw], np.int64).reshape(-1, 2)
            d = (shape[:, 0] - 1) // shape[:, 1]
            for size in sorted(set(d.tolist())):
                own = np.flatnonzero(d == size)
                for a in range(0, len(own), 2000):
                    at = own[a : a + 2000]
                    sides = signs(values([raw[k] for k in at.tolist()]), p)
                    key = keys(codes(sides, p), size)
                    packed = np.zeros((len(at), width), np.uint8)
                    bits = np.packbits(sides, axis=1)
                    packed[:, : bits.shape[1]] = bits
                    sketch = [x.tobytes() for x in packed] if sketched else [b""] * len(at)
                    rows = np.repeat(np.arange(len(at)), p.tables)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), b.column(0).take(pa.array(at[rows])), pa.array(sketch, pa.binary()).take(pa.array(rows))], ["key", "rep", "sketch"])

    return different.select("rep", "v").mapInArrow(run, MEMBERS)


def candidates(different: DataFrame, p: Plan, tasks: int) -> DataFrame:
    """(key, rep): vectors that have a partner in this bucket which their signs allow, and which they don't meet before."""
    width = p.bits * p.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        key, pair, tile, rep = (t.column(c).to_numpy() for c in ("key", "pair", "tile", "rep"))
        raw = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        found_key, found_rep = [], []
        for rows, one, parts in _blocks(key, pair, tile, rep):
            sketch, table = raw[rows], int(key[rows[0]] >> 48)
            word, near = sketch.view("<u8"), np.zeros(len(rows), bool)
            code = None
            for (a, z), (c, e) in parts:
                apart = np.zeros((z - a, e - c), np.int64)
                for w in range(word.shape[1]):
                    apart += np.bitwise_count(word[a:z, w, None] ^ word[None, c:e, w])
                i, j = np.nonzero(np.triu(apart <= p.apart, 1) if one and a == c else apart <= p.apart)
                if not len(i):
                    continue
                if code is None:
                    code = codes(np.unpackbits(sketch, axis=1, count=width).astype(bool), p)
                ok = _fresh(i + a, j + c, code, table)
                near[i[ok] + a] = near[j[ok] + c] = True
            found_key.append(key[rows[near]])
            found_rep.append(rep[rows[near]])
        if found_key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_key)), pa.array(np.concatenate(found_rep))], ["key", "rep"])

    sizes = members(different, p, sketched=False).groupBy("key").count()
    return _dealt(members(different, p), sizes, tasks).mapInArrow(run, "key long, rep long").distinct()


def links(different: DataFrame, scratch: Scratch, n: int, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(rep, links, peer): links counted in one place, and one edge there.

    `different` is (rep, copies, v), n rows, each v once.
    """
    p = plan(n, cosine, recall)
    tasks = max(partitions(different.sparkSession), -(-n * p.tables // ROWS_PER_TASK))
    near = scratch.keep(candidates(different, p, tasks), "near")
    found = near.join(different.select("rep", "copies", "v"), "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        key, pair, tile, rep, copies = (t.column(c).to_numpy() for c in ("key", "pair", "tile", "rep", "copies"))
        raw = t.column("v").to_pylist()
        out: list[list[np.ndarray]] = [[], [], []]
        for rows, one, parts in _blocks(key, pair, tile, rep):
            x, table = values([raw[k] for k in rows.tolist()]), int(key[rows[0]] >> 48)
            ids, many, size = rep[rows], copies[rows], np.sqrt((x * x).sum(1))
            code, found_i, found_j = codes(signs(x, p), p), [], []
            for (a, z), (c, e) in parts:
                near_ = (x[a:z] @ x[c:e].T) / size[a:z, None] / size[None, c:e] >= cosine
                i, j = np.nonzero(np.triu(near_, 1) if one and a == c else near_)
                ok = _fresh(i + a, j + c, code, table)
                found_i.append(i[ok] + a)
                found_j.append(j[ok] + c)
            i, j = np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_j])
            if not len(i):
                continue
            count = np.bincount(i, many[j], len(rows)).astype(np.int64) + np.bincount(j, many[i], len(rows)).astype(np.int64)
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            root = ids[by_id][_roots(len(ids), place[i], place[j])[place]]
            hit = count > 0
            for col, x_ in zip(out, (ids[hit], count[hit], root[hit]), strict=True):
                col.append(x_)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["rep", "links", "peer"])

    return _dealt(found, near.groupBy("key").count(), tasks).mapInArrow(verify, LINKS)


def near_duplicates(table: DataFrame, scratch: Scratch, cosine: float = COSINE, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    ready = scratch.keep(prepare(table, vec_id, embedding), "vectors")
    different = scratch.keep(ready.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "different")
    found = scratch.keep(links(different, scratch, different.count(), cosine, recall), "links")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")), scratch)
    owner = different.join(total, "rep", "left").join(root, different["rep"] == root["node"], "left")
    owner = owner.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = ready.join(owner, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
