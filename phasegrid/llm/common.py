"""Shared plumbing: checkpoint tables, packed document blocks, connected components.

Packed blocks.  Several operators must ask the whole corpus a question about
every n-gram of every document ("does this occur elsewhere?", "how often?").
A shuffle row for each n-gram costs far more than the n-gram, so documents are
packed into blocks of a few MB; a block sends one *blob* of sorted hashes to
each hash bucket, the bucket answers with one blob for each block.  Repeats
inside a block are merged before the shuffle, so a hot n-gram costs one entry
for each block and not one for each occurrence, and no group grows with the
number of copies of a text.
"""

from __future__ import annotations

import ctypes
import gc
import math
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw bytes of one block, the other columns' too (a longer document is a block of its own), and its most rows.
BLOCK_BYTES, BLOCK_ROWS = 6_000_000, 100_000

#: Stands for a null doc_id inside a block; it sorts before all others.
NO_ID = -(2**63)

BLOCK_SCHEMA = "block long, n_docs long, raw long, ids binary, nulls binary, lens binary, body binary, rest binary"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.phasegrid.scratch", None)
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.phasegrid.scratch", at)
    return at.rstrip("/")


def trim() -> None:
    """Give freed memory back to the system: workers are reused and executors are small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only this C library has it
        pass


class Scratch:
    """Tables under the shared checkpoint folder; `drop` removes the spent ones."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{checkpoint_dir(spark)}/phasegrid-{uuid.uuid4().hex}", {}
        self.written, self.released = 0, time.monotonic()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Cut lineage: write `df` and read it back."""
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.tables[name] = path
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished plans: it does so when the driver collects its garbage.

        Not more often than every two seconds, for a collection costs about as much as a small query.
        """
        if time.monotonic() - self.released < 2:
            return
        gc.collect()
        for _ in range(2):  # what the first pass finds unreachable may hold the shuffles till the second
            self.spark._jvm.System.gc()
            time.sleep(0.1)
        self.released = time.monotonic()

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.tables.pop(name))
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so that the join is no broadcast.

    Spark judges by bytes on disk, where these tables are small; the rows of a
    table of 10 MB can be more than the driver holds.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- blocks


def _pack(block_bytes: int, others: list[str]):
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.large_binary()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        count, ids, texts, size, rest, wide = 0, [], [], 0, [], 0.0
        press = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nonlocal count, ids, texts, size, rest, wide
            lens = np.array([-1 if t is None else len(t) for t in texts], "<i8")
            row = [
                (part << 32) + count, len(ids), size, np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(),
                np.packbits(lens < 0).tobytes(), np.maximum(lens, 0).tobytes(), press.compress(b"".join(t or b"" for t in texts)),
                press.compress(_ipc(pa.Table.from_batches(rest))) if others else b"",
            ]
            count, ids, texts, size, rest, wide = count + 1, [], [], 0, [], 0.0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for b in batches:
            start = 0
            own = pa.RecordBatch.from_arrays(b.columns[2:], others) if others else None
            each = own.nbytes / max(own.num_rows, 1) if others else 0.0
            for k, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                data = text.as_py()
                data = None if data is None else data.encode()
                ids.append(doc)
                texts.append(data)
                size += len(data or b"")
                wide += each
                if size + wide >= block_bytes or len(ids) >= BLOCK_ROWS:
                    if others:
                        rest.append(own.slice(start, k + 1 - start))
                    start = k + 1
                    yield flush()
            if others and start < b.num_rows:
                rest.append(own.slice(start))
        if ids:
            yield flush()

    return run


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def to_blocks(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, whole_rows: bool = False) -> tuple[DataFrame, int]:
    """Blocks of whole documents as a table, and the raw bytes of all text.

    `whole_rows` carries every other column too, whatever its name, for `Block.rows`.
    """
    cols = [F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")]
    others = [f"c{k}" for k in range(len(docs.columns))] if whole_rows else []
    if whole_rows:  # the text's own column stays empty
        cols += [(F.lit(None).cast("string") if c == text else F.col(f"`{c}`")).alias(n) for c, n in zip(docs.columns, others, strict=True)]
    df = docs.select(*cols).mapInArrow(_pack(block_bytes, others), BLOCK_SCHEMA)
    blocks = scratch.keep(df, "blocks")
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    return blocks, raw


class Block:
    """A block read back: ids, nulls and the texts as bytes."""

    def __init__(self, block: int, ids: bytes, nulls: bytes, lens: bytes, body: bytes, rest: bytes = b""):
        self.block, self.rest = block, rest
        self.ids = np.frombuffer(ids, "<i8")
        n = len(self.ids)
        self.null = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n).astype(bool)
        self.lens = np.frombuffer(lens, "<i8")
        self.body = zstandard.ZstdDecompressor().decompress(body)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NO_ID)

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield self.body[a:b]

    def rows(self, columns: list[str], new: dict[int, str], drop: set[int], text: str = "text", length: str = "n_chars") -> pa.Table:
        """The whole rows, some with new texts (and their length), without the dropped ones."""
        t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.rest)).read_all().rename_columns(columns)
        texts = [new[k] if k in new else None if null else x.decode() for k, (null, x) in enumerate(zip(self.null.tolist(), self.texts(), strict=True))]
        t = t.set_column(columns.index(text), text, pa.array(texts, pa.string()))
        if length in columns and new:
            at = columns.index(length)
            n = [len(new[k]) if k in new else v for k, v in enumerate(t.column(at).to_pylist())]
            t = t.set_column(at, t.schema.field(at), pa.array(n, t.schema.field(at).type))
        return t.filter(pa.array([k not in drop for k in range(len(texts))])) if drop else t

    @classmethod
    def of(cls, table) -> list[Block]:
        cols = [table.column(c).to_pylist() for c in ("block", "ids", "nulls", "lens", "body", "rest")]
        return [cls(*row) for row in zip(*cols, strict=True)]


MESSAGE = "bucket long, block long, blob binary"
MESSAGE_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])

#: Messages that a block sends at most, and blocks that one relay serves.
FAN, SERVED = 4096, 256


def row_schemas(docs: DataFrame):
    """The schema of whole rows, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return docs.schema, to_arrow_schema(docs.schema)


def messages(bucket: list[int], block: list[int], blob: list[bytes]) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(blob, pa.binary())], schema=MESSAGE_ARROW)


class Post:
    """Messages between blocks and hash buckets, their number in proportion to the input.

    Up to FAN buckets a block writes to each bucket itself.  With more, buckets
    lie in columns of about the square root of their number: a block writes one
    bundle to each column, a relay (a column and some SERVED blocks) sorts the
    bundles by bucket, and answers come back the same way.  So neither blocks
    nor buckets write to all of the others.  Bucket -1 is the block itself.
    """

    def __init__(self, blocks: DataFrame, raw: int, bucket_bytes: int):
        self.blocks, self.buckets = blocks, max(8, -(-raw // bucket_bytes))
        self.relayed = self.buckets > FAN
        self.width = max(1, math.isqrt(self.buckets))
        self.groups = -(-blocks.count() // SERVED) if self.relayed else 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None}  # tasks need the numbers only

    def table(self, block: int, items: Iterable[tuple[int, bytes]]) -> pa.Table:
        """A block's (bucket, blob) items, buckets ascending, as messages."""
        out = list(items)
        if self.relayed:
            own = [x for x in out if x[0] < 0]
            columns = groupby((x for x in out if x[0] >= 0), lambda x: x[0] // self.width)
            out = own + [(c, _bundle((b, 0, blob) for b, blob in part)) for c, part in columns]
        return messages([b for b, _ in out], [block] * len(out), [x for _, x in out])

    def send(self, work: Callable[[Block], Iterable[tuple[int, bytes]]]) -> DataFrame:
        """The messages of (bucket, blob) that `work` makes of each block."""

        def run(batches):
            for t in batches:
                for block in Block.of(t):
                    yield from self.table(block.block, work(block)).to_batches()
            trim()

        return self.blocks.mapInArrow(run, MESSAGE)

    def answer(self, sent: DataFrame, work: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
        """For each bucket, an answer to each of its messages; `work` gets them in the order of the blocks."""

        def solve(t: pa.Table) -> pa.Table:
            t = t.take(pa.array(np.argsort(t.column("block").to_numpy(), kind="stable")))
            if not self.relayed:
                blobs = work(t.column("blob").to_pylist())
                trim()
                return messages(t.column("bucket"), t.column("block"), blobs)
            relay, blobs = t.column("block").to_pylist(), t.column("blob").to_pylist()
            items = sorted((block, k, x) for k, b in enumerate(blobs) for _, block, x in _open_bundle(b))
            bucket = t.column("bucket")[0].as_py()
            out: dict[int, list[tuple[int, int, bytes]]] = {}
            for (block, k, _), x in zip(items, work([x for *_, x in items]), strict=True):
                out.setdefault(k, []).append((bucket, block, x))
            trim()
            return messages([bucket] * len(out), [relay[k] for k in out], [_bundle(x) for x in out.values()])

        if not self.relayed:
            return sent.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(solve, MESSAGE)

        def sort(relay: bool):
            """A relay's bundles, sorted by bucket on the way there and by block on the way back."""

            def run(t: pa.Table) -> pa.Table:
                column, place = t.column("column")[0].as_py(), t.column("relay")[0].as_py()
                out: dict[int, list[tuple[int, int, bytes]]] = {}
                for block, blob in zip(t.column("block").to_pylist(), t.column("blob").to_pylist(), strict=True):
                    for b, from_, x in _open_bundle(blob):
                        out.setdefault(b if relay else from_, []).append((b, block if relay else from_, x))
                keys = list(out)
                blobs = [_bundle(out.pop(k)) for k in keys]
                return messages(keys, [place] * len(keys), blobs) if relay else messages([column] * len(keys), keys, blobs)

            return run

        relays = ["column", "relay"]
        there = sent.select(F.col("bucket").alias("column"), F.pmod(F.xxhash64("block"), F.lit(self.groups)).alias("relay"), "block", "blob")
        there = there.groupBy(*relays).applyInArrow(sort(True), MESSAGE)
        solved = there.groupBy("bucket").applyInArrow(solve, MESSAGE)
        back = solved.select(F.floor(F.col("bucket") / self.width).alias("column"), F.col("block").alias("relay"), "block", "blob")
        return back.groupBy(*relays).applyInArrow(sort(False), MESSAGE)

    def receive(self, answers: DataFrame, work: Callable[[Block, dict[int, bytes]], pa.Table | None], schema, empty: pa.Schema) -> DataFrame:
        """`work` gets each block with the answers to what it sent; of several rounds (a column `round`), a dict of each."""
        return receive(self.blocks, answers, work, schema, empty, self.relayed)


def receive(blocks: DataFrame, answers: DataFrame, work: Callable[[Block, dict[int, bytes]], pa.Table | None], schema, empty: pa.Schema, relayed: bool = False) -> DataFrame:
    """`work` gets each block with the blobs for it by bucket; relayed ones come in bundles."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rounds = right.column("round").to_pylist() if "round" in right.column_names else [0] * right.num_rows
        every: dict[int, dict[int, bytes]] = {}
        for k, bucket, blob in zip(rounds, right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True):
            replies = every.setdefault(k, {})
            if relayed and bucket >= 0:
                replies.update((b, x) for b, _, x in _open_bundle(blob))
            else:
                replies[bucket] = blob
        replies = every if "round" in right.column_names else every.get(0, {})
        out = [x for b in Block.of(left) if (x := work(b, replies)) is not None]
        trim()
        return pa.concat_tables(out).cast(empty) if out else empty.empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _bundle(items: Iterable[tuple[int, int, bytes]]) -> bytes:
    """(bucket, block, blob) items as one blob."""
    own = list(items)
    return frames(np.array([x[:2] for x in own], "<i8").tobytes(), *(x[2] for x in own))


def _open_bundle(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    head, *blobs = unframe(blob)
    for (bucket, block), x in zip(np.frombuffer(head, "<i8").reshape(-1, 2).tolist(), blobs, strict=True):
        yield bucket, block, x


# ---------------------------------------------------------------- hash blobs


def pack_u64(x: np.ndarray) -> bytes:
    """Sorted uint64 values as zstd of byte planes of their differences."""
    d = np.diff(x, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_u64(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def frames(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unframe(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob[:8], "<i8")[0])
    lens = np.frombuffer(blob[8 : 8 + 8 * n], "<i8").tolist()
    out, at = [], 8 + 8 * n
    for k in lens:
        out.append(blob[at : at + k])
        at += k
    return out


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def window_hash(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash, mod 2**64, of each k consecutive values, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, level, size, acc, off = base, values, 1, None, 0
    while True:
        if k & size:
            take = level[off : off + n]
            acc = take.copy() if acc is None else acc * np.uint64(power) + take
            off += size
        size *= 2
        if size > k:
            return acc
        level = level[: len(level) - size // 2] * np.uint64(power) + level[size // 2 :]
        power = power * power % 2**64


CHUNK, PLACE_BITS = 1 << 15, np.uint64(17)
PLACE = (np.uint64(1) << PLACE_BITS) - np.uint64(1)


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w consecutive hashes, the place of its smallest (leftmost of equals).

    Compares the high 47 bits with the place below them, in chunks that stay in
    cache; equal runs give the same place relative to their start.
    """
    n = len(h) - w + 1
    out = np.zeros(max(n, 0), np.int64)
    for at in range(0, n, CHUNK):
        part = h[at : at + CHUNK + w - 1]
        level, size = part & ~PLACE | np.arange(len(part), dtype=np.uint64), 1
        while size * 2 <= w:
            level, size = np.minimum(level[: len(level) - size], level[size:]), size * 2
        m = len(part) - w + 1
        level = np.minimum(level[:m], level[w - size : w - size + m])
        out[at : at + m] = (level & PLACE).astype(np.int64) + at
    return out


def split_by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """h sorted; buckets are equal ranges of hashes: (bucket, from, to) of those that have any."""
    if not len(h):
        return
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(h))
    yield from zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)


# ---------------------------------------------------------------- components


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside one partition; leaves (node, smallest node) rows."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    def rows():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 2_000_000:  # memory stays bounded; a forest may be sent in parts
            yield rows()
            parent.clear()
    yield rows()


def _stars(e: DataFrame) -> bool:
    """Whether each node has one edge and no root has any: then the stars are the components."""
    if e.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return not e.select("v").distinct().join(shuffled(e.select(F.col("u").alias("v"))), "v", "left_semi").limit(1).count()


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each node that has an edge to another, root the smallest node.

    Union-find inside partitions first, then rounds of large-star and small-star
    over the forests until they are stars; each round is a written table.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # Written first: two Python steps in one stage would hold two workers for each task.
    e = scratch.keep(e, "cc_edges")
    e = scratch.keep(e.mapInArrow(_forest, "u long, v long").distinct(), "cc")
    turn, spent = 0, ["cc_edges"]
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u != v").distinct(), f"cc_l{turn}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = scratch.keep(small.distinct(), f"cc_s{turn}")
        spent += [f"cc_l{turn}", f"cc_s{turn - 1}" if turn else "cc"]
        turn += 1
    scratch.drop(*spent)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
