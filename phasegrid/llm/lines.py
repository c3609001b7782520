"""Operator 4: fuzzy line deduplication by MinHash.

Lines (split at \\n, blanks stripped, none left out but blank ones) are compared
by the sets of their 7-character shingles; one of fewer characters is its own
only shingle, so it has exact copies only.  A one-permutation MinHash signature of
80 bins, empty bins filled from hashed others, is cut into 16 bands of 5: a
pair at Jaccard 0.8 meets in some band with probability 0.998.  Band values
that only one line has are settled by a count over the corpus (packed blocks);
the others' lines meet in groups, equal groups of different bands only once,
large groups as pairs of tiles.  There every pair that isn't connected yet is
verified by its exact Jaccard similarity.  Distributed union-find makes
components; the line with the smallest (doc_id, position) of each stays.

Cases: null and empty texts have no lines; blank lines always stay;
equal lines are one line with several places; repeats inside a document count;
rows that repeat a doc_id are separate documents, ties going to the earlier
block; a null doc_id is the smallest; texts and lines of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import MESSAGE, MESSAGE_ARROW, Block, Post, Scratch, components, frames, messages, mix, pack_u64, partitions, row_schemas, split_by_bucket, to_blocks, unframe, unpack_u64, window_hash

SHINGLE, MIN_CHARS, SIMILARITY, BANDS, ROWS, TILE = 7, 1, 0.8, 16, 5, 2000
BINS = BANDS * ROWS
BUCKET_BYTES, ROWS_PER_TASK, TILE_BYTES = 16_000_000, 20_000, 1_000_000
EMPTY = np.uint64(2**64 - 1)
PROBES = np.random.default_rng(4).integers(0, BINS, (40, BINS))


class Lines:
    """The lines of a block; `use` marks those that take part."""

    def __init__(self, block: Block):
        self.block = block
        self.raw: list[bytes] = []
        counts = []
        for null, t in zip(block.null.tolist(), block.texts(), strict=True):
            own = [] if null else t.split(b"\n")
            self.raw += own
            counts.append(len(own))
        self.counts = np.array(counts, np.int64)
        self.doc = np.repeat(np.arange(len(counts)), self.counts)
        self.pos = np.arange(len(self.raw)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.bare = [x.strip(b" \t\r\x0b\x0c") for x in self.raw]
        self.use = np.fromiter((len(x) >= MIN_CHARS for x in self.bare), bool, len(self.bare))
        self.hash = np.zeros(len(self.bare), np.uint64)
        self.hash[self.use] = np.fromiter((xxhash.xxh64_intdigest(x) for x, u in zip(self.bare, self.use.tolist(), strict=True) if u), np.uint64, int(self.use.sum()))

    def different(self) -> np.ndarray:
        """One index for each different line that can be like another, in the order of its hash."""
        at = np.flatnonzero(self.use & self.several())
        return at[np.unique(self.hash[at], return_index=True)[1]]

    def several(self) -> np.ndarray:
        """Lines of a shingle's length or more: shorter ones have exact copies only."""
        return np.fromiter((len(x) >= SHINGLE and (len(x) >= 4 * SHINGLE or len(x.decode()) >= SHINGLE) for x in self.bare), bool, len(self.bare))

    def signatures(self, at: np.ndarray) -> np.ndarray:
        return signatures([self.bare[k] for k in at.tolist()])

    @staticmethod
    def shingles(lines: list[bytes]) -> Sets:
        return shingles(lines)


def signatures(lines: list[bytes]) -> np.ndarray:
    """One-permutation MinHash of the character shingles of each line (each has some)."""
    text = [x.decode() for x in lines]
    size = np.array([len(x) for x in text], np.int64)
    out = np.full((len(text), BINS), EMPTY)
    flat = out.ravel()
    begin, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(text):  # about 64 thousand characters at a time stay in cache
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + (1 << 16), side="right")) - 1)
        codes = np.frombuffer("".join(text[at:to]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = mix(window_hash(mix(codes + np.uint64(1)), SHINGLE, 0x9E3779B97F4A7C15))
        line = np.repeat(np.arange(at, to), size[at:to])
        inside = np.arange(len(h)) + SHINGLE <= np.repeat(begin[at + 1 : to + 1] - begin[at], size[at:to])[: len(h)]
        h, line = h[inside], line[: len(inside)][inside]
        to_bins(flat, line, h)
        at = to
    return filled(out)


def to_bins(flat: np.ndarray, line: np.ndarray, h: np.ndarray) -> None:
    """The smallest hash of each bin of each line."""
    np.minimum.at(flat, line * BINS + ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64), h)


def filled(out: np.ndarray) -> np.ndarray:
    """The signatures, empty bins filled from hashed others (each line has some)."""
    rows = np.flatnonzero((out == EMPTY).any(1))
    kept = out[rows]  # only these rows, and of these ever fewer, have gaps
    for probe in PROBES:
        if not len(rows):
            break
        now = out[rows]
        now = np.where(now == EMPTY, kept[:, probe], now)
        out[rows] = now
        open_ = (now == EMPTY).any(1)
        rows, kept = rows[open_], kept[open_]
    out[rows] = np.where(out[rows] == EMPTY, kept.min(1)[:, None], out[rows])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash for each line and band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def _keys(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of the different lines, ascending, and a tag of the line of each."""
    at = x.different()
    key = bands(x.signatures(at)).ravel() if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    return key[order], np.repeat(_tags(x, at), BANDS)[order]


def _tags(x: Lines, at: np.ndarray) -> np.ndarray:
    return (x.hash[at] & np.uint64(0xFFFFFFFF)).astype("<u4")


def _met(blobs: list[bytes]) -> list[bytes]:
    """Of each message, the keys that two different lines have, and their tags."""
    got = [unframe(b) for b in blobs]
    values = [unpack_u64(v) for v, _ in got]
    tags = [np.frombuffer(t, "<u4") for _, t in got]
    every = np.sort(np.concatenate(values))
    again = every[1:][every[1:] == every[:-1]]  # few, as a rule
    again = again[np.concatenate([[True], again[1:] != again[:-1]])[: len(again)]]
    low, high, met = np.full(len(again), 0xFFFFFFFF, np.uint32), np.zeros(len(again), np.uint32), np.zeros(len(again), bool)
    found = []
    for v, t in zip(values, tags, strict=True):
        place = np.searchsorted(again, v)
        hit = np.flatnonzero(place < len(again))
        hit = hit[again[place[hit]] == v[hit]]
        place = place[hit]
        np.minimum.at(low, place, t[hit])
        np.maximum.at(high, place, t[hit])
        met[place[1:][place[1:] == place[:-1]]] = True  # of one block: different lines, whatever their tags
        found.append((hit, place))
    met |= low != high
    out = []
    for v, t, (hit, place) in zip(values, tags, found, strict=True):
        hit = hit[met[place]]
        out.append(frames(pack_u64(v[hit]), t[hit].tobytes()))
    return out


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


CANDIDATES = "block long, line long, keys array<long>, text binary"
CANDIDATES_ARROW = pa.schema([("block", pa.int64()), ("line", pa.int64()), ("keys", pa.list_(pa.int64())), ("text", pa.binary())])


def numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each value, equal for equal ones only, and a bound that all are below.

    A value's number is its place in a table, if it is what stands there in the
    end; the others go to a table of their own, and so on.  This takes a third
    of a sort's time, and each table settles one value at least.
    """
    number, base, factor = np.zeros(len(values), np.int64), 0, 0x9E3779B97F4A7C15
    open_ = np.arange(len(values))
    while len(open_):
        own = values[open_]
        bits = max(4, len(own).bit_length())
        place = (own * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)
        table = np.empty(1 << bits, np.uint64)
        table[place] = own
        number[open_] = place + base
        open_ = open_[table[place] != own]
        base, factor = base + (1 << bits), (factor * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
    return number, max(base, 1)


class Sets:
    """The different shingles of each of some lines, as numbers below `n`: line k has `number[begin[k]:begin[k + 1]]`."""

    def __init__(self, line: np.ndarray, shingle: np.ndarray, lines: int):
        number, self.n = numbered(shingle)
        bits = np.int64(self.n.bit_length())
        both = np.sort(line.astype(np.int64) << bits | number)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
        self.number = (both & ((np.int64(1) << bits) - 1)).astype(np.int32)
        self.size = np.bincount(both >> bits, minlength=lines)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(self.n, bool)

    def like(self, x: int, others: np.ndarray) -> np.ndarray:
        """Whether each of the others has Jaccard similarity SIMILARITY or more with x; all have shingles."""
        own = self.number[self.begin[x] : self.begin[x + 1]]
        self.mark[own] = True
        if len(others) == 1:
            k = others[0]
            both = np.count_nonzero(self.mark[self.number[self.begin[k] : self.begin[k + 1]]])
        else:
            size = self.size[others]
            at = np.cumsum(size) - size
            flat = np.repeat(self.begin[others] - at, size) + np.arange(size.sum())
            both = np.add.reduceat(self.mark[self.number[flat]], at, dtype=np.int64)
        self.mark[own] = False
        return both >= SIMILARITY * (len(own) + self.size[others] - both)


def shingles(lines: list[bytes]) -> Sets:
    """Seven characters below 256 are the number of their bytes; others stand as 63 bits of a hash."""
    found, lines_, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    while at < len(lines):  # about 64 thousand characters at a time
        to, room = at, 0
        while to < len(lines) and (to == at or room + len(lines[to]) <= 1 << 16):
            room += len(lines[to])
            to += 1
        text = [x.decode() for x in lines[at:to]]
        codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        line = np.repeat(np.arange(at, to, dtype=np.int32), [len(x) for x in text])
        exact = window_hash(codes, SHINGLE, 256)
        wide = window_hash((codes > 255).astype(np.uint64), SHINGLE, 1) > 0
        if wide.any():
            exact[wide] = mix(window_hash(mix(codes + np.uint64(1)), SHINGLE, 0x9E3779B97F4A7C15))[wide] | np.uint64(1 << 63)
        inside = line[: len(exact)] == line[len(line) - len(exact) :]
        found.append(exact[inside])
        lines_.append(line[: len(exact)][inside])
        at = to
    return Sets(np.concatenate(lines_), np.concatenate(found), len(lines))


def _verify(batches: Iterator[pa.RecordBatch], kind: type[Lines] = Lines) -> Iterator[pa.RecordBatch]:
    """Groups of one partition: edges between lines that are similar and not yet connected here.

    A line is compared with all of its group that it isn't connected with, at
    once; a group is done when the lines that haven't had their turn are one
    component, so each pair of different components has been compared.  The
    smallest components go first: in a large group of copies the few that are
    unlike have their turns, not the copies.
    """
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    key, pair, line = (t.column(c).to_numpy() for c in ("key", "pair", "line"))
    names, first, local = np.unique(line, return_index=True, return_inverse=True)
    sets = kind.shingles(t.column("text").take(pa.array(first)).to_pylist())
    order = np.lexsort((local, pair, key))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(pair[order]) != 0), [True]])).tolist()
    root = list(range(len(names)))
    moved = np.zeros(len(names), bool)
    a_out: list[int] = []
    b_out: list[int] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, z in zip(edge, edge[1:], strict=False):
        members = local[order[a:z]]
        if z - a == 2:  # most groups
            new, old = sorted(map(find, members.tolist()))
            if new != old and sets.like(members[0], members[1:])[0]:
                root[old] = new
                a_out.append(new)
                b_out.append(old)
            continue
        waiting: dict[int, list[int]] = {}
        for k in members.tolist():
            waiting.setdefault(find(k), []).append(k)
        label = None
        while len(waiting) > 1:
            least = min(waiting, key=lambda r: len(waiting[r]))
            x = waiting[least].pop()
            if not waiting[least]:
                del waiting[least]
            if label is None:
                label = np.array([find(k) for k in members.tolist()])
            apart = np.flatnonzero(label != find(x))
            hits = apart[sets.like(x, members[apart])]
            if not len(hits):
                continue
            joined = set(label[hits].tolist()) | {find(x)}
            new = min(joined)
            stay = [k for r in joined for k in waiting.pop(r, ())]
            for r in joined - {new}:
                root[r] = new
                a_out.append(new)
                b_out.append(r)
            moved[list(joined)] = True
            label[moved[label]] = new
            moved[list(joined)] = False
            if stay:
                waiting[new] = stay
    yield pa.RecordBatch.from_arrays([pa.array(names[np.array(x, np.int64)]) for x in (a_out, b_out)], ["a", "b"])


def line_components(post: Post, scratch: Scratch, kind: type[Lines] = Lines) -> tuple[DataFrame, DataFrame]:
    """Candidates (block, line, ...) and (node, root) of lines, or another kind, that are similar to others."""

    buckets = post.buckets

    def keys(block: Block):
        key, tag = _keys(kind(block))
        for b, x, y in split_by_bucket(key, buckets):
            yield b, frames(pack_u64(key[x:y]), tag[x:y].tobytes())

    met = scratch.keep(post.answer(post.send(keys), _met), "met")

    def candidates(block: Block, replies: dict[int, bytes]) -> pa.Table | None:
        """The lines with a key that another has, and those keys: signatures aren't made again."""
        got = [unframe(x) for x in replies.values()]
        if not sum(len(t) for _, t in got):
            return None
        own, tags = np.concatenate([unpack_u64(v) for v, _ in got]), np.concatenate([np.frombuffer(t, "<u4") for _, t in got])
        order = np.argsort(tags, kind="stable")
        own, tags = _signed(own[order]), tags[order]
        x = kind(block)
        at = x.different()
        low = _tags(x, at)  # lines of one tag have each other's keys too, and are compared
        begin, end = np.searchsorted(tags, low), np.searchsorted(tags, low, side="right")
        hit = np.flatnonzero(end > begin)
        lists = [own[a:z].tolist() for a, z in zip(begin[hit].tolist(), end[hit].tolist(), strict=True)]
        return pa.table({"block": pa.array([block.block] * len(hit), pa.int64()), "line": _signed(x.hash[at[hit]]), "keys": pa.array(lists, pa.list_(pa.int64())), "text": pa.array([x.bare[k] for k in at[hit].tolist()], pa.binary())})

    found = scratch.keep(post.receive(met, candidates, CANDIDATES, CANDIDATES_ARROW), "candidates")
    lines = found.groupBy("line").agg(F.first("keys").alias("keys"), F.first("text").alias("text"))
    lines = scratch.keep(lines, "lines")
    rows = lines.select("line", F.explode("keys").alias("key"), F.length("text").cast("long").alias("size"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("sum"), F.min("line").alias("lead")).where("n > 1")
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("bytes") / TILE_BYTES)).cast("long").alias("tiles")
    # A line's small groups lie in one task, a tile at most in all: there its shingles are numbered once, and what is connected isn't compared again.
    small = (F.col("n") <= TILE // BANDS) & (F.col("bytes") <= TILE_BYTES // BANDS)
    lead = F.when(small, F.col("lead")).otherwise(F.col("key")).alias("lead")
    once = groups.groupBy("n", "sum").agg(F.min("key").alias("key"), F.min("bytes").alias("bytes"), F.min("lead").alias("lead"))
    once = scratch.keep(once.select("key", "n", "bytes", tiles, lead), "groups")
    # Each row goes to as many tasks as its group has tiles; a task has a bounded number of them, and of their bytes.
    n, size = once.agg(F.sum(F.col("n") * F.col("tiles")), F.sum(F.col("bytes") * F.col("tiles"))).first()
    tasks = max(partitions(post.blocks.sparkSession), -(-(n or 0) // ROWS_PER_TASK), -(-(size or 0) // (2 * TILE_BYTES)))
    dealt = rows.join(once.select("key", "tiles", "lead"), "key").withColumn("tile", F.pmod(F.xxhash64("line"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = (F.least("tile", "other") * (1 << 20) + F.greatest("tile", "other")).alias("pair")
    dealt = dealt.select("lead", "key", pair, "line").join(lines.select("line", "text"), "line")
    edges = dealt.repartition(tasks, "lead", "pair").mapInArrow(lambda batches: _verify(batches, kind), "a long, b long")
    return found, components(edges, scratch)


def _first(blobs: list[bytes]) -> list[bytes]:
    """For each key of each message: whether its place is the first of the corpus."""
    got = [unframe(b) for b in blobs]
    values = [unpack_u64(v) for v, _, _ in got]
    every = np.concatenate(values)
    doc = np.concatenate([np.frombuffer(d, "<i8") for _, d, _ in got])
    pos = np.concatenate([np.frombuffer(p, "<i4") for _, _, p in got])
    order = np.lexsort((np.arange(len(every)), pos, doc, every))
    h = every[order]
    first = np.zeros(len(h), bool)
    first[order] = np.concatenate([[True], h[1:] != h[:-1]])
    out, at = [], 0
    for v in values:
        out.append(np.packbits(first[at : at + len(v)]).tobytes())
        at += len(v)
    return out


def _by_key(x: Lines, node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines in use; different component keys; the index of the first line of each key here."""
    at = np.flatnonzero(x.use)
    key = x.hash[at].copy()
    if len(node):
        place = np.minimum(np.searchsorted(node, key), len(node) - 1)
        same = node[place] == key
        key[same] = root[place[same]]
    order = np.lexsort((x.pos[at], x.block.ids[x.doc[at]], key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    return at, k[new], at[order[new]]


def similar_lines(docs: DataFrame, scratch: Scratch, emit, schema: str, arrow: pa.Schema, doc_id: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """`emit(lines, gone)` for each block; `gone` marks the lines to remove."""
    blocks, raw = to_blocks(docs, scratch, doc_id, text, whole_rows=whole_rows)
    post = Post(blocks, raw, BUCKET_BYTES)
    buckets = post.buckets
    found, root = line_components(post, scratch)

    def names(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy().view(np.uint64)
        order = np.argsort(node)
        blob = frames(node[order].tobytes(), t.column("root").to_numpy().view(np.uint64)[order].tobytes())
        return messages([-1], [t.column("block")[0].as_py()], [blob])

    # The lines of each block that belong to a component, with its root.
    renamed = found.select("block", F.col("line").alias("node")).join(root, "node").groupBy("block").applyInArrow(names, MESSAGE)
    renamed = scratch.keep(renamed, "renamed")

    def table(replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        a, b = unframe(replies[-1]) if -1 in replies else (b"", b"")
        return np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)

    def places(block: Block, replies: dict[int, bytes]) -> pa.Table:
        x = Lines(block)
        _, key, first = _by_key(x, *table(replies))
        doc, pos = block.ids[x.doc[first]], x.pos[first].astype("<i4")
        return post.table(block.block, ((b, frames(pack_u64(key[p:q]), doc[p:q].astype("<i8").tobytes(), pos[p:q].tobytes())) for b, p, q in split_by_bucket(key, buckets)))

    asked = post.receive(renamed, places, MESSAGE, MESSAGE_ARROW)
    firsts = post.answer(asked, _first).union(renamed)

    def finish(block: Block, replies: dict[int, bytes]) -> pa.Table:
        x = Lines(block)
        at, key, first = _by_key(x, *table(replies))
        stays = np.zeros(len(key), bool)
        for b, p, q in split_by_bucket(key, buckets):
            stays[p:q] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=q - p).astype(bool)
        gone = np.zeros(len(x.raw), bool)
        gone[at] = True
        gone[first[stays]] = False
        return emit(x, gone)

    return post.receive(firsts, finish, schema, arrow)


def _kept(x: Lines, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    for n in x.counts.tolist():
        drop = gone[at : at + n].tolist()
        yield n, sum(drop), b"\n".join([r for r, d in zip(x.raw[at : at + n], drop, strict=True) if not d])
        at += n


DIGEST = "doc_id long, n_lines long, n_removed long, kept_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _digest(x: Lines, gone: np.ndarray) -> pa.Table:
    rows = [(n, k, hashlib.sha256(t).hexdigest()) for n, k, t in _kept(x, gone)]
    n, k, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"doc_id": x.block.id_column(), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(k, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document."""
    return similar_lines(docs, scratch, _digest, DIGEST, DIGEST_ARROW)


def clean(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines; those left blank by that are dropped."""
    columns = docs.columns
    schema, arrow = row_schemas(docs)

    def emit(x: Lines, gone: np.ndarray) -> pa.Table:
        new = {k: t.decode() for k, (_, removed, t) in enumerate(_kept(x, gone)) if removed}
        return x.block.rows(columns, new, {k for k, t in new.items() if not t.strip()}, text)

    return similar_lines(docs, scratch, emit, schema, arrow, doc_id, text, whole_rows=True)
