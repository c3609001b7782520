"""Operator 9: stupid-backoff scores.

The n-gram counts of the corpus are a relation keyed by the n-gram's hash and
partitioned by it; a document's n-grams are joined to it and the log scores are
summed for each document.  Rows are packed, for a row of its own costs far more
than an n-gram: a block of documents sends each partition its different n-grams
with their counts, the partition sums them and answers with the totals, so a
frequent n-gram costs one entry for each block.

Words and pairs go in the first round, longer n-grams one length a round.  An
n-gram that occurs in another document has both its shorter parts there, so only
those are sent whose parts were found elsewhere; that leaves out no count.

A document is scored by the counts of all *other* documents (its own counts are
taken off), else nothing would ever back off.  With m the longest context that
the word has (at most order - 1 words), the score is alpha**(m + 1 - k) *
count(k words) / count(the first k - 1) for the longest k > 1 seen elsewhere,
else alpha**m * max(count(word), 1) / max(words elsewhere, 1).  Each log is
rounded to millionths, so sums do not depend on their order.

Cases: words are runs without blanks (20, 09-0D), unchanged; null and blank
texts have no words and score 0; equal texts count for each other; rows that
repeat a doc_id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import MESSAGE, MESSAGE_ARROW, Block, Post, Scratch, frames, mix, pack_u64, split_by_bucket, to_blocks, unframe, unpack_u64, window_hash

ORDER, ALPHA = 3, 0.4
BUCKET_BYTES = 8_000_000


def _small(x: np.ndarray) -> bytes:
    """Counts, most of them small: byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _large(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


class Grams:
    """Hashes of the n-grams that end at each word of a block, for each n."""

    def __init__(self, block: Block, order: int):
        words = [t.split() for t in block.texts()]
        self.counts = np.array([len(w) for w in words], np.int64)
        total = int(self.counts.sum())
        flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, total)
        self.doc = np.repeat(np.arange(len(words)), self.counts)
        self.begin = np.cumsum(self.counts) - self.counts
        self.place = np.arange(total) - np.repeat(self.begin, self.counts)
        self.hash: dict[int, np.ndarray] = {}
        for n in range(1, order + 1):
            h = np.zeros(total, np.uint64)
            if total >= n:
                h[n - 1 :] = mix(window_hash(flat, n, 0x9E3779B97F4A7C15) + np.uint64(n))
            self.hash[n] = h

    def has(self, n: int) -> np.ndarray:
        return self.place >= n - 1


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, how often each occurs, and the place among them of every one."""
    order = np.argsort(h)
    x = h[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return x[first], np.diff(np.append(first, len(x))), at


def _total(blobs: list[bytes]) -> list[bytes]:
    got = [unframe(b) for b in blobs]
    values = [unpack_u64(v) for v, _ in got]
    _, _, index = ranked(np.concatenate(values))
    counts = np.bincount(index, np.concatenate([_large(c) for _, c in got])).astype(np.int64)  # exact below 2**53
    out, at = [], 0
    for v in values:
        out.append(_small(counts[index[at : at + len(v)]]))
        at += len(v)
    return out


class Counts:
    """A block's n-grams and, round by round, how often other documents have them."""

    def __init__(self, block: Block, order: int, buckets: int):
        self.grams, self.buckets = Grams(block, order), buckets
        #: For each length and word: the count elsewhere of the n-gram that ends there.
        self.other: dict[int, np.ndarray] = {}

    def asked(self, lengths: list[int]) -> dict[int, np.ndarray]:
        """The places whose n-grams of these lengths may occur elsewhere."""
        out = {}
        for n in lengths:
            may = self.grams.has(n)
            if n - 1 in self.other:
                found = self.other[n - 1] > 0
                may[1:] &= found[1:] & found[:-1]
            out[n] = np.flatnonzero(may)
        return out

    def ranked(self, lengths: list[int]):
        places = self.asked(lengths)
        return places, *ranked(np.concatenate([self.grams.hash[k][at] for k, at in places.items()]))

    def messages(self, lengths: list[int]):
        _, values, n, _ = self.ranked(lengths)
        for b, x, y in split_by_bucket(values, self.buckets):
            yield b, frames(pack_u64(values[x:y]), _small(n[x:y]))

    def join(self, lengths: list[int], replies: dict[int, bytes]) -> None:
        """Totals of the corpus, less each document's own."""
        places, _, n, at = self.ranked(lengths)
        total = np.concatenate([np.zeros(0, np.int64), *(_large(replies[b]) for b in sorted(replies))])
        doc = np.concatenate([self.grams.doc[x] for x in places.values()])
        own = np.ones(len(at), np.int64)
        several = np.flatnonzero(n[at] > 1)  # only these can be more than one in a document
        _, count, which = ranked(at[several] * (len(self.grams.counts) + 1) + doc[several])
        own[several] = count[which]
        rest = total[at] - own
        begin = 0
        for k, has in places.items():
            self.other[k] = np.zeros(len(self.grams.place), np.int64)
            self.other[k][has] = rest[begin : begin + len(has)]
            begin += len(has)


def score(docs: DataFrame, scratch: Scratch, order: int = ORDER, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_backed_off, logprob_micro) of every document."""
    blocks, raw = to_blocks(docs, scratch, doc_id, text)
    post = Post(blocks, raw, BUCKET_BYTES)
    rounds = [[n for n in (1, 2) if n <= order], *([n] for n in range(3, order + 1))]

    def counted(block: Block, replies: dict[int, dict[int, bytes]], upto: int) -> Counts:
        c = Counts(block, order, post.buckets)
        for k in range(upto):
            c.join(rounds[k], replies.get(k, {}))
        return c

    # The number of words of the corpus: one sum.
    words = post.blocks.mapInArrow(_words, "n long")
    everything = words.agg(F.sum("n")).first()[0] or 0
    first = post.send(lambda block: Counts(block, order, post.buckets).messages(rounds[0]))
    answers = scratch.keep(post.answer(first, _total).withColumn("round", F.lit(0)), "round0")
    for k in range(1, len(rounds)):
        ask = post.receive(answers, lambda block, replies, k=k: post.table(block.block, counted(block, replies, k).messages(rounds[k])), MESSAGE, MESSAGE_ARROW)
        answers = answers.union(scratch.keep(post.answer(ask, _total).withColumn("round", F.lit(k)), f"round{k}"))

    def finish(block: Block, replies: dict[int, dict[int, bytes]]) -> pa.Table:
        c = counted(block, replies, len(rounds))
        g, other = c.grams, c.other
        context = np.minimum(g.place, order - 1)
        rest = np.maximum(everything - g.counts[g.doc], 1)
        s = alpha ** context.astype(float) * np.maximum(other[1], 1) / rest
        found = np.zeros(len(s), np.int64)
        for n in range(2, order + 1):
            seen = g.has(n) & (other[n] > 0)
            before = np.maximum(np.concatenate([[1], other[n - 1][:-1]]), 1)
            s = np.where(seen, alpha ** (context + 1.0 - n) * other[n] / before, s)
            found = np.where(seen, n - 1, found)
        micro = np.rint(np.log(s) * 1e6).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(g.counts)])
        add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
        return pa.table({"doc_id": block.id_column(), "n_words": g.counts, "n_backed_off": add(found < context), "logprob_micro": add(micro)})

    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("logprob_micro", pa.int64())])
    return post.receive(answers, finish, "doc_id long, n_words long, n_backed_off long, logprob_micro long", arrow)


def _words(batches):
    for t in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(x.split()) for b in Block.of(t) for x in b.texts())], pa.int64())], ["n"])


#: The same in SQL, for order 3 and alpha 0.4.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p, CASE WHEN i > 2 THEN ws[i - 2] END AS o
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))
), c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w),
d1 AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
c2 AS (SELECT p, w, count(*) AS n FROM w WHERE p IS NOT NULL GROUP BY p, w),
d2 AS (SELECT doc_id, p, w, count(*) AS n FROM w WHERE p IS NOT NULL GROUP BY doc_id, p, w),
c3 AS (SELECT o, p, w, count(*) AS n FROM w WHERE o IS NOT NULL GROUP BY o, p, w),
d3 AS (SELECT doc_id, o, p, w, count(*) AS n FROM w WHERE o IS NOT NULL GROUP BY doc_id, o, p, w),
t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (
  SELECT w.doc_id, CASE WHEN w.o IS NOT NULL THEN 2 WHEN w.p IS NOT NULL THEN 1 ELSE 0 END AS context, c1.n - d1.n AS u, greatest((SELECT count(*) FROM w) - t.n, 1) AS rest,
         coalesce(c2.n - d2.n, 0) AS b, q.n - e.n AS v, coalesce(c3.n - d3.n, 0) AS a, qq.n - ee.n AS y
  FROM w JOIN c1 ON c1.w = w.w JOIN d1 ON d1.doc_id = w.doc_id AND d1.w = w.w JOIN t ON t.doc_id = w.doc_id
  LEFT JOIN c2 ON c2.p = w.p AND c2.w = w.w LEFT JOIN d2 ON d2.doc_id = w.doc_id AND d2.p = w.p AND d2.w = w.w
  LEFT JOIN c1 q ON q.w = w.p LEFT JOIN d1 e ON e.doc_id = w.doc_id AND e.w = w.p
  LEFT JOIN c3 ON c3.o = w.o AND c3.p = w.p AND c3.w = w.w LEFT JOIN d3 ON d3.doc_id = w.doc_id AND d3.o = w.o AND d3.p = w.p AND d3.w = w.w
  LEFT JOIN c2 qq ON qq.p = w.o AND qq.w = w.p LEFT JOIN d2 ee ON ee.doc_id = w.doc_id AND ee.p = w.o AND ee.w = w.p
), m AS (
  SELECT doc_id, CASE WHEN a > 0 OR context = 0 OR context = 1 AND b > 0 THEN 0 ELSE 1 END AS backed,
         CAST(round_even(ln(CASE WHEN a > 0 THEN a / CAST(y AS DOUBLE)
              WHEN b > 0 THEN pow(CAST(0.4 AS DOUBLE), context - 1) * b / CAST(v AS DOUBLE)
              ELSE pow(CAST(0.4 AS DOUBLE), context) * greatest(u, 1) / CAST(rest AS DOUBLE) END) * 1e6, 0) AS BIGINT) AS micro
  FROM s
)
SELECT d.doc_id, CAST(count(m.doc_id) AS BIGINT) AS n_words, CAST(coalesce(sum(backed), 0) AS BIGINT) AS n_backed_off,
       CAST(coalesce(sum(micro), 0) AS BIGINT) AS logprob_micro
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
