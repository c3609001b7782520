"""Operator 2: quality by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics (log counts, logits of
shares).  For each class a mean and a covariance are summed over all training
rows in one pass; the covariance is shrunk towards the pooled one and that
towards a multiple of the identity.  How far is decided by cross-validation in
the training rows: the sums are kept for each of four parts of them, and a
second pass adds up the log loss that each pair of shrinkages has on the part
that its sums left out; the least loss wins.  The score is the logistic of the difference
of log densities, with Mahalanobis distances from cached Cholesky factors.

Cases: null and empty texts have the statistics of no words and get a score
like any other; a null doc_id counts as the text '' in the split; label rows
with null quality are left out and repeated label rows count again; without any
training row of one class every score is the other class's share (0.5 if none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.llm.common import Scratch

MARKS = b"#$%&*|!<>{}[]=+~^_\\/@"
STOPS = b".,;:?!"
NAMES = [
    "log_words", "word_length", "letters", "capitals", "digits", "marks", "bars", "stops", "other_bytes",
    "distinct_words", "same_as_before", "top_word", "distinct_pairs", "distinct_lines", "line_length", "squeezed", "marked_words", "short_lines",
]
#: Shrinkages towards the pooled covariance, and of that towards the identity, to choose from, and parts of the training rows.
POOLED, ROUND, PARTS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95), (0.01, 0.05, 0.2), 4

_OTHERS = {k: bytes(b for b in range(256) if b not in v) for k, v in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": set(MARKS), "stop": set(STOPS), "high": range(128, 256), "bar": b"|",
}.items()}
_MARKED = re.compile(rb"[#$%&*|!]{2,}|\|")


def _logit(a: float, n: float) -> float:
    return float(np.log((a + 0.5) / (n - a + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The figures of one whole text, in the order of NAMES."""
    n = len(text)
    count = {k: len(text.translate(None, others)) for k, others in _OTHERS.items()}
    words = text.split()
    m = len(words)
    letters = count["upper"] + count["lower"] + count["high"]
    lines = [x for x in text.split(b"\n") if x.strip()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    squeezed = len(zlib.compress(text, 1)) if n else 0
    return [
        float(np.log1p(m)),
        float(np.log1p((n - text.count(b" ")) / max(m, 1))),
        _logit(letters, n),
        _logit(count["upper"], letters),
        _logit(count["digit"], n),
        _logit(count["mark"], n),
        _logit(count["bar"], n),
        _logit(count["stop"], n),
        _logit(count["high"], n),
        _logit(len(tally), m),
        _logit(same, max(m - 1, 0)),
        _logit(max(tally.values(), default=0), m),
        _logit(pairs, max(m - 1, 0)),
        _logit(len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))),
        _logit(min(squeezed, n + 16), n + 16),
        _logit(len(_MARKED.findall(text)), max(m, 1) * 3),
        _logit(sum(len(x) < 20 for x in lines), len(lines)),
    ]


VECTORS = "doc_id long, x array<double>"


def vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics((t.as_py() or "").encode()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, VECTORS)


def held_out(doc_id: str = "doc_id"):
    """The fold that labels are never read from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Discriminant:
    """Two Gaussians: log priors, means and Cholesky factors of the inverses."""

    def __init__(self, counts, sums, squares, pooled: float = 0.9, round_: float = 0.05):
        self.share = (counts[1] + 0.5) / (counts.sum() + 1)
        self.degenerate = min(counts) < 2
        if self.degenerate:
            return
        total, d = counts.sum(), len(sums[0])
        self.centre = sums.sum(0) / total
        second = squares.sum(0) / total - np.outer(self.centre, self.centre)
        self.scale = np.sqrt(np.maximum(np.diag(second), 1e-12))
        means, covs = [], []
        for c in (0, 1):
            m = sums[c] / counts[c]
            covs.append((squares[c] / counts[c] - np.outer(m, m)) / np.outer(self.scale, self.scale))
            means.append((m - self.centre) / self.scale)
        both = (counts[0] * covs[0] + counts[1] * covs[1]) / total
        self.means, self.factors, self.logdet = means, [], []
        for c in (0, 1):
            s = (1 - pooled) * covs[c] + pooled * both
            s = (1 - round_) * s + round_ * max(np.trace(s) / d, 1e-6) * np.eye(d)
            low = np.linalg.cholesky(s)
            self.factors.append(np.linalg.inv(low))
            self.logdet.append(2 * np.log(np.diag(low)).sum())
        self.prior = np.log(self.share) - np.log(1 - self.share)

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row."""
        if self.degenerate:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [-0.5 * ((((z - m) @ f.T) ** 2).sum(1) + g) for m, f, g in zip(self.means, self.factors, self.logdet, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -60, 60)))


def part_of(doc_id: str = "doc_id"):
    """A training row's part; its rows are in all three remainders by three, so the division is by three first."""
    return F.floor(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) / 3) % PARTS


def sums(rows: DataFrame) -> np.ndarray:
    """For each part and class of all rows (x, y 0/1, part): count, sums, and sums of products."""
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, 2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            y, part = b.column(1).to_numpy(), b.column(2).to_numpy()
            for p in range(PARTS):
                for c in (0, 1):
                    own = x[(y == c) & (part == p)]
                    total[p, c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * PARTS), pa.int32()), pa.array(total.reshape(2 * PARTS, -1).tolist(), pa.list_(pa.float64()))], ["k", "sums"])

    parts = rows.select("x", F.col("y").cast("int"), F.col("part").cast("int")).mapInArrow(run, "k int, sums array<double>")
    total = np.zeros((2 * PARTS, 1 + d + d * d))
    for k, i, v in parts.select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v")).collect():  # 2 PARTS (1 + d + d*d) rows
        total[k, i] = v
    return total.reshape(PARTS, 2, -1)


def model(total: np.ndarray, pooled: float, round_: float) -> Discriminant:
    d = len(NAMES)
    return Discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), pooled, round_)


def losses(rows: DataFrame, total: np.ndarray) -> dict[tuple[float, float], float]:
    """The log loss of each pair of shrinkages, every row scored by the sums of the other parts."""
    grid = [(p, r) for p in POOLED for r in ROUND]
    models = [[model(total.sum(0) - total[k], p, r) for p, r in grid] for k in range(PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(grid))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(-1, len(NAMES))
            y, part = b.column(1).to_numpy(), b.column(2).to_numpy()
            for k in range(PARTS):
                own = part == k
                if own.any():
                    out -= [np.log(np.maximum(np.where(y[own] == 1, s, 1 - s), 1e-9)).sum() for s in (m.score(x[own]) for m in models[k])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(out)], ["g", "loss"])

    found = rows.select("x", F.col("y").cast("int"), F.col("part").cast("int")).mapInArrow(run, "g int, loss double")
    return {grid[g]: loss for g, loss in found.groupBy("g").agg(F.sum("loss")).collect()}  # a row for each pair


def fit(rows: DataFrame) -> Discriminant:
    """From all rows of (x, y, part): the shrinkages of least loss, ties to the larger."""
    total = sums(rows)
    loss = losses(rows, total)
    best = min(loss, key=lambda g: (round(loss[g], 6), -g[0], -g[1])) if loss else (POOLED[-1], ROUND[-1])
    return model(total.sum(0), *best)


def score(found: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double")


def train(found: DataFrame, labels: DataFrame) -> Discriminant:
    """From vectors and the labels outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    return fit(found.where(~held_out()).join(known, "doc_id").select("x", "y", part_of().alias("part")))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = scratch.keep(vectors(docs, doc_id, text), "vectors")
    model = train(found, labels)
    return score(found, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score 0.5 or more, all columns unchanged.

    Statistics are counted once and written beside the rows, whose columns go
    by number meanwhile, so no name can clash.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    at = docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics((str(v) if (v := t.as_py()) is not None else "").encode()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    schema = T.StructType([*rows.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = scratch.keep(rows.mapInArrow(count, schema), "counted")
    best = train(found.select(F.col(names[docs.columns.index(doc_id)]).cast("long").alias("doc_id"), "x"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(len(names)).flatten().to_numpy().reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(best.score(x) >= 0.5)).columns[: len(names)], names)

    kept = found.mapInArrow(run, rows.schema)
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
