"""Operators 2, 8, 9, the registered queries and the pipeline."""

import hashlib
import random
from collections import Counter
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from phasegrid.llm import backoff, media, quality, registry
from phasegrid.llm.common import Scratch
from tests.llm.cases import empty, frame, ordered, prose, rows_of, texts

# ---------------------------------------------------------------- 2


def labelled(spark, n=300):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, rng.randint(20, 90)) if good else ("spam!!! " if rng.random() < 0.5 else "x | y | ") * rng.randint(10, 60)))
        labels.append((i, int(good)))
    labels += [(3, None), (None, 1), (99999, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_learns_and_holds_out(spark):
    rows, labels = labelled(spark)
    odd = [(1000, None), (1001, ""), (None, "text"), (1002, "x" * 100_000)]
    got = quality.classify(frame(spark, rows + odd), labels, Scratch(spark)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 30
    assert quality.classify(empty(spark), labels, Scratch(spark)).count() == 0
    # Labels of the held-out fold change nothing.
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = quality.classify(frame(spark, rows), flipped, Scratch(spark))
    assert rows_of(again.where("doc_id < 300"), "doc_id", "predicted") == ordered([(r["doc_id"], r["predicted"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 300])


def test_quality_without_one_class(spark):
    rows, labels = labelled(spark, 30)
    got = quality.classify(frame(spark, rows), labels.where("quality = 1"), Scratch(spark)).collect()
    assert len({r["score"] for r in got}) == 1


def test_shrinkage_follows_the_data(spark):
    """Classes of one mean and different covariances need the quadratic part; with equal ones pooling is better."""
    rng = np.random.default_rng(1)
    d, n = len(quality.NAMES), 3000
    y = (rng.random(n) < 0.5).astype(int)
    apart = rng.normal(size=(n, d)) * np.where(y[:, None] == 1, np.linspace(0.5, 3, d), np.linspace(3, 0.5, d))
    alike = rng.normal(size=(n, d)) + 0.3 * y[:, None]
    found = {}
    for name, x in (("apart", apart), ("alike", alike)):
        rows = spark.createDataFrame([(v.tolist(), int(c), k % quality.PARTS) for k, (v, c) in enumerate(zip(x, y, strict=True))], "x array<double>, y int, part int")
        total = quality.sums(rows)
        assert total[:, :, 0].sum() == n
        loss = quality.losses(rows, total)
        found[name] = min(loss, key=loss.get)[0]
        right = ((quality.fit(rows).score(x) >= 0.5) == y).mean()
        linear = ((quality.model(total.sum(0), 1.0, 0.05).score(x) >= 0.5) == y).mean()
        assert right > 0.95 > 0.6 > linear if name == "apart" else abs(right - linear) < 0.02
    assert found["apart"] <= 0.25 and found["alike"] >= 0.75


def test_accepted_rows_are_those_predicted(spark):
    """Every row with its own columns, whatever their names; repeats and nulls like any other."""
    rows, labels = labelled(spark)
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = frame(spark, rows)
    want = Counter(r["doc_id"] for r in quality.classify(docs, labels, Scratch(spark)).where("predicted = 1").collect())
    kept = quality.accept(docs, labels, Scratch(spark))
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == want and 100 < sum(want.values()) < 300
    texts_ = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert all((r["doc_id"], r["text"]) in texts_ and r["block"] == "clash" for r in kept.collect())
    assert quality.accept(empty(spark), labels, Scratch(spark)).count() == 0


def test_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = rng.normal(size=(500, d)) @ rng.normal(size=(d, d))
    y = (rng.random(500) < 0.4).astype(int)
    x[y == 1] += 1.0
    own = [x[y == c] for c in (0, 1)]
    m = quality.Discriminant(np.array([len(o) for o in own], float), np.array([o.sum(0) for o in own]), np.array([o.T @ o for o in own]), 0.2, 0.1)
    z = (x - x.mean(0)) / x.std(0)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    both = sum(len(o) * c for o, c in zip(own, covs, strict=True)) / 500
    logs = []
    for c in (0, 1):
        s = 0.8 * covs[c] + 0.2 * both
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        e = z - z[y == c].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) + np.linalg.slogdet(s)[1]))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(m.share / (1 - m.share)), -60, 60)))
    assert np.allclose(m.score(x), want)


# ---------------------------------------------------------------- 8


def test_store_and_read(spark):
    cols = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    want = []
    for d, t in texts():
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        f = media.mux(p)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(f), hashlib.sha256(f).hexdigest()))
    assert rows_of(media.store_and_read(frame(spark)), *cols) == ordered(want)
    assert media.store_and_read(empty(spark)).count() == 0


def test_peak_is_of_the_whole_payload():
    """A text whose tail, behind 4096 bytes, holds the strongest frequency."""
    start, tail = b"ab" * 2048, b"aaaa~~~~" * 2048
    for payload, peak in ((start, 2048), (start + tail, (4096 + 16384) // 8)):
        assert media.features(payload, media.parse(media.mux(payload))).endswith(f";peak={peak}")


def lacings(frames):
    """Each lacing of the same frames."""
    n = bytes([len(frames) - 1])
    xiph = n + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)
    flag, data = media.lace(frames)
    return {1: xiph, flag >> 1: data}


def test_lacings_groups_and_unknown_sizes():
    frames = [bytes([k]) * n for k, n in enumerate((300, 5, 255, 70, 1))]
    for lacing, data in lacings(frames).items():
        ranges = media.frame_ranges(b"??" + data, 2, 2 + len(data), lacing)
        assert [(b"??" + data)[a : a + n] for a, n in ranges] == frames
    same = [b"ab", b"cd", b"ef"]
    assert media.lace(same)[0] == 4
    block = b"\x81" + struct.pack(">hB", 5, 0) + b"payload"
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block), media.uint(media.BLOCK_DURATION, 3))
    open_cluster = media.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + media.uint(media.CLUSTER_TIME, 100) + group
    head = media.element(media.EBML, media.element(media.DOC_TYPE, b"webm"))
    file = head + media.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + open_cluster + open_cluster
    m = media.parse(file)
    assert m.error is None and [p.timestamp_ns for p in m.packets] == [105_000_000] * 2 and [p.cluster for p in m.packets] == [0, 1]
    assert all(file[p.start : p.start + p.size] == b"payload" for p in m.packets)


def test_vints():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**40):
        b = media.vint(n)
        assert media.read_vint(b, 0, False) == (n, len(b), False)


def test_damaged_files_give_rows(spark):
    good = media.mux(bytes(range(256)) * 200)
    rng = random.Random(7)
    for _ in range(300):
        b = bytearray(good[: rng.randrange(len(good))] if rng.random() < 0.5 else good)
        for _ in range(rng.randrange(4)):
            if b:
                b[rng.randrange(len(b))] = rng.randrange(256)
        media.parse(bytes(b))
    cut = media.parse(good[: len(good) // 2])
    assert cut.error and cut.packets == media.parse(good).packets[: len(cut.packets)]
    table = pa.table({"id": pa.array([1, 2, 3, 4], pa.int64()), "content": pa.array([good, None, b"", b"RIFF"], pa.binary())})
    rows = media.packets(spark.createDataFrame(table)).collect()
    assert {r["id"] for r in rows if r["error"]} == {2, 3, 4}
    own = [r for r in rows if r["id"] == 1]
    assert sum(r["size"] for r in own) == 51200 and all(r["codec"] == "A_PCM/INT/LIT" for r in own)
    assert [r["timestamp_ns"] for r in own] == [k * 64_000_000 for k in range(100)] and sum(r["cue"] for r in own) == 2


# ---------------------------------------------------------------- 9


def scores(rows, order, alpha):
    from collections import Counter
    from math import log

    docs = [(t or "").encode().split() for _, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    own = [grams(w) for w in docs]
    every, total = sum(own, Counter()), sum(map(len, docs))
    out = []
    for (d, _), w, mine in zip(rows, docs, own, strict=True):
        rest = lambda g: every[g] - mine[g]  # noqa: E731,B023
        micro = backed = 0
        for i in range(len(w)):
            m = min(i, order - 1)
            for k in range(m + 1, 1, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if rest(g) > 0:
                    s, hit = alpha ** (m + 1 - k) * rest(g) / rest(g[:-1]), k
                    break
            else:
                s, hit = alpha**m * max(rest((w[i],)), 1) / max(total - len(w), 1), 1
            micro += round(log(s) * 1e6)
            backed += hit <= m
        out.append((d, len(w), backed, micro))
    return ordered(out)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff(spark, order):
    got = backoff.score(frame(spark), Scratch(spark), order)
    assert rows_of(got, "doc_id", "n_words", "n_backed_off", "logprob_micro") == scores(texts(), order, 0.4)
    assert backoff.score(empty(spark), Scratch(spark), order).count() == 0


def test_backoff_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = registry.QUERIES["op9_stupid_backoff"](spark, sf_dir)
    cols = ("doc_id", "n_words", "n_backed_off", "logprob_micro")
    assert rows_of(got, *cols) == ordered(con.execute(f"SELECT {', '.join(cols)} FROM ({backoff.ORACLE}) AS t").fetchall())


# ---------------------------------------------------------------- all


def test_every_query_runs_over_its_whole_table(spark, sf_dir):
    assert sorted(q.split("_")[0] for q in registry.QUERIES) == sorted(f"op{n}" for n in range(1, 11))
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, query in registry.QUERIES.items():
        rows = query(spark, sf_dir)
        key = "vec_id" if name.startswith("op6") else "doc_id"
        want = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() if key == "vec_id" else n
        assert rows.select(key).distinct().count() == want, name


def test_pipeline(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns and out.dtypes == docs.dtypes, name
            assert 0.4 * before < out.count() <= docs.count(), name
            assert out.where("n_chars <> char_length(text)").count() == 0, name
            docs = out
    assert out.agg({"offset": "min"}).first()[0] == 0 and out.select("doc_id").distinct().count() == docs.count()
    assert pipeline.run(spark, sf_dir).count() == out.count()


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame(spark), sf_dir).count() > 0
        assert stage(spark, empty(spark), sf_dir).count() == 0
