"""Operators 3, 4, 6, 7, 10: against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from phasegrid.llm import embeddings, lines, simhash, substrings, suffixes
from phasegrid.llm.common import Post, Scratch, components, to_blocks
from tests.llm.cases import empty, frame, ordered, prose, rows_of, texts


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 400) if i % 50] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(700)] + [(7, 7)] + [(5000, 5000 + i) for i in range(1, 300)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = dict(tuple(r) for r in components(df, Scratch(spark)).collect())
    assert got == {x: u.find(x) for x in list(u.up) if u.find(x) != x}
    assert components(df.where("false"), Scratch(spark)).count() == 0


# ---------------------------------------------------------------- 3


def removed_bytes(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        d = -(2**63) if d is None else d
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < (-(2**63) if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return ordered(out)


def test_suffix_arrays(spark):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffixes.digest(frame(spark), Scratch(spark)), *cols) == removed_bytes(texts())
    assert suffixes.digest(empty(spark), Scratch(spark)).count() == 0
    spans = suffixes.removed_spans(frame(spark), Scratch(spark))
    assert sum(r["stop"] - r["start"] for r in spans.collect()) == sum(r[2] for r in removed_bytes(texts()))


@pytest.mark.parametrize("limit", [80, 500])
def test_anchors_too_large_for_one_array_are_merged(limit):
    rng = random.Random(4)
    base = prose(rng, 60).encode()
    pieces = sorted({base[a : a + rng.randint(50, 90)] for a in (rng.randrange(0, len(base) - 120) for _ in range(60))})
    least = np.array([rng.randrange(50) for _ in pieces])
    want = {}
    for p, d in zip(pieces, least.tolist(), strict=True):
        for i in range(len(p) - 49):
            want[p[i : i + 50]] = min(want.get(p[i : i + 50], d), d)
    got = suffixes.solve_shard(np.zeros(len(pieces), np.uint64), pieces, least, limit)
    assert [g.tolist() for g in got] == [[want[p[i : i + 50]] for i in range(len(p) - 49)] for p in pieces]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        t = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 90))).astype(np.uint8)
        b = t.tobytes()
        sa = suffixes.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for j, n in enumerate(suffixes.common_prefixes(t, sa).tolist()):
            x, y = (b[sa[j - 1] :], b[sa[j] :]) if j else (b"", b"")
            assert n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


# ---------------------------------------------------------------- 4


def plain_shingles(x):
    """Seven characters each; a shorter line is its own only shingle."""
    return {x[i : i + 7] for i in range(max(1, len(x) - 6))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_groups_are_verified_whole():
    """Every similar pair of a group is connected, and no other, also just at the threshold and in wide characters."""
    rng = random.Random(3)
    found = 0
    for turn in range(12):
        letters = "abcdefghij" if turn % 2 else "abc日本ßéü🙂"
        names = []
        for _ in range(6):
            x = "".join(rng.choice(letters) for _ in range(rng.randint(8, 200)))
            for _ in range(rng.randint(1, 8)):
                y = list(x)
                for _ in range(rng.randint(0, 1 + len(y) // 60)):
                    y[rng.randrange(len(y))] = rng.choice(letters)
                names.append("".join(y))
        names = list(dict.fromkeys(names))
        sets = [plain_shingles(x) for x in names]
        u, v = Union(), Union()
        for i in range(len(names)):
            for j in range(i):
                if alike(sets[i], sets[j]):
                    u.join(i, j)
                    found += 1
        n = len(names)
        group = pa.table({"key": pa.array([7] * n + [8] * n, pa.int64()), "pair": pa.array([0] * 2 * n, pa.int64()), "line": pa.array([*range(n)] * 2, pa.int64()), "text": pa.array([x.encode() for x in names] * 2, pa.binary())})
        for out in lines._verify(iter(group.to_batches())):
            for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
                v.join(a, b)
        assert [u.find(i) for i in range(n)] == [v.find(i) for i in range(n)]
    assert found > 100


def test_groups_of_two_are_verified():
    """Just above and below the threshold; lines that are connected already give no edge again."""
    rng = random.Random(12)
    rows, want = [], Union()
    for k in range(300):
        x = "".join(rng.choice("abcdefgh日") for _ in range(rng.randint(8, 90)))
        at = rng.randrange(len(x))
        y = rng.choice([x + "y" * rng.randint(1, 9), x[:at] + "y" + x[at + 1 :]])
        rows += [(k, 2 * k, x), (k, 2 * k + 1, y), (1000 + k, 2 * k, x), (1000 + k, 2 * k + 1, y)]
        if alike(plain_shingles(x), plain_shingles(y)):
            want.join(2 * k, 2 * k + 1)
    group = pa.table({"key": [r[0] for r in rows], "pair": [0] * len(rows), "line": [r[1] for r in rows], "text": pa.array([r[2].encode() for r in rows], pa.binary())})
    got = [tuple(e) for out in lines._verify(iter(group.to_batches())) for e in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert got == [(2 * k, 2 * k + 1) for k in range(300) if want.find(2 * k) == want.find(2 * k + 1)]
    assert 50 < len(got) < 250


def test_numbers_stand_for_values():
    """Also for values that all fall on one place of the first table."""
    rng = np.random.default_rng(2)
    back = pow(0x9E3779B97F4A7C15, -1, 2**64)
    crowded = np.array([k * back % 2**64 for k in range(500)], np.uint64)
    for values in (rng.integers(0, 2**64, 5000, np.uint64), np.repeat(crowded, 3), rng.integers(0, 50, 4000).astype(np.uint64), np.zeros(1000, np.uint64), np.zeros(0, np.uint64)):
        values = rng.permutation(values)
        number, n = lines.numbered(values)
        pairs = set(zip(values.tolist(), number.tolist(), strict=True))
        assert len(pairs) == len(np.unique(values)) == len(np.unique(number))
        assert all(0 <= k < n for _, k in pairs)


def test_lines_are_signed_and_numbered_once(spark, tmp_path):
    """One signature for each block and line; a cluster's lines are numbered in two tasks at most, not in one for each group."""
    log = str(tmp_path / "log")

    class Logged(lines.Lines):
        def signatures(self, at):
            with open(log, "a") as f:
                f.write(f"signed {len(at)}\n")
            return super().signatures(at)

        @staticmethod
        def shingles(own):
            with open(log, "a") as f:
                f.write(f"numbered {len(own)}\n")
            return lines.shingles(own)

    rng = random.Random(9)
    rows = []
    for i in range(40):
        w = prose(rng, 60, 60).split(" ")
        for k in range(3):
            own = list(w)
            own[5 + 20 * k] = f"other{i}"
            rows.append((3 * i + k, " ".join(own)))
    scratch = Scratch(spark)
    blocks, raw = to_blocks(frame(spark, rows), scratch)
    _, root = lines.line_components(Post(blocks, raw, lines.BUCKET_BYTES), scratch, Logged)
    assert Counter(Counter(r["root"] for r in root.collect()).values()) == {2: 40}
    total = Counter()
    for what, n in (x.split() for x in open(log).read().splitlines()):
        total[what] += int(n)
    assert total["signed"] == 120
    assert total["numbered"] <= 5 * 40


def kept_lines(rows):
    order = sorted(((-(2**63) if d is None else d), k, p, x) for k, (d, t) in enumerate(rows) for p, x in enumerate((t or "").split("\n") if t is not None else []))
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    names = list(dict.fromkeys(bare(x) for *_, x in order if len(bare(x)) >= lines.MIN_CHARS))
    sets = {x: plain_shingles(x) for x in names}
    u = Union()
    for i, a in enumerate(names):
        for b in names[:i]:
            if alike(sets[a], sets[b]):
                u.join(a, b)
    seen, gone = set(), set()
    for _, k, p, x in order:
        if bare(x) in sets:
            root = u.find(bare(x))
            if root in seen:
                gone.add((k, p))
            seen.add(root)
    out = []
    for k, (d, t) in enumerate(rows):
        own = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(own) if (k, p) not in gone]
        out.append((d, len(own), len(own) - len(kept), sha("\n".join(kept).encode())))
    return ordered(out)


def similar_rows():
    """Near copies of lines far above the threshold, which banding meets surely."""
    rng = random.Random(6)
    base = [prose(rng, 40, 40) for _ in range(40)]
    rows = [(i, x) for i, x in enumerate(base)]
    for i, x in enumerate(base[:20]):
        w = x.split(" ")
        w[rng.randrange(len(w))] += "x"
        rows.append((50 + i, " ".join(w) + "\nshort line\n\n" + base[i + 20]))
    return rows + [(300, None), (301, ""), (302, "\n\n"), (None, base[0])]


def test_lines(spark):
    cols = ("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(lines.digest(frame(spark, similar_rows()), Scratch(spark)), *cols) == kept_lines(similar_rows())
    unique = [r for r in texts() if r[0] not in (5, None)]
    assert rows_of(lines.digest(frame(spark, unique), Scratch(spark)), *cols) == kept_lines(unique)
    assert lines.digest(empty(spark), Scratch(spark)).count() == 0
    kept = lines.clean(frame(spark, similar_rows()), Scratch(spark))
    assert kept.columns == frame(spark).columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept.collect())


def test_lines_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(lines, "TILE", 3)
    rng = random.Random(8)
    base = prose(rng, 60, 60).split(" ")
    rows = []
    for i in range(20):
        w = list(base)
        w[i * 3] = f"other{i}"
        rows.append((i, " ".join(w)))
    out = {r["doc_id"]: r["n_removed"] for r in lines.digest(frame(spark, rows), Scratch(spark)).collect()}
    assert out == {i: int(i > 0) for i in range(20)}


def test_short_lines_take_part(spark):
    """Exact copies of any length go; similar ones of a few shingles too."""
    rng = random.Random(7)
    rows = [(i, "Menu\n" + prose(rng, 30, 30) + "\n\nRead more here\n}\n" + f"{i:02d} alone") for i in range(30)]
    rows += [(50, "Menu \nRead more here!\nSome other words"), (51, "日本\n日本語日本語日本語日本語\n日本"), (52, "日本語日本語日本語日本語")]
    cols = ("doc_id", "n_lines", "n_removed", "kept_sha256")
    got = rows_of(lines.digest(frame(spark, rows), Scratch(spark)), *cols)
    assert got == kept_lines(rows)
    removed = {r[0]: r[2] for r in got}
    assert removed == {0: 0} | {i: 3 for i in range(1, 30)} | {50: 2, 51: 1, 52: 1}


# ---------------------------------------------------------------- 6


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    near = base[:30] + rng.normal(size=(30, 16)) * 0.25
    cluster = base[0] + rng.normal(size=(80, 16)) * 0.2
    x = np.concatenate([base, near, cluster, base[:5], 2 * base[5:8]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    d = x.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    link = cos >= 0.9
    u = Union()
    for i, j in zip(*np.nonzero(link), strict=True):
        u.join(int(i), int(j))
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.near_duplicates(df, Scratch(spark)).collect()}
    want = {i: (int(link[i].sum()) - 1, u.find(i), u.find(i) == i) for i in range(len(x))}
    found = sum(got[i][0] for i in want)
    assert found >= 0.9 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905)) and got[906] == (1, 906, True) and got[907] == (1, 906, False)
    assert got[None] == (0, None, None)
    assert embeddings.near_duplicates(df.where("false"), Scratch(spark)).count() == 0


def test_embedding_tiles_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    x = np.random.default_rng(1).normal(size=8) + np.random.default_rng(2).normal(size=(120, 8)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, Scratch(spark)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 0)}


def test_embedding_recall_at_the_threshold(spark):
    """Pairs at cosine 0.9 to 0.92 among many vectors, in a table with clashing column names; links, never too many."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(2500, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.9005, 0.92, 2500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side])
    rows = [(i, v.tolist(), "k", 1, b"v", 2.0, True) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, rep int, v binary, copies double, pair boolean")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, Scratch(spark)).collect()}
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (cos >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * link.sum() >= 0.98 * 5000


def test_hyperplanes_follow_the_number_of_vectors():
    assert [embeddings.plan(n).bits for n in (1, 10_000, 10**6, 10**9, 10**10)] == [2, 7, 14, 24, 27]
    p = embeddings.plan(10**6)
    assert (1 - (1 - (1 - math.acos(0.9) / math.pi) ** p.bits) ** p.tables) >= 0.99 and 0.14 * p.bits * p.tables < p.apart < 0.25 * p.bits * p.tables


# ---------------------------------------------------------------- 7


def removed_words(rows, keep="none"):
    split = [(t or "").encode().split() for _, t in rows]
    places = {}
    for k, w in enumerate(split):
        for i in range(len(w) - 34):
            places.setdefault(tuple(w[i : i + 35]), []).append((-(2**63) if rows[k][0] is None else rows[k][0], k, i))
    out = []
    for k, (d, _) in enumerate(rows):
        w, gone = split[k], bytearray(len(split[k]))
        for i in range(len(w) - 34):
            at = places[tuple(w[i : i + 35])]
            if len(at) > 1 and (keep == "none" or min(at)[1:] != (k, i)):
                gone[i : i + 35] = b"\1" * 35
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return ordered(out)


def test_passages(spark):
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(substrings.digest(frame(spark), Scratch(spark)), *cols) == removed_words(texts())
    assert substrings.digest(empty(spark), Scratch(spark)).count() == 0


def test_extension_compares_words():
    """All contexts of one anchor number, some with other words: every window against every other."""
    rng = random.Random(2)
    for _ in range(30):
        base = [rng.choice(["a", "b"]) for _ in range(20)]
        texts_, offsets = [], []
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(20)] = rng.choice(["a", "b", "c"])
            cut, end = rng.randint(4, 8), rng.randint(11, 15)
            texts_.append(" ".join(w[cut:end]).encode())
            offsets.append(8 - cut)  # the anchor is words 8 to 10, windows have 7
        places, least = [rng.randint(1, 2) if rng.random() < 0.2 else 1 for _ in texts_], [rng.randint(0, 5) for _ in texts_]
        twice, first = substrings.extend(np.full(len(texts_), 7, np.uint64), np.array(offsets), np.array(places), np.array(least), texts_, 3, 7)
        seen = {}
        for k, t in enumerate(texts_):
            w = t.split()
            for left in range(5):
                j = offsets[k] - left
                if j >= 0 and j + 7 <= len(w):
                    seen.setdefault((left, tuple(w[j : j + 7])), []).append((least[k], k, j))
        want = np.zeros_like(twice)
        for at in seen.values():
            for _, k, j in at:
                want[k, j] = sum(places[q] for _, q, _ in at) > 1
                assert first[k, j] == min(at)[1]
        assert (twice == want).all()


def test_first_passage_stays(spark):
    rows = [r for r in texts() if r[0] not in (5, None)]
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    got = substrings.repeated_words(frame(spark, rows), Scratch(spark), substrings._digest, substrings.DIGEST, substrings.DIGEST_ARROW, "first")
    assert rows_of(got, *cols) == removed_words(rows, "first")
    kept = substrings.clean(frame(spark), Scratch(spark))
    assert kept.columns == frame(spark).columns and all(r["n_chars"] == len(r["text"] or "") for r in kept.collect())


def test_relays_change_nothing(spark, monkeypatch):
    """Buckets in columns: the same rows as with a message to each bucket."""
    from phasegrid.llm import common

    monkeypatch.setattr(common, "FAN", 3)
    monkeypatch.setattr(common, "SERVED", 2)
    for name, part in ((substrings, "BUCKET_BYTES"), (suffixes, "SHARD_TEXT"), (lines, "BUCKET_BYTES")):
        monkeypatch.setattr(name, part, 2_000)
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(substrings.digest(frame(spark), Scratch(spark)), *cols) == removed_words(texts())
    assert rows_of(suffixes.digest(frame(spark), Scratch(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_bytes(texts())
    cols = ("doc_id", "n_lines", "n_removed", "kept_sha256")
    assert rows_of(lines.digest(frame(spark, similar_rows()), Scratch(spark)), *cols) == kept_lines(similar_rows())


# ---------------------------------------------------------------- 10


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = [r for r in texts() if r[0] is not None]
    prints = {d: plain_fingerprint(t) for d, t in rows}
    u = Union()
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                u.join(a, b)
    got = simhash.near_duplicates(frame(spark), Scratch(spark))
    want = [(d, format(plain_fingerprint(t), "016x"), u.find(d) if d is not None else None) for d, t in texts()]
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == ordered(want)
    assert simhash.near_duplicates(empty(spark), Scratch(spark)).count() == 0
    kept = simhash.keep_one(frame(spark), Scratch(spark), words=3)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({u.find(d): 1 for d in prints}) + Counter({None: 2}) and kept.columns == frame(spark).columns


def test_simhash_broadcasts_no_table(spark):
    """Tables that grow with the input meet by shuffles, however few bytes they have on disk."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    rows = [(i, f"a {i} b c d {i // 3} e") for i in range(300)]
    assert simhash.near_duplicates(frame(spark, rows), Scratch(spark)).collect()
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(7)
    assert components(chain, Scratch(spark)).count() == 200
    bus.waitUntilEmpty(30_000)
    done = store.executionsList(before, 10_000)
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize(("distance", "segments", "hot"), [(2, 2, 256), (2, 2, 2), (2, 2, 0), (2, 3, 1), (3, 2, 3), (4, 4, 256)])
def test_links_are_complete(spark, distance, segments, hot):
    """Against all pairs, with values of a segment that few, many or all count as crowded."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for j in rng.sample(range(64), rng.randint(1, distance + 2)):
                y ^= 1 << j
            prints.add(y)
    prints |= {base[0] ^ (1 << j) for j in range(0, 64, 3)} | {0, 2**64 - 1, 2**63}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")
    u, v = Union(), Union()
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= distance:
                u.join(i, j)
    for r in simhash.near_links(table, Scratch(spark), distance, segments, hot).collect():
        assert (prints[r["a"]] ^ prints[r["b"]]).bit_count() <= distance
        v.join(r["a"], r["b"])
    assert [u.find(i) for i in range(len(prints))] == [v.find(i) for i in range(len(prints))]


def test_the_index_is_by_segment(spark):
    """A table row for each segment, and a ball's values for each look-up."""
    table = spark.createDataFrame([(1, 5)], "rep long, fp long")
    assert sorted(tuple(r)[:2] for r in simhash.segment_rows(table, 2, 0).collect()) == [(0, 5), (1, 0)]
    near = [tuple(r)[:2] for r in simhash.segment_rows(table, 2, 1).collect()]
    assert len(set(near)) == 66 and all((v ^ (0 if s else 5)).bit_count() <= 1 and 0 <= v < 2**32 for s, v in near)


# ---------------------------------------------------------------- near copies in the pipeline


def word_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_wide_fingerprints_reach_the_similarity():
    """SimHash by plain counting, its segments, and pairs at 0.8 that agree in some segment and in most of a part."""
    from phasegrid.llm import copies

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 64, 101):
        h = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
        want = [sum(1 << j for j in range(64) if 2 * sum(int(x) >> j & 1 for x in h[:, k]) > n) for k in (0, 1)]
        assert simhash.majority(h).tolist() == want
    wide = simhash.wide_fingerprint(rng.integers(0, 2**64, 9, dtype=np.uint64), 3)
    bits = "".join(format(x, "064b")[::-1] for x in wide.tolist())
    assert [(v >> 38, v & (1 << 32) - 1) for v in simhash.segment_values(wide[None], 7, 26)[0].tolist()] == [(int(bits[k * 26 : k * 26 + 26], 2), k) for k in range(7)]
    met = near = 0
    for k in range(200):
        n = (5, 20, 40, 110)[k % 4]
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = a[: n * 4 // 5]
        segments = copies.MORE if n < copies.SHORT else copies.SEGMENTS
        x = np.array([simhash.wide_fingerprint(s, -(-segments * copies.WIDTH // 64)) for s in (a, b)])
        u, v = simhash.segment_values(x, segments, copies.WIDTH)
        met += bool((u == v).any())
        near += int(np.bitwise_count(x[0, : copies.PART] ^ x[1, : copies.PART]).sum()) <= copies.DISTANCE
    assert met >= 195 and near == 200


def test_near_copies_of_short_lines_go(spark):
    """Copies with changed words at similarity 0.8 or more, as short lines; others under 0.8 stay."""
    from corpus_pipeline import drop_near_copies

    rng = random.Random(12)
    rows = []
    for i in range(60):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        rows.append((i, "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4))))
        for j, changes in ((100, 1), (200, len(w) // 60 + 1), (300, len(w) // 12)):
            x = list(w)
            for k in rng.sample(range(len(x)), changes):
                x[k] = f"new{rng.randrange(10**6)}"
            rows.append((j + i, "\n".join(" ".join(x[k : k + 4]) for k in range(0, len(x), 4))))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One two"), (None, rows[0][1]), (None, rows[0][1])]
    sets = {d: word_set(t) for d, t in rows if d is not None}
    u, pairs = Union(), 0
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                u.join(a, b)
                pairs += 1
    assert pairs > 60
    kept = drop_near_copies(spark, frame(spark, rows), "")
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({u.find(d): 1 for d in sets}) + Counter({None: 2})
