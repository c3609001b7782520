"""Operators 1 and 5: against the tokenizers library; packing against bounds."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from phasegrid.llm import bpe, packing
from phasegrid.llm.common import Scratch
from phasegrid.llm.registry import vocabulary
from tests.llm.cases import empty, frame, ordered, rows_of, texts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoding_equals_the_library(library):
    rng = random.Random(1)
    odd = ["'s't 're I'LL don't", "a b c", "½²³ 12３", "\x85\x1c  x", "ǅʰͅ", "ᎠᎡ \U0001e900ꭰ", "á", "tab\t\tnew\n\n\n x", "   ", " \n \n", "x   y", "👩‍👩‍👧", "﻿bom"]
    odd += ["".join(rng.choice("ab \n\té漢'1.!<|>　") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for kind in ("merge", "ranked"):
        e = bpe.encoder(vocabulary(), kind)
        for text in [*odd, *(t or "" for _, t in texts())]:
            ids = e.ids(text)
            assert ids == ids_of(library, text), text
            assert e.decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_decode_of_broken_bytes(library):
    e = bpe.encoder(vocabulary())
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 12))]
        assert e.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_characters_called_settled_are_classed_alike(library):
    """The fast path's word rule and the library's agree on every character that it is used for."""
    e = bpe.encoder(vocabulary())
    for code in [*range(0x250), *range(0x391, 0x3CA), *range(0x410, 0x450), *range(0x2010, 0x2040), 0x20AC, *range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(0x4E00, 0x9FA6, 97)]:
        c = chr(code)
        if bpe.SETTLED.fullmatch(c):
            text = f"a{c}1{c}{c} .{c}"
            assert e.ids(text) == ids_of(library, text), hex(code)


def test_round_trip_table(spark, library):
    want = []
    for d, t in texts():
        ids = ids_of(library, t)
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(bpe.round_trip(frame(spark), vocabulary()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ordered(want)
    assert bpe.round_trip(empty(spark), vocabulary()).count() == 0
    encoded = bpe.encode(frame(spark), vocabulary())
    assert rows_of(bpe.decode(encoded, vocabulary()), "doc_id", "text") == ordered([(d, t or "") for d, t in texts()])


def test_pieces_and_packing(spark, library):
    rows = packing.pack_documents(frame(spark), vocabulary(), Scratch(spark), 256).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in texts():
        if d in (5, None):
            continue
        ids = ids_of(library, t) + np.array([2], "<u4").tobytes()
        n = len(ids) // 4
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == n
        assert all(r["length"] == 256 for r in own[1:])
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    counts = np.bincount([r["length"] for r in rows], minlength=257)
    assert packing.lower_bound(counts) <= len(sequences) <= packing.lower_bound(counts) + 1
    assert packing.pack_documents(empty(spark), vocabulary(), Scratch(spark)).count() == 0


def test_exchange_saves_bins(spark, monkeypatch):
    """Small partitions leave gaps; exchanging documents closes some of them, and none is lost."""
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 1023), rng.randint(1, 60)]) for _ in range(3000)]
    found = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    monkeypatch.setattr(packing, "GROUP", 200)
    packed = packing.pack(found, Scratch(spark))
    used = packed.select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "lower_bound", lambda counts: 10**9)  # the goal is met at once
    before = packing.pack(found, Scratch(spark)).select("sequence_id").distinct().count()
    alone = len(packing.best_fit(np.array(lengths), 1024)[2])
    assert used < before and used <= alone * 1.03 and packed.count() == 3000
    load = packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert load <= 1024


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(60):
        x = rng.integers(1, 65, rng.integers(1, 60))
        assert packing.lower_bound(np.bincount(x, minlength=65)) <= len(packing.best_fit(x, 64)[2])
    # Three items of just over a third fit two to a bin.
    assert packing.lower_bound(np.bincount([34] * 10, minlength=101)) == 5
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101)) == 10
