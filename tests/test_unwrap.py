"""The public API on analytic rasters."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import phasegrid as P
from phasegrid.operators import bridge as B
from phasegrid.operators import components, grid, seams, tiles
from phasegrid.options import UnwrapOptions, auto_tiles
from phasegrid.sources import from_arrays, from_blocks, read_flat, register_flat, to_arrays, to_blocks, write_raster

TWO_PI = 2 * np.pi


def ramp(nrow, ncol, a, b):
    r, c = np.indices((nrow, ncol))
    return a * r + b * c


def as_df(spark, unw, mask=None, **more):
    mask = np.ones(unw.shape, bool) if mask is None else mask
    return from_arrays(spark, unw=unw.astype(float), mask=mask, **more)


@pytest.fixture(scope="module")
def small():
    phase = ramp(50, 60, 0.1, 0.2)
    return phase, np.exp(1j * phase).astype(np.complex64), np.full((50, 60), 0.9, np.float32)


@pytest.mark.parametrize(("init", "cost"), [("mcf", "smooth"), ("mst", "defo"), ("mcf", "topo"), ("laplace", "smooth")])
def test_ramp_is_recovered(spark, small, init, cost):
    phase, igram, corr = small
    unw, labels = P.unwrap_arrays(spark, igram, corr, 10.0, init=init, cost=cost)
    assert unw.shape == phase.shape and unw.dtype == np.float32
    assert np.abs(unw - phase).max() < 1e-3 and set(np.unique(labels)) == {1}


def test_mask_hole_has_no_label_and_outputs_are_filled(spark, small):
    _, igram, corr = small
    mask = np.ones((50, 60), np.uint8)
    mask[20:30, 20:40] = 0
    unw, labels = np.zeros((50, 60), np.float32), np.zeros((50, 60), np.uint32)
    got = P.unwrap_arrays(spark, igram, corr, 10.0, mask=mask, unw=unw, conncomp=labels)
    assert got[0] is unw and got[1] is labels and np.isfinite(unw).all()
    assert (labels[20:30, 20:40] == 0).all() and (labels[:20] == 1).all()


def test_tiles_agree_with_one_tile(spark, small):
    phase, igram, corr = small
    unw, _ = P.unwrap_arrays(spark, igram, corr, 10.0, init="laplace", ntiles=(2, 2), tile_overlap=8, neighbor_feedback=True, fix_cycle_spikes=True)
    assert np.percentile(np.abs(unw - phase), 95) < 0.5


def test_nan_input_is_finite_and_reoptimising_lowers_the_cost(spark):
    igram = np.full((20, 24), np.nan + 0j, np.complex64)
    assert np.isfinite(P.unwrap_arrays(spark, igram, np.full((20, 24), 0.5, np.float32), 4.0)[0]).all()
    phase = ramp(24, 24, 0.5, 0.6) + np.random.default_rng(11).normal(0, 1.0, (24, 24))
    igram = np.exp(1j * phase).astype(np.complex64)
    unw, _ = P.unwrap_arrays(spark, igram, np.full((24, 24), 0.25, np.float32), 4.0, ntiles=(2, 2), tile_overlap=4, single_tile_reoptimize=True)
    assert np.abs(np.angle(np.exp(1j * (unw - phase)))).max() < 1e-3


def test_reference_pixel_is_anchored(spark, small):
    phase, igram, corr = small
    unw, _ = P.unwrap_arrays(spark, igram, corr, 10.0, reference_pixel=(40, 50))
    assert abs(unw[40, 50] - np.mod(phase[40, 50], TWO_PI)) < 1e-4
    other, _ = P.unwrap_arrays(spark, igram, corr, 10.0, reference_pixel=None)
    cycles = (unw - other) / TWO_PI
    assert np.allclose(cycles, np.round(cycles.mean()), atol=1e-3)


def test_validation(spark, small):
    _, igram, corr = small
    with pytest.raises(ValueError, match="2-D"):
        P.unwrap_arrays(spark, igram[None], corr, 10.0)
    with pytest.raises(ValueError, match="match"):
        P.unwrap_arrays(spark, igram, corr[:10, :10], 10.0)
    with pytest.raises(TypeError, match="complex"):
        P.unwrap_arrays(spark, corr, corr, 10.0)
    with pytest.raises(TypeError, match="corr"):
        P.unwrap_arrays(spark, igram, corr.astype(np.int16), 10.0)
    for bad in ({"cost": "x"}, {"init": "x"}, {"ntiles": (0, 1)}, {"init": "laplace", "cost": "defo"}, {"bridge": P.BridgeOptions(ramp_type="x")}):
        with pytest.raises(ValueError):
            UnwrapOptions(10.0, **bad)
    with pytest.raises(ValueError, match="nlooks"):
        UnwrapOptions(0.5)


def test_looks_and_tiling():
    assert P.effective_looks(13, 16, 2.33, 2.75, 7.5, 6.0) == pytest.approx(29.616888888888894)
    assert auto_tiles(200, 200, 1024, 64, 64) == (1, 1)
    a, b = auto_tiles(18240, 13162, 1024, 64, 64)
    assert 700 < 18240 / a < 2000 and 700 < 13162 / b < 2000
    assert auto_tiles(4096, 4096, 1024, 64, 64)[0] == auto_tiles(4096, 4096, 1024, 64, 64)[1]


def regrown(spark, unw, corr, mask=None, **options):
    df = as_df(spark, unw, mask, corr=corr.astype(np.float32))
    return to_arrays(components.regrow(df, unw.shape, **options), unw.shape, "conncomp")["conncomp"]


def test_components(spark):
    unw, corr = np.zeros((20, 30)), np.full((20, 30), 0.8)
    unw[:, 15:] = 10
    assert set(np.unique(regrown(spark, unw, corr))) == {1, 2}
    assert (regrown(spark, unw, corr, np.zeros((20, 30), bool)) == 0).all()
    island = np.zeros((20, 20))
    island[10, 10] = 100
    got = regrown(spark, island, np.full((20, 20), 0.9), min_conncomp_frac=0.05)
    assert got[10, 10] == 0 and (got == 1).sum() == 399
    unw[:, 10:20], unw[:, 20:] = 20, 40
    assert set(np.unique(regrown(spark, unw, corr, max_ncomps=1))) == {0, 1}


def test_spikes(spark):
    base = ramp(60, 40, 0.02, 0.01) + 1
    row = base.copy()
    row[27] -= TWO_PI
    fixed = to_arrays(seams.fix_cycle_spikes(as_df(spark, row)), base.shape, "unw")["unw"]
    assert np.allclose(fixed, base, atol=1e-3)
    column = base.T.copy()
    column[:, 33] += 2 * TWO_PI
    fixed = to_arrays(seams.fix_cycle_spikes(as_df(spark, column)), column.shape, "unw")["unw"]
    assert np.allclose(fixed, base.T, atol=1e-3)
    band = base.copy()
    band[20:40] -= TWO_PI
    assert np.allclose(to_arrays(seams.fix_cycle_spikes(as_df(spark, band)), base.shape, "unw")["unw"], band)
    mask = np.ones(base.shape, bool)
    mask[27, :10] = False
    masked = to_arrays(seams.fix_cycle_spikes(as_df(spark, row, mask)), base.shape, "unw")["unw"]
    assert np.allclose(masked[27, :10], row[27, :10]) and np.allclose(masked[27, 10:], base[27, 10:], atol=1e-3)


def feedback(spark, unw, mask, feather, overlap=64):
    out = seams.neighbour_feedback(as_df(spark, unw, mask), unw.shape, (1, 2), (overlap, overlap), feather)
    return to_arrays(out, unw.shape, "unw")["unw"]


def test_seams(spark):
    unw = np.full((50, 200), 10.0)
    unw[:, 100:] = 15
    out = feedback(spark, unw, None, 50)
    assert np.abs(out[:, 99] - out[:, 100]).max() < 0.5
    assert (out[:, :90] == 10).all() and (out[:, 160:] == 15).all()
    sparse = np.ones(unw.shape, bool)
    sparse[:, 99:101] = False
    sparse[::10, 99:101] = True
    out = feedback(spark, unw, sparse, 50)
    assert (out[:, 105] < 14.8).all()
    tall = np.vstack([unw] * 8)
    far = np.ones(tall.shape, bool)
    far[:, 99:101] = False
    far[190:200, 99:101] = True
    out = feedback(spark, tall, far, 50)
    assert np.allclose(out[[0, 50, 350, 399], 110], 15) and abs(out[195, 100] - 10) < 0.5


def plain_steps(d):
    """Upper medians of 21 lines, gaps filled from the measured lines on both sides."""
    measured = np.flatnonzero(~np.isnan(d))
    med = {i: np.sort(d[max(0, i - 10) : i + 11][~np.isnan(d[max(0, i - 10) : i + 11])]) for i in measured}
    out = np.full(len(d), np.nan)
    for i in range(len(d)):
        before, after = measured[measured <= i], measured[measured >= i]
        a, b = (before[-1] if len(before) else None), (after[0] if len(after) else None)
        x, y = (None if k is None else med[k][len(med[k]) // 2] for k in (a, b))
        if a == i:
            out[i] = x
        elif a is not None and b is not None and b - a <= 84:
            out[i] = x + (i - a) / (b - a) * (y - x)
        elif a is not None and i - a <= 42:
            out[i] = x * (1 - (i - a) / 42)
        elif b is not None and b - i <= 42:
            out[i] = y * (1 - (b - i) / 42)
    return out


def plain_feedback(unw, mask, ntiles, feather):
    """Seam after seam on arrays."""
    u = unw.copy()
    for v, m, n in ((u, mask, ntiles[1]), (u.T, mask.T, ntiles[0])):
        for place in seams.seam_places(v.shape[1], n, 0):
            step = plain_steps(np.where(m[:, place - 1] & m[:, place], v[:, place - 1] - v[:, place], np.nan))
            for x in range(place, min(place + feather, v.shape[1])):
                ok = ~np.isnan(step) & m[:, x]
                v[ok, x] += step[ok] * (1 - (x - place) / feather)
    return u


@pytest.mark.parametrize(("feather", "ntiles"), [(6, (2, 4)), (25, (3, 4)), (200, (2, 5))])
def test_many_seams_at_once(spark, feather, ntiles):
    """Short feathers, and long ones that reach over the next seams."""
    rng = np.random.default_rng(4)
    unw = ramp(40, 60, 0.02, 0.01) + rng.normal(0, 0.2, (40, 60))
    unw[:, 15:] += 1.5
    unw[:, 40:] -= 2.5
    unw[20:] += 0.8
    mask = rng.random(unw.shape) > 0.1
    out = seams.neighbour_feedback(as_df(spark, unw, mask), unw.shape, ntiles, (0, 0), feather)
    want = plain_feedback(unw, mask, ntiles, feather)
    assert np.allclose(to_arrays(out, unw.shape, "unw")["unw"], want, atol=1e-4)


@pytest.mark.parametrize(("n", "count", "overlap"), [(50, 1, 0), (50, 7, 0), (53, 4, 5), (40, 6, 11), (97, 9, 2)])
def test_tile_ids(spark, n, count, overlap):
    """Against the spans, also where a pixel lies in more than two tiles."""
    df = spark.range(n).select(F.lit("s").alias("scene"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    spans = tiles.spans(n, count, overlap)
    parts = tiles.split(df, (n, 1), (count, 1), (overlap, 0))
    assert Counter((r["row"], r["tr"], r["tc"]) for r in parts.collect()) == Counter((x, t, 0) for t, (a, b) in enumerate(spans) for x in range(a, b))
    own = {r["row"]: r["tr"] for r in tiles.owned(parts, (n, 1), (count, 1), (overlap, 0)).collect()}
    assert own == {x: max(t for t, (a, _) in enumerate(spans) if t == 0 or x >= a + overlap // 2) for x in range(n)}


def test_dilation(spark):
    point = np.zeros((21, 21), bool)
    point[10, 10] = True
    got = to_arrays(grid.dilate(from_arrays(spark, mask=point), 3), point.shape, "mask")["mask"]
    r, c = np.indices(point.shape)
    assert (got == (abs(r - 10) + abs(c - 10) <= 3)).all() and got.sum() == 25
    some = np.random.default_rng(0).random((30, 30)) > 0.5
    assert (to_arrays(grid.dilate(from_arrays(spark, mask=some), 0), some.shape, "mask")["mask"] == some).all()


def test_bridging(spark):
    rng = np.random.default_rng(0)
    smooth = ramp(60, 90, 0.02, 0.015) + 1 + rng.normal(0, 0.05, (60, 90))
    unw, mask = smooth.copy(), np.ones((60, 90), bool)
    unw[20:39] += 3 * TWO_PI
    unw[40:] -= 2 * TWO_PI
    mask[[19, 39]] = False
    out = to_arrays(B.bridge(as_df(spark, unw, mask), unw.shape), unw.shape, "unw", "conncomp")
    off = (out["unw"] - smooth)[mask]
    assert off.std() < 0.3 and set(np.unique(out["conncomp"])) == {0, 1, 2, 3}
    one = np.full((30, 30), 1.2345)
    assert (to_arrays(B.bridge(as_df(spark, one), one.shape), one.shape, "unw")["unw"] == one).all()


def test_steep_ramp_needs_the_fit(spark):
    true = ramp(200, 10, 0.2, 0.0) + 5
    mask = np.ones(true.shape, bool)
    mask[90:110] = False
    options = {"radius": 15, "min_num_pixel": 14}
    with_ramp = to_arrays(B.bridge(as_df(spark, true, mask), true.shape, P.BridgeOptions(ramp_type="linear_azimuth", **options)), true.shape, "unw")["unw"]
    without = to_arrays(B.bridge(as_df(spark, true, mask), true.shape, P.BridgeOptions(**options)), true.shape, "unw")["unw"]
    assert np.allclose(with_ramp[mask], true[mask], atol=1e-6) and not np.allclose(without[mask], true[mask])


def test_tile_geometry_and_owner(spark):
    for n, t, ov in ((100, 3, 8), (57, 4, 5), (64, 2, 7)):
        spans = tiles.spans(n, t, ov)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] + ov == a[1] for a, b in zip(spans, spans[1:], strict=False))
    rows = tiles.geometry(spark, (100, 64), (3, 2), (8, 7)).orderBy("tr", "tc").collect()
    want = [(i, j, a, c, b - a, d - c) for i, (a, b) in enumerate(tiles.spans(100, 3, 8)) for j, (c, d) in enumerate(tiles.spans(64, 2, 7))]
    assert [tuple(r) for r in rows] == want


def test_sources(spark, tmp_path, small):
    _, igram, corr = small
    igram.tofile(tmp_path / "a.int")
    corr.tofile(tmp_path / "a.cor")
    back = to_arrays(read_flat(spark, str(tmp_path / "a.int"), igram.shape), igram.shape, "re", "im")
    assert np.array_equal(back["re"], igram.real) and np.array_equal(back["im"], igram.imag)
    register_flat(spark)
    df = spark.read.format("flat_raster").option("path", str(tmp_path / "a.cor")).option("nrow", 50).option("ncol", 60).load()
    assert np.array_equal(to_arrays(df, corr.shape, "value")["value"], corr)
    write_raster(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("scene = 'scene'").count() == 3000
    blocks = to_blocks(df, (16, 25), "value")
    assert blocks.count() == 4 * 3
    assert np.array_equal(to_arrays(from_blocks(blocks, "value"), corr.shape, "value")["value"], corr)


def test_stream_of_scenes(spark, tmp_path, small):
    from phasegrid.streaming import unwrap_stream

    _, igram, corr = small
    write = from_arrays(spark, igram=igram[:12, :14], corr=corr[:12, :14])
    write.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(write.schema).parquet(str(tmp_path / "in"))
    unwrap_stream(stream, (12, 14), UnwrapOptions(10.0), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12 * 14


def test_cluster_info(spark):
    assert P.cluster_info(spark)["count"] >= 1
