"""Quality of the composite kernels against floors, and agreement of the two layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.operators import finish as P
from prismgrid.operators import merge
from prismgrid.plans import blocks as B
from prismgrid.plans import kernels as K
from prismgrid.plans import reports as R
from prismgrid.sources import scenes as S

#: Floors of PSNR and SSIM and ceilings of MAE per scene. Fixed values.
FLOORS = {
    "edges": (38.7, 0.972, 1.96), "texture": (38.5, 0.977, 2.05), "gradients": (40.5, 0.944, 1.73),
    "lowlight": (39.5, 0.943, 1.96), "highcontrast": (37.2, 0.883, 2.62), "colorchart": (32.3, 0.938, 4.21),
}


def test_report_holds_its_floors(spark):
    got = {r["scene"]: r for r in R.pipeline_quality(spark).collect()}
    assert set(got) == set(FLOORS)
    for scene, (psnr, ssim, mae) in FLOORS.items():
        assert got[scene]["psnr"] >= psnr and got[scene]["ssim"] >= ssim and got[scene]["mae"] <= mae, scene


def test_hdr(spark):
    r = R.hdr_quality(spark).first()
    assert r["psnr"] >= 21.66 and r["ssim"] >= 0.678 and r["mae"] <= 15.81
    assert r["shadow_mae"] < r["best_single_shadow_mae"] and r["highlight_mae"] < r["best_single_highlight_mae"]


def test_super_resolution(spark):
    r = R.super_resolution_quality(spark).first()
    assert r["recovery"] > 3 and r["mae"] < 6


def test_night(spark):
    r = R.night_quality(spark).first()
    assert r["psnr"] >= 37.35 and r["ssim"] >= 0.875 and r["mae"] <= 2.527


def test_known_shift_is_found():
    f = S.clean("texture")
    found = K.align([K.luma_int(f), K.luma_int(S.shift(f, 5, -3))])
    assert found[1][:2] == (5, -3) and found[1][3]


def test_pyramid_collapses_to_itself():
    p = np.random.default_rng(1).normal(size=(37, 51))
    assert np.allclose(K.collapse(K.laplacian(K.gaussian(p))), p)


@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (40, 1), (3, 3), (17, 5)])
def test_box_and_extremes_against_loops(shape):
    x = np.random.default_rng(2).normal(size=shape)
    for r in (1, 2, 5):
        y, z = np.empty(shape), np.empty(shape)
        for i in range(shape[0]):
            for j in range(shape[1]):
                ii = np.clip(np.arange(i - r, i + r + 1), 0, shape[0] - 1)
                jj = np.clip(np.arange(j - r, j + r + 1), 0, shape[1] - 1)
                y[i, j], z[i, j] = x[np.ix_(ii, jj)].mean(), x[np.ix_(ii, jj)].max()
        assert np.allclose(K.box(x, r), y) and np.array_equal(K.extreme(x, r), z)


def test_tiles_agree_with_the_whole():
    f = S.landscape()
    gains, knee = K.finish_stats(K.analysis_frame(f), P.DEFAULT)
    whole = K.region_finish(f, P.DEFAULT, gains, knee, 0, *f.shape[:2])
    assert np.array_equal(K.finish_tiled(f, P.DEFAULT, tile=48, stats=(gains, knee)), whole)


def test_layouts_agree(spark):
    f = S.noisy(S.skin_chart()[::2, ::2], 3)
    px = S.pixels(spark, [f])
    rows = P.finish(px, P.DEFAULT, width=64).orderBy("y", "x").toPandas()[["r", "g", "b"]].to_numpy().reshape(f.shape)
    away = np.abs(rows.astype(int) - K.finish(f, P.DEFAULT))
    assert away.max() <= 1 and (away > 0).mean() < 1e-3


def test_merge_layouts_agree(spark):
    frames = S.burst(S.clean("edges")[:64, :64], 7, 3)
    rows = merge.merge_burst(S.pixels(spark, frames), (64, 64)).orderBy("y", "x").toPandas()[["r", "g", "b"]].to_numpy().reshape(64, 64, 3)
    away = np.abs(rows.astype(int) - K.merge(frames)[0])
    assert away.max() <= 1 and (away > 0).mean() < 1e-3


def test_noise_rows_and_arrays_agree(spark):
    px = S.noise_pixels(S.chart_pixels(spark, "colorchart"), 0xC0FFEE, S.SIZE).orderBy("y", "x").toPandas()
    assert (px[["r", "g", "b"]].to_numpy().reshape(128, 128, 3) == S.noisy(S.clean("colorchart"), 0xC0FFEE)).mean() > 0.9999


def test_partition_count_does_not_matter(spark):
    px = S.pixels(spark, [S.noisy(S.clean("gradients")[:24, :40], 5)])
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(P.denoise_chroma(px.repartition(int(n)), 0.6).orderBy("y", "x").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_frames_round_trip(spark):
    frames = [S.clean("edges")[:10, :7], S.clean("texture")[:3, :3]]
    back = B.from_pixels(B.to_pixels(B.from_arrays(spark, frames))).orderBy("frame_id").collect()
    for f, r in zip(frames, back, strict=True):
        assert np.array_equal(B.decode(r["rgb"], r["width"], r["height"]), f)


def test_empty_pixels(spark):
    px = S.pixels(spark, [S.clean("edges")[:4, :4]]).filter(F.lit(False))
    assert P.denoise_chroma(px, 0.6).count() == 0


def test_bokeh_tiles_agree_with_the_whole(spark):
    f, mask = S.disc_scene(300, 220)
    frames = B.from_arrays(spark, [f]).withColumn("mask", F.lit(np.ascontiguousarray(mask).tobytes()))
    whole = B.decode(B.render_bokeh(frames).first()["rgb"], 300, 220)
    tiled = B.decode(B.assemble(B.bokeh_tiles(frames, tile=96)).first()["rgb"], 300, 220)
    away = np.abs(whole.astype(int) - tiled)
    assert away.max() <= 1 and (away > 0).mean() < 1e-3


def test_even_radius_blurs_as_reads_by_place():
    rng = np.random.default_rng(5)
    rgb, radius, weight = rng.uniform(0, 255, (90, 70, 3)), np.full((90, 70), 6.3, np.float32), rng.uniform(0, 1, (90, 70))
    radius[20:40, 10:60] = rng.uniform(0, 6, (20, 50))
    whole = K.disc_blur(rgb, radius, weight, K.disc_taps(24))
    slow = K.disc_blur(rgb, np.where(radius == np.float32(6.3), radius, radius), weight, K.disc_taps(24)[::-1])
    one = np.empty_like(whole)
    for y, x in [(0, 0), (5, 69), (50, 30), (89, 0), (30, 30)]:
        total, mass = np.zeros(3), 0.0
        for dx, dy in K.disc_taps(24):
            px, py = np.clip(x + dx * radius[y, x], 0, 69), np.clip(y + dy * radius[y, x], 0, 89)
            v = K.bilinear(np.dstack([rgb, weight]), np.array([[px]]), np.array([[py]]))[0, 0]
            total, mass = total + v[3] * v[:3], mass + v[3]
        one[y, x] = total / mass if radius[y, x] >= 0.5 else rgb[y, x]
        assert np.allclose(whole[y, x], one[y, x], atol=0.01) and np.allclose(slow[y, x], one[y, x], atol=0.01)


@pytest.mark.parametrize("night", [False, True])
def test_merge_tiles_agree_with_the_whole(spark, night):
    bursts = [S.burst(S.clean("edges")[:80, :100], 7, 4), S.burst(S.clean("texture")[:80, :100], 3, 3)]
    bursts[0][2] = S.shift(bursts[0][2], 4, -3)
    frames = B.from_arrays(spark, [f for b in bursts for f in b], burst_id=["a"] * 4 + ["b"] * 3)
    got = {r["burst_id"]: r for r in B.assemble(B.merge_tiles(frames, night, tile=48), "burst_id").collect()}
    for key, burst in zip("ab", bursts, strict=True):
        want, used, _ = K.merge(burst, night)
        away = np.abs(want.astype(int) - B.decode(got[key]["rgb"], 100, 80))
        assert got[key]["used"] == used and away.max() <= 1 and (away > 0).mean() < 1e-3
    alone = B.assemble(B.merge_tiles(frames.limit(1)), "burst_id").first()
    assert alone["used"] == 1 and np.array_equal(B.decode(alone["rgb"], 100, 80), bursts[0][0])


@pytest.mark.parametrize("tile", [32, 64])
def test_merge_tiles_of_frames_of_other_sizes(spark, tile):
    whole = S.burst(S.clean("edges")[:70, :100], 7, 4)
    burst = [whole[0][:65], whole[1][:64, :98], whole[2], whole[3][:40]]
    frames = B.from_arrays(spark, burst, burst_id=["a"] * 4)
    got = B.assemble(B.merge_tiles(frames, tile=tile), "burst_id").first()
    want, used, _ = K.merge(burst)
    away = np.abs(want.astype(int) - B.decode(got["rgb"], got["width"], got["height"]))
    assert want.shape == (65, 100, 3) and got["used"] == used and away.max() <= 1 and (away > 0).mean() < 1e-3


def test_super_resolution_of_frames_of_other_sizes(spark):
    whole = S.burst(S.clean("edges")[:128, :64], 7, 3)
    burst = [whole[0][:127], whole[1][:126], whole[2]]
    frames = B.from_arrays(spark, burst, burst_id=["a"] * 3)
    got = B.merge_bursts(frames, "super").first()
    want = K.super_resolve([f[:126] for f in whole])[0]
    f = B.decode(got["rgb"], got["width"], got["height"])
    assert f.shape == (254, 128, 3)
    # Far from the rows that only some frames have it is the result of equal frames.
    assert (np.abs(f[:128].astype(int) - want[:128]) > 2).mean() < 0.01
