"""The composite image operators: finishing stages and chain, alignment, merging, fusion, super-
resolution, depth of field, tiles, presets and reports, with SQL where SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from prismgrid.catalog import sql
from prismgrid.catalog.aggregates import EV_BURST, cue_ctes, ev_burst, gains_query
from prismgrid.catalog.windows import down_sql, mask_steps, up_sql
from prismgrid.functions import color as C
from prismgrid.operators import align, merge, stats
from prismgrid.operators import finish as P
from prismgrid.plans import blocks as B
from prismgrid.plans import kernels as K
from prismgrid.plans import reports as R
from prismgrid.sources import raster, scenes

QUERIES, ORACLE_SQL = {}, {}
_YX = ("y", "x", "r", "g", "b")


def stage(name: str, run, steps) -> None:
    """Register a stage over the colour frame: the operator, and SQL steps that follow it."""
    QUERIES[name] = lambda spark, sf_dir: run(raster.event_pixels(spark, sf_dir)).select(*_YX)
    q = sql.Steps(sql.EVENTS)
    steps(q)
    ORACLE_SQL[name] = q.done(f"SELECT {', '.join(_YX)} FROM @")


def _codes(q: sql.Steps, r: str, g: str, b: str) -> None:
    q.replace({"r": r, "g": g, "b": b})


def denoise_steps(q: sql.Steps, strength: float) -> None:
    y, s = C.luma(), C.num(strength)
    q.plus({"y_": y, "cb_": f"b - {y}", "cr_": f"r - {y}"})
    q.guided({"fb_": "cb_", "fr_": "cr_"}, "y_", 4, P.EPS_FINE)
    cb, cr = f"(cb_ + {s} * (fb_ - cb_))", f"(cr_ + {s} * (fr_ - cr_))"
    _codes(q, C.code(f"y_ + {cr}"), C.code(C.green_of("y_", cr, cb)), C.code(f"y_ + {cb}"))
    q.drop("y_", "cb_", "cr_", "fb_", "fr_")


def ratio_steps(q: sql.Steps, ratio: str, keep: str | None, *gone: str) -> None:
    q.plus({"ratio_": C.clamp(ratio, 0.25, 4.0)})
    _codes(q, *(C.code(C.lerp_to(c, f"({c} * ratio_)", keep)) for c in "rgb"))
    q.drop("ratio_", *gone)


def tone_steps(q: sql.Steps, strength: float, keep: str | None = None) -> None:
    q.plus({"y_": C.luma()})
    q.guided({"base_": "y_"}, "y_", 16, P.EPS_FINE)
    new = f"(128e0 + (base_ - 128e0) * {C.num(1 - 0.15 * strength)} + {C.num(1 + 0.15 * strength)} * (y_ - base_))"
    ratio_steps(q, f"(({new} + 1e0) / (y_ + 1e0))", keep, "y_", "base_")


def detail_steps(q: sql.Steps, strength: float, keep: str | None = None) -> None:
    q.plus({"y_": C.luma()})
    q.guided({"base_": "y_"}, "y_", 3, P.EPS_DETAIL)
    q.plus({"d_": "y_ - base_"})
    planes = q.last
    q.extreme({"lo_": "y_"}, 1, "min")
    q.extreme({"hi_": "y_"}, 1)
    q.plus({"knee_": f"(SELECT 2e0 * 1.4826e0 * median(abs(d_ - (SELECT median(d_) FROM {planes}))) FROM {planes})"})
    sharp = f"(y_ + {C.num(0.6 * strength)} * ({C.coring('d_', 'knee_')}))"
    held = f"least(greatest({sharp}, lo_ - 5e0), hi_ + 5e0)"
    ratio_steps(q, f"(({held} + 1e0) / (y_ + 1e0))", keep, "y_", "base_", "d_", "lo_", "hi_", "knee_")


def rolloff_steps(q: sql.Steps, strength: float, radius: int) -> None:
    y = C.luma()
    q.plus({"m_": f"sqrt((r - {y}) * (r - {y}) + (b - {y}) * (b - {y}))"})
    q.box({"near_": "m_"}, radius)
    q.extreme({"ref_": "near_"}, radius // 2)
    q.plus({"knee_": "greatest(30e0, 1.5e0 * ref_)"})
    q.plus({"s_": f"CASE WHEN m_ > knee_ THEN 1e0 + {C.num(strength)} * (({C.chroma_shoulder('m_', 'knee_', 18)}) / m_ - 1e0) ELSE 1e0 END"})
    _codes(q, *(C.code(f"{y} + ({c} - {y}) * s_") for c in "rgb"))
    q.drop("m_", "near_", "ref_", "knee_", "s_")


def region_steps(q: sql.Steps, strength: float) -> None:
    y, s = C.luma(), C.num(strength)
    q.plus({"y_": y, "cb_": f"b - {y}", "cr_": f"r - {y}"})
    q.guided({"fb_": "cb_", "fr_": "cr_"}, "y_", 8, P.EPS_FINE)
    smooth = f"({s} * 0.7e0 * greatest(sky, overcast))"
    q.plus({"hb_": f"cb_ + {smooth} * (fb_ - cb_)", "hr_": f"cr_ + {smooth} * (fr_ - cr_)", "ay_": f"y_ + {s} * 4e0 * foliage"})
    q.plus({"mag_": "sqrt(hr_ * hr_ + hb_ * hb_)"})
    extra, cap = f"({s} * (0.14e0 * sky + 0.16e0 * foliage))", f"({s} * (12e0 * sky + 8e0 * foliage))"
    q.plus({
        "k_": f"CASE WHEN mag_ > 1e-6 AND {extra} > 0e0 THEN least(least(mag_ * (1e0 + {extra}), mag_ + {cap}) / mag_, "
        f"greatest(1e0, {C.gamut_scale('ay_', 'hr_', 'hb_')})) ELSE 1e0 END"
    })
    _codes(q, C.code("ay_ + hr_ * k_"), C.code(C.green_of("ay_", "hr_ * k_", "hb_ * k_")), C.code("ay_ + hb_ * k_"))
    q.drop("y_", "cb_", "cr_", "fb_", "fr_", "hb_", "hr_", "ay_", "mag_", "k_")


def rescue_steps(q: sql.Steps, strength: float, gated: bool) -> None:
    y, src = C.luma(), q.last
    share = lambda test: f"avg(CASE WHEN {test} THEN 1e0 ELSE 0e0 END)"
    found = f"""(SELECT {stats.backlit_strength()} FROM (SELECT {share(f'{y} >= 24e0 AND {y} < 60e0')} AS dark, {share(f'{y} > 160e0')} AS bright, {share(f'{y} >= 70e0 AND {y} <= 150e0')} AS mid FROM {src}))"""
    q.plus({"y_": y, "e_": f"{C.num(strength)} * {found if gated else '1e0'}"})
    q.guided({"base_": "y_"}, "y_", 32, (0.035 * 255) ** 2)
    q.plus({"gain_": C.rescue_gain("greatest(base_, 1e0)")})
    _codes(q, *(f"CASE WHEN e_ > 0e0 THEN {new} ELSE {c} END" for c, new in zip("rgb", P.rescue_channels("gain_", "e_"), strict=True)))
    q.drop("y_", "e_", "base_", "gain_")


def balance_steps(q: sql.Steps, strength: float) -> None:
    src = q.last
    q.parts.append(f"gains AS (WITH {cue_ctes(src)} {gains_query(src)})")
    q.add(f"SELECT * FROM {src} CROSS JOIN gains")
    by = lambda c: f"(1e0 + {C.num(strength)} * (gain_{c} - 1e0))"
    q.replace({"r": C.gain("r", by("r")), "b": C.gain("b", by("b"))})
    q.drop("gain_r", "gain_b")


def chain_steps(q: sql.Steps, p: P.Params, width: int = 100) -> None:
    """The whole chain."""
    if p.backlit_rescue > 0:
        rescue_steps(q, p.backlit_rescue, p.rescue_gated)
    balance_steps(q, p.white_balance)
    denoise_steps(q, p.chroma_denoise)
    q.box({"skin_": C.skin()}, 8)
    q.replace({"skin_": f"CAST(CAST(1e0 - {C.num(p.skin_protection)} * {C.clamp('skin_', 0, 1)} AS FLOAT) AS DOUBLE)"})
    if p.semantic > 0:
        mask_steps(q)
    tone_steps(q, p.local_contrast, "skin_")
    detail_steps(q, p.detail, "skin_")
    _codes(q, *(C.tone(c, p.shadows_lift, p.highlight_rolloff) for c in "rgb"))
    _codes(q, *(C.saturate(c, p.saturation, "skin_") for c in "rgb"))
    _codes(q, *(C.contrast(c, p.contrast) for c in "rgb"))
    if p.chroma_rolloff > 0:
        rolloff_steps(q, p.chroma_rolloff, P.rolloff_radius(width))
    if p.semantic > 0:
        region_steps(q, p.semantic)


stage("c14_chroma_denoise", lambda px: P.denoise_chroma(px, 0.6), lambda q: denoise_steps(q, 0.6))
stage("c15_local_tone", lambda px: P.local_tone(px, 0.35), lambda q: tone_steps(q, 0.35))
stage("c16_detail", lambda px: P.enhance_detail(px, 0.5), lambda q: detail_steps(q, 0.5))
stage("c17_chroma_rolloff", lambda px: P.roll_off_chroma(px, 1.0), lambda q: rolloff_steps(q, 1.0, 24))
stage("c13_backlit_rescue", lambda px: P.rescue_backlit(px, P.engagement(px, P.Params(backlit_rescue=0.8, rescue_gated=False))), lambda q: rescue_steps(q, 0.8, False))
stage("c12_white_balance", lambda px: P.balance(px, stats.white_balance_gains(px), 0.8), lambda q: balance_steps(q, 0.8))


def _with_masks(px):
    size = px.groupBy("frame_id").agg((F.max("y") + 1).alias("h"))
    return P.render_regions(P.scene_masks(px.join(F.broadcast(size), "frame_id")), 1.0)


def _regions(q):
    mask_steps(q)
    region_steps(q, 1.0)


stage("c18_semantic_rendering", _with_masks, _regions)
for _name, _params in (("default", P.DEFAULT), ("rendition", P.RENDITION), ("reference", P.REFERENCE), ("night", P.NIGHT)):
    stage(f"c12_finish_{_name}", lambda px, p=_params: P.finish(px, p), lambda q, p=_params: chain_steps(q, p))
for _name, _params in P.PRESETS.items():
    stage(f"c23_preset_{_name.lower()}", lambda px, p=_params: P.finish(px, p), lambda q, p=_params: chain_steps(q, p))


def align_moved(spark, sf_dir):
    """The offset of a frame that was moved by (2, -1)."""
    h = raster.read(spark, sf_dir, "embeddings").count()
    p = raster.shifted(raster.embedding_plane(spark, sf_dir), 2, -1)
    return align.align(p, (64, h)).select("frame_id", "dx", "dy", F.round("mad", 6).alias("mad"), "accepted")


QUERIES["c01_align"] = align_moved


def refine_moved(spark, sf_dir):
    """Tile offsets of the moved frame."""
    p = raster.shifted(raster.embedding_plane(spark, sf_dir), 2, -1)
    known = spark.createDataFrame([(1, 2, -1, True)], "frame_id long, dx int, dy int, accepted boolean")
    return align.tile_offsets(p, known).select("ty", "tx", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


QUERIES["c02_tile_offsets"] = refine_moved
_GRID = "FROM p a CROSS JOIN range(-3, 4) t(i) CROSS JOIN range(-3, 4) u(j) JOIN p b ON a.frame_id = 0 AND b.frame_id = 1 AND b.y = a.y - 1 + j AND b.x = a.x + 2 + i"
_part = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0e0 WHEN abs({C.parabola(a, 'z.mad', b)}) < 0.1e0 THEN 0e0 ELSE {C.parabola(a, 'z.mad', b)} END"
ORACLE_SQL["c02_tile_offsets"] = f"""WITH p AS ({sql.moved(2, -1)}), m AS (SELECT CAST(a.y // 32 AS INT) AS ty, CAST(a.x // 32 AS INT) AS tx, i, j, avg(abs(a.v - b.v)) AS mad {_GRID} GROUP BY 1, 2, 3, 4),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY mad, j, i) AS k FROM m WHERE abs(i) <= 2 AND abs(j) <= 2) WHERE k = 1)
SELECT z.ty, z.tx, round(2 + z.i + {_part('l.mad', 'r.mad')}, 6) AS dx, round(-1 + z.j + {_part('o.mad', 'd.mad')}, 6) AS dy FROM z
LEFT JOIN m l ON l.ty = z.ty AND l.tx = z.tx AND l.j = z.j AND l.i = z.i - 1 LEFT JOIN m r ON r.ty = z.ty AND r.tx = z.tx AND r.j = z.j AND r.i = z.i + 1
LEFT JOIN m o ON o.ty = z.ty AND o.tx = z.tx AND o.i = z.i AND o.j = z.j - 1 LEFT JOIN m d ON d.ty = z.ty AND d.tx = z.tx AND d.i = z.i AND d.j = z.j + 1"""


def merge_rows(spark, sf_dir):
    """A noisy burst of the chart merged over pixel rows."""
    px = scenes.pixels(spark, scenes.burst(scenes.clean("edges")[:64, :64], 7, 3))
    return merge.merge_burst(px, (64, 64)).select(*_YX)


QUERIES["c03_merge_rows"] = merge_rows


def _bursts(spark, frames, **columns):
    return B.from_arrays(spark, frames, burst_id=["b"] * len(frames), **columns)


QUERIES["c04_burst_merge"] = lambda spark, sf_dir: B.to_pixels(B.merge_bursts(_bursts(spark, scenes.burst(scenes.clean("colorchart"), R.SEED, 6))).drop("used"))
QUERIES["c05_night_quality"] = lambda spark, sf_dir: R.rounded(R.night_quality(spark), 4)
QUERIES["c06_hdr_quality"] = lambda spark, sf_dir: R.rounded(R.hdr_quality(spark), 4)
QUERIES["c09_super_resolution_quality"] = lambda spark, sf_dir: R.rounded(R.super_resolution_quality(spark), 4)
QUERIES["a22_quality_report"] = lambda spark, sf_dir: R.rounded(R.pipeline_quality(spark), 4)
QUERIES["a22_rendition_report"] = lambda spark, sf_dir: R.rounded(R.rendition_quality(spark), 4)


def fuse_rows(spark, sf_dir):
    last = raster.read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    h = 0 if last is None else last // 5 + 1  # of the first frame, which is as high as any
    return merge.fuse_pyramid(ev_burst(spark, sf_dir), (64, h))


QUERIES["c07_pyramid_fusion"] = fuse_rows


def _fusion_sql() -> str:
    """Two exposures of the grey burst, one level down and up again (64 x 100 keeps three levels)."""
    w = f"""SELECT frame_id, y, x, CAST(r AS DOUBLE) AS c, CASE WHEN sum(raw_) OVER (PARTITION BY y, x) <= 1e-6 THEN 1e0 / count(*) OVER (PARTITION BY y, x)
 ELSE raw_ / sum(raw_) OVER (PARTITION BY y, x) END AS wt FROM (SELECT *, pow({C.exposure_weight('ev')}, 0.7e0) AS raw_ FROM ({EV_BURST}))"""
    parts, out = [f"w AS MATERIALIZED ({w})"], []
    for f in range(5):
        for name, column in (("g", "c"), ("k", "wt")):
            parts.append(f"{name}{f}_0 AS MATERIALIZED (SELECT y, x, {column} AS v FROM w WHERE frame_id = {f})")
            for level in (1, 2, 3):
                parts.append(f"{name}{f}_{level} AS MATERIALIZED ({down_sql(f'{name}{f}_{level - 1}')})")
    for level in range(4):
        each = []
        for f in range(5):
            g = f"g{f}_{level}"
            if level < 3:
                parts.append(f"u{f}_{level} AS MATERIALIZED ({up_sql(f'g{f}_{level + 1}', g)})")
                each.append(f"SELECT a.y, a.x, k.v * (a.v - u.v) AS v FROM {g} a JOIN u{f}_{level} u ON u.y = a.y AND u.x = a.x JOIN k{f}_{level} k ON k.y = a.y AND k.x = a.x")
            else:
                each.append(f"SELECT a.y, a.x, k.v * a.v AS v FROM {g} a JOIN k{f}_{level} k ON k.y = a.y AND k.x = a.x")
        parts.append(f"f{level} AS MATERIALIZED (SELECT y, x, sum(v) AS v FROM ({' UNION ALL '.join(each)}) GROUP BY y, x)")
    parts.append("c3 AS (SELECT * FROM f3)")
    for level in (2, 1, 0):
        parts.append(f"x{level} AS MATERIALIZED ({up_sql(f'c{level + 1}', f'f{level}')})")
        parts.append(f"c{level} AS MATERIALIZED (SELECT a.y, a.x, a.v + u.v AS v FROM f{level} a JOIN x{level} u ON u.y = a.y AND u.x = a.x)")
    out = ", ".join(f"{C.code('v')} AS {c}" for c in "rgb")
    return f"WITH {', '.join(parts)} SELECT y, x, {out} FROM c0"


ORACLE_SQL["c07_pyramid_fusion"] = _fusion_sql()


def bokeh(spark, sf_dir):
    """Depth of field on a disc before a background: mean colours of the disc and of the rest."""
    f, mask = scenes.disc_scene(200, 200)
    frames = B.from_arrays(spark, [f]).withColumn("mask", F.lit(np.ascontiguousarray(mask).tobytes()))
    px = B.to_pixels(B.render_bokeh(frames, scaled=False))
    inside = F.expr("sqrt((x - 100) * (x - 100) + (y - 100) * (y - 100)) <= 44e0").alias("subject")
    return px.groupBy(inside).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in "rgb"])


QUERIES["c11_bokeh"] = bokeh


def blur_map(spark, sf_dir):
    """Feathered mask and blur radius of the colour frame, its red channel as the confidence."""
    from prismgrid.operators import neighborhood as N

    px = raster.event_pixels(spark, sf_dir).withColumns({"l": F.expr(C.luma()), "conf": F.col("r") / 255.0})
    px = N.box_mean(N.guided(px, {"m": "conf"}, "l", 12, 150.0), {"s": "m"}, 2)
    m = F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0))
    return px.select("y", "x", F.round(m, 6).alias("mask"), F.round(12.0 * (1.0 - m), 6).alias("radius"))


QUERIES["c10_blur_map"] = blur_map
_q = sql.Steps(sql.EVENTS)
_q.plus({"l": C.luma(), "conf": "r / 255e0"})
_q.guided({"m": "conf"}, "l", 12, 150.0)
_q.box({"s": "m"}, 2)
ORACLE_SQL["c10_blur_map"] = _q.done(f"SELECT y, x, round({C.clamp('s', 0, 1)}, 6) AS mask, round(12e0 * (1e0 - {C.clamp('s', 0, 1)}), 6) AS radius FROM @")


def tiles(spark, sf_dir):
    """The colour frame finished by tiles: statistics from the whole frame, cores from padded tiles."""
    frames = B.from_pixels(raster.event_pixels(spark, sf_dir))
    done = B.assemble(B.finish_tiles(frames, P.RENDITION, tile=64))
    return B.to_pixels(done).select(*_YX)


QUERIES["c20_tiled_finish"] = tiles


def blocks_chain(spark, sf_dir):
    """The default chain by the frame layout."""
    return B.to_pixels(B.finish_frames(B.from_pixels(raster.event_pixels(spark, sf_dir)))).select(*_YX)


QUERIES["c12_finish_frames"] = blocks_chain
ORACLE_SQL["c12_finish_frames"] = ORACLE_SQL["c12_finish_default"]


def timings(spark, sf_dir):
    """Seconds of each stage of the chain over four 400 x 300 frames: ``stage, frames, seconds, share``."""
    import time

    def run(batches):
        import pandas as pd

        for batch in batches:
            for job in batch.itertuples(index=False):
                f = scenes.benchmark_scene(400, 300, int(job.seed))
                p, rows = P.RENDITION, []
                stages = {
                    "backlit": lambda f: K.rescued(f, p), "white-balance": lambda f: K.balance(f, K.white_balance_gains(f), p.white_balance),
                    "chroma-denoise": lambda f: K.denoise_chroma(f, p.chroma_denoise), "local-tone": lambda f: K.local_tone(f, p.local_contrast),
                    "detail-enhance": lambda f: K.enhance_detail(f, p.detail), "tone-sat-contrast": lambda f: K.grade(f, p),
                    "chroma-roll-off": lambda f: K.roll_off_chroma(f, p.chroma_rolloff, 24),
                    "semantic-masks": lambda f: K.render_regions(f, K.masks(f, K.luma(f), 0, len(f)), p.semantic),
                }
                for name, work in stages.items():
                    began = time.perf_counter()
                    f = work(f)
                    rows.append((name, time.perf_counter() - began))
                yield pd.DataFrame(rows, columns=["stage", "seconds"])

    each = spark.range(4, numPartitions=4).withColumnRenamed("id", "seed").mapInPandas(run, "stage string, seconds double")
    whole = Window.partitionBy()
    spent = each.groupBy("stage").agg(F.count(F.lit(1)).alias("frames"), F.sum("seconds").alias("seconds"))
    return spent.withColumn("share", F.col("seconds") / F.sum("seconds").over(whole))


QUERIES["c24_stage_timings"] = timings


def look_frames(spark, sf_dir):
    """The skin-safe look on every frame, as the live path applies it."""
    from prismgrid.streaming import live

    return live.graded(raster.event_pixels(spark, sf_dir)).select(*_YX)


QUERIES["c22_live_look"] = look_frames
_UNIT = tuple(f"({c} / 255e0)" for c in "rgb")
ORACLE_SQL["c22_live_look"] = f"SELECT y, x, {', '.join(f'{C.code(f"255e0 * {C.look(c, True, _UNIT)}")} AS {c}' for c in 'rgb')} FROM ({sql.EVENTS})"
