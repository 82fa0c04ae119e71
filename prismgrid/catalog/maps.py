"""Per-pixel maps, predicates and scalar rules: one definition gives the plan and its SQL.

The expressions are engine-neutral text, run by Spark over the raster of a table and by DuckDB over
the same raster.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.catalog import sql
from prismgrid.functions import color as C
from prismgrid.functions import scalars as X
from prismgrid.operators import finish
from prismgrid.plans import kernels
from prismgrid.sources import raster, scenes

QUERIES, ORACLE_SQL = {}, {}


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def over_pixels(name: str, columns: dict[str, str], where: str = "TRUE") -> None:
    """Register a map over the colour raster of ``events``."""

    def run(spark, sf_dir):
        px = raster.event_pixels(spark, sf_dir).filter(where)
        return px.select("y", "x", *[F.expr(e).alias(n) for n, e in columns.items()])

    QUERIES[name] = run
    picked = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    ORACLE_SQL[name] = f"SELECT y, x, {picked} FROM ({sql.EVENTS}) WHERE {where}"


def over_events(name: str, columns: dict[str, str], where: str = "TRUE") -> None:
    """Register scalar rules over ``events``."""

    def run(spark, sf_dir):
        rows = raster.read(spark, sf_dir, "events").filter(where)
        return rows.select("event_id", *[F.expr(e.replace("VARCHAR(20)", "STRING").replace("VARCHAR(1)", "STRING")).alias(n) for n, e in columns.items()])

    QUERIES[name] = run
    picked = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    ORACLE_SQL[name] = f"SELECT event_id, {picked} FROM events WHERE {where}"


def rgb(make) -> dict[str, str]:
    return {c: make(c) for c in "rgb"}


over_pixels("m01_luma_int", {"luma": C.luma_int()})
over_pixels("m02_luma_double", {"luma": r6(C.luma()), "milli": C.luma_milli()})
over_pixels("m03_gain", rgb(lambda c: C.gain(c, "1.37e0")))
over_pixels("m04_white_balance_gains", {"r": C.gain("r", "1e0 + 0.8e0 * (1.2e0 - 1e0)"), "g": "g", "b": C.gain("b", "1e0 + 0.8e0 * (0.85e0 - 1e0)")})
over_pixels("m06_saturation", rgb(lambda c: C.saturate(c, 1.08)))
over_pixels("m06_saturation_modulated", rgb(lambda c: C.saturate(c, 1.15, f"(1e0 - 0.7e0 * {C.skin()})")))
over_pixels("m07_contrast", rgb(lambda c: C.contrast(c, 1.05)))
over_pixels("m08_force_opaque", {"a": "255", "argb": "CAST((255 - 256) * 16777216 + r * 65536 + g * 256 + b AS INT)"})
over_pixels("m09_mirror", {"mirrored_x": "99 - x", "r": "r", "g": "g", "b": "b"})
over_pixels("m10_skin_likelihood", {"chroma": r6(C.skin_chroma()), "skin": r6(C.skin())})
over_pixels("m11_sky_likelihood", {"chroma": r6(C.sky_chroma()), "prior": r6(C.sky_luma(C.luma())), "sky": r6(C.sky("(y / 1000e0)"))})
over_pixels("m12_position_prior", {"prior": r6(C.sky_position("((x - 10) / 80e0)"))})
over_pixels("m13_foliage_likelihood", {"foliage": r6(C.foliage())})
over_pixels("m14_overcast_priors", {"texture": r6(C.overcast_texture("(r / 4e0)")), "bright": r6(C.overcast_bright(C.luma())), "neutral": r6(C.overcast_neutral()), "overcast": r6(C.overcast("(r / 8e0)", "(y / 1000e0)"))})
over_pixels("m15_ghost_weight", {"plain": r6(C.ghost_weight("(r - g)", "(b / 16e0)")), "night": r6(C.ghost_weight("(r - g)", "(b / 16e0)", 4, 12))})
over_pixels("m16_motion_weight", {"weight": r6(C.motion_weight("(r / 10e0)", "(b / 32e0)"))})
over_pixels("m17_exposure_weight", {"weight": r6(C.exposure_weight("(x % 3 - 1)"))})
over_pixels("m18_highlight_bloom", rgb(lambda c: r6(f"{c} * {C.bloom_gain(180, 3, '(b / 255e0)')}")))
over_pixels("m19_shoulders", {"chroma": r6(C.chroma_shoulder("CAST(r AS DOUBLE)", "30e0", 18)), "rescue": r6(C.rescue_shoulder("(r * 2e0)"))})
over_pixels("m20_shadow_gain", {"gain": r6(C.shadow_gain("(r + 1e0)")), "protected": r6(C.rescue_gain("(r + 1e0)"))})
over_pixels("m21_coring", {"cored": r6(C.coring("((r - g) / 8e0)", "(b / 32e0)"))})
over_pixels("m22_parabola", {"vertex": r6(C.parabola("CAST(r AS DOUBLE)", "(g / 4e0)", "CAST(b AS DOUBLE)"))})
_UNIT = ("(r / 255e0)", "(g / 255e0)", "(b / 255e0)")
over_pixels("m23_cinematic_look", {c: r6(C.look(c, False, _UNIT)) for c in "rgb"})
over_pixels("m23_skin_safe_look", {c: r6(C.look(c, True, _UNIT)) for c in "rgb"})
over_pixels("m24_gamut_scale", {"scale": r6(f"least({C.gamut_scale(C.luma(), f'(r - {C.luma()})', f'(b - {C.luma()})')}, 1000e0)")})
over_pixels("s06_yuv_to_rgb", C.yuv_to_rgb("r", "g", "b"))
over_pixels("f02_neutral_probe", {"luma": r6(C.luma())}, C.mid_luma(0.10))
over_pixels("f09_region_of_interest", {"r": "r"}, "x >= 28 AND x < 100 AND y >= 4 AND y < 9")


def _tone(spark, sf_dir):
    return finish.tone_curve(raster.event_pixels(spark, sf_dir), 0.12, 0.12).select("y", "x", "r", "g", "b")


QUERIES["m05_tone_curve"] = _tone
ORACLE_SQL["m05_tone_curve"] = f"SELECT y, x, {', '.join(f'{C.tone(c, 0.12, 0.12)} AS {c}' for c in 'rgb')} FROM ({sql.EVENTS})"


def _vogel(spark, sf_dir):
    x, y = C.vogel("id", 24)
    return spark.range(24).select(F.col("id").alias("tap"), F.expr(r6(x)).alias("dx"), F.expr(r6(y)).alias("dy"))


QUERIES["m25_vogel_spiral"] = _vogel
ORACLE_SQL["m25_vogel_spiral"] = f"SELECT id AS tap, {r6(C.vogel('id', 24)[0])} AS dx, {r6(C.vogel('id', 24)[1])} AS dy FROM range(24) t(id)"

_W, _H = "(640 + event_id % 7000)", "(480 + event_id % 5000)"
over_events("m26_zoom", {"ratio": r6(X.zoom_ratio("(value / 50e0)", "(0.5e0 + (event_id % 30) / 10e0)", "1e0", "8e0")), "label": X.zoom_label("(value / 50e0)")})
over_events("m26_times", {"clock": X.clock("(event_id * 997)"), "duration": X.duration("(event_id * 7 % 5000)")})
over_events("m26_reticle", {"x": r6(X.reticle("value", "(event_id % 300 + 10e0)", 40.0))})
over_events("m27_labels", {
    "overlay": X.overlay("event_id % 2 = 0", "event_id % 3 = 0", "(CASE WHEN event_id % 5 = 0 THEN 'HLG' END)"),
    "both": X.both_labels("(CASE WHEN event_id % 2 = 0 THEN 'HLG' END)", "(CASE WHEN event_id % 3 = 0 THEN 'UHD' END)"),
    "chip": X.queue_chip("event_type", "(event_id % 4)"),
    "mime": X.mime("(CASE WHEN event_id % 4 = 0 THEN 'image/heic' END)", "event_type = 'view'"),
})
_INDEX = X.exposure_index("(event_id % 5 - 2e0)", "(event_id % 4)", "6", "-9", "9")
over_events("m28_exposure_plan", {"step": f"CAST({_INDEX} AS INT)", "reachable": X.exposure_reachable("(event_id % 5 - 2e0)", f"({_INDEX})", "(event_id % 4)", "6")})
over_events("s03_sample_size", {"burst": X.sample_size(_W, _H), "preview": X.preview_size(_W, _H, 1080, 1080)})
over_events("s04_burst_budget", {"pixels": X.burst_pixels("(event_id % 1024)", "(event_id % 13)")})
over_events("s05_rotation", {"swaps": X.swaps_sides("((event_id % 9 - 4) * 90)")})
over_events("s14_settings", {
    "frames": f"CAST({X.frame_count('event_id % 12')} AS BIGINT)",
    "preset": X.one_of("event_type", ("view", "click"), "Natural"),
})
over_events("f10_queue_admission", {"n": "event_id % 4"}, X.may_capture("(event_type = 'click')", "(event_id % 4)"))
over_events("f11_shutter_guard", {"k": "event_id % 30"}, X.shutter("(event_id % 30)", "(event_id % 2)", "event_type <> 'error'", "value > 50"))
_PIXELS = "(CAST(event_id AS BIGINT) * 1000)"
over_events("a24_rescue_memory", {"bytes": X.rescue_peak(_PIXELS, f"least({_PIXELS}, 2000000)"), "whole": X.whole_peak(_W, _H)})
over_events("a23_breakdown", {"text": X.breakdown({"capture": "(event_id % 3000)", "decode": "(event_id * 3 % 1700)", "save": "(event_id % 900)"})})

_FACTOR_SPARK = f"element_at(filter(sequence(1, 64), k -> floor({_W} / CAST(k AS DOUBLE)) * floor({_H} / CAST(k AS DOUBLE)) <= 1000000), 1)"
_FACTOR_DUCK = f"list_filter(range(1, 65), lambda k: floor({_W} / CAST(k AS DOUBLE)) * floor({_H} / CAST(k AS DOUBLE)) <= 1000000)[1]"


def _tiled_memory(spark, sf_dir):
    rows = raster.read(spark, sf_dir, "events").withColumn("k", F.expr(_FACTOR_SPARK))
    return rows.select("event_id", F.col("k").cast("long").alias("factor"), F.expr(X.tiled_peak(_W, _H, "k")).alias("bytes"))


QUERIES["a24_tiled_memory"] = _tiled_memory
ORACLE_SQL["a24_tiled_memory"] = f"SELECT event_id, CAST(k AS BIGINT) AS factor, {X.tiled_peak(_W, _H, 'k')} AS bytes FROM (SELECT *, {_FACTOR_DUCK} AS k FROM events)"


def _naming(spark, sf_dir):
    rows = raster.read(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    millis = F.lpad(F.date_format("ts", "SSS"), 3, "0")
    return rows.select("event_id", F.concat(F.lit("IMG_"), stamp, millis, F.lit(".jpg")).alias("name"))


QUERIES["s12_media_naming"] = _naming
ORACLE_SQL["s12_media_naming"] = "SELECT event_id, 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S') || strftime(ts, '%g') || '.jpg' AS name FROM events"


def exif(ts, width, height):
    """The seven attributes of a picture as a map."""
    when = F.date_format(ts, "yyyy:MM:dd HH:mm:ss")
    parts = {
        "DateTime": when, "DateTimeOriginal": when, "DateTimeDigitized": when, "Orientation": F.lit("1"),
        "PixelXDimension": width.cast("string"), "PixelYDimension": height.cast("string"), "Software": F.lit("prismgrid"),
    }
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])


def _exif(spark, sf_dir):
    rows = raster.read(spark, sf_dir, "events").withColumn("m", exif("ts", F.col("event_id"), F.col("user_id")))
    return rows.select("event_id", F.explode("m").alias("tag", "text"))


QUERIES["s11_exif"] = _exif
_WHEN = "strftime(ts, '%Y:%m:%d %H:%M:%S')"
ORACLE_SQL["s11_exif"] = " UNION ALL ".join(
    f"SELECT event_id, '{t}' AS tag, {e} AS text FROM events"
    for t, e in (
        ("DateTime", _WHEN), ("DateTimeOriginal", _WHEN), ("DateTimeDigitized", _WHEN), ("Orientation", "'1'"),
        ("PixelXDimension", "CAST(event_id AS VARCHAR)"), ("PixelYDimension", "CAST(user_id AS VARCHAR)"), ("Software", "'prismgrid'"),
    )
)


def _quality_choice(spark, sf_dir):
    """Nearest supported quality: itself, else the next below, else the next above."""
    rows = raster.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("want"), (F.col("event_id") % 16).alias("set"))
    choices = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda q: F.shiftright(F.col("set"), 0).bitwiseAND(F.pow(F.lit(2), q).cast("long")) > 0)
    below = F.array_max(F.filter("s", lambda q: q <= F.col("want")))
    above = F.array_min(F.filter("s", lambda q: q > F.col("want")))
    return rows.withColumn("s", choices).select("event_id", F.coalesce(below, above, F.col("want")).cast("long").alias("quality"))


QUERIES["m28_quality_choice"] = _quality_choice
ORACLE_SQL["m28_quality_choice"] = """
SELECT e.event_id, CAST(coalesce(max(q.q) FILTER (q.q <= e.event_id % 4), min(q.q) FILTER (q.q > e.event_id % 4), e.event_id % 4) AS BIGINT) AS quality
FROM events e LEFT JOIN range(4) q(q) ON ((e.event_id % 16) >> q.q) & 1 = 1 GROUP BY e.event_id"""

for _name in ("edges", "gradients", "highcontrast", "colorchart"):
    QUERIES[f"s16_scene_{_name}"] = lambda spark, sf_dir, n=_name: scenes.chart_pixels(spark, n)
    _px = "(SELECT CAST(i // 128 AS INT) AS y, CAST(i % 128 AS INT) AS x FROM range(16384) t(i))"
    ORACLE_SQL[f"s16_scene_{_name}"] = (
        f"SELECT CAST(0 AS BIGINT) AS frame_id, y, x, {', '.join(f'{e} AS {c}' for c, e in scenes.chart_sql(_name).items())} FROM {_px}"
    )


def _lcg(spark, sf_dir):
    return spark.range(1, 1001).select(F.col("id").alias("n"), F.expr(scenes.state_sql("12648430", "id")).alias("state"))


QUERIES["s18_generator_jump"] = _lcg
ORACLE_SQL["s18_generator_jump"] = """
WITH RECURSIVE g(n, state) AS (SELECT CAST(0 AS BIGINT), CAST(12648430 AS BIGINT) UNION ALL
 SELECT n + 1, (state * 1664525 + 1013904223) % 4294967296 FROM g WHERE n < 1000) SELECT n, state FROM g WHERE n > 0"""


def _noise(spark, sf_dir):
    return scenes.noise_pixels(scenes.chart_pixels(spark, "colorchart"), 0xC0FFEE, scenes.SIZE)


QUERIES["s19_sensor_noise"] = _noise


def _lattice(spark, sf_dir):
    return scenes.pixels(spark, [scenes.gray(scenes.lattice(0x7E57, 4)), scenes.clean("lowlight")])


QUERIES["s17_texture_lattice"] = _lattice


def _bursts(spark, sf_dir):
    return scenes.pixels(spark, scenes.burst(scenes.clean("colorchart"), 1, 3))


QUERIES["s20_burst"] = _bursts


def _all_scenes(spark, sf_dir):
    """One row per scene fixture: its size and the sums of its channels."""
    frames = {
        **{n: scenes.clean(n) for n in scenes.NAMES}, "hdr": scenes.hdr_truth(), "night": scenes.night(), "night_motion": scenes.night(0),
        "chart": scenes.resolution_truth(), "warped": scenes.warped_burst(1, 2)[1], "moved": scenes.moved_block_burst(1, 2)[1],
        "skin": scenes.skin_chart(), "backlit": scenes.backlit_portrait(), "rolloff": scenes.rolloff_portrait(),
        "landscape": scenes.landscape_burst(1, 1)[0], "overcast": scenes.overcast_burst(1, 1)[0],
        "benchmark": scenes.benchmark_scene(160, 120, 1), "disc": scenes.disc_scene(160, 120)[0],
    }
    px = scenes.pixels(spark, list(frames.values()), scene=list(frames))
    return px.groupBy("scene").agg(F.count(F.lit(1)).alias("pixels"), *[F.sum(c).alias(f"sum_{c}") for c in "rgb"])


QUERIES["s16_scene_fixtures"] = _all_scenes


def _atlas(spark, sf_dir):
    """A lookup table's texture layout: x = blue * size + red, y = green; bytes of the grading."""
    n = 17
    grid = spark.range(n**3).select(*[F.expr(f"CAST(floor(id / {float(n**k)}e0) AS INT) % {n}").alias(f"{c}i") for k, c in enumerate("rgb")])
    unit = tuple(f"({c}i / 16e0)" for c in "rgb")
    return grid.select((F.col("bi") * n + F.col("ri")).alias("x"), F.col("gi").alias("y"), *[F.expr(C.code(f"255e0 * {C.look(c, True, unit)}")).alias(c) for c in "rgb"])


QUERIES["s23_look_atlas"] = _atlas
_U17 = tuple(f"({c}i / 16e0)" for c in "rgb")
ORACLE_SQL["s23_look_atlas"] = (
    "SELECT bi * 17 + ri AS x, gi AS y, " + ", ".join(f"{C.code(f'255e0 * {C.look(c, True, _U17)}')} AS {c}" for c in "rgb")
    + " FROM (SELECT CAST(i % 17 AS INT) AS ri, CAST(i // 17 % 17 AS INT) AS gi, CAST(i // 289 AS INT) AS bi FROM range(4913) t(i))"
)

_DISC = kernels.bokeh_params(2000)
