"""Statistics and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.catalog import sql
from prismgrid.functions import color as C
from prismgrid.operators import finish, merge, stats
from prismgrid.operators import neighborhood as N
from prismgrid.sources import raster

QUERIES, ORACLE_SQL = {}, {}
_R = lambda *names: [F.round(n, 6).alias(n) for n in names]


def bag(spark, sf_dir):
    """``lineitem`` as one frame of colours without places."""
    return raster.line_pixels(spark, sf_dir).withColumn("frame_id", F.lit(0).cast("long"))


BAG = f"SELECT CAST(0 AS BIGINT) AS frame_id, r, g, b FROM ({sql.LINES})"


def cues(spark, sf_dir):
    """The three cues of the white balance, one row each."""
    px = stats.colours(bag(spark, sf_dir))
    parts = (("gray", stats.gray_cue(px)), ("highlight", stats.highlight_cue(px)), ("probe", stats.probe_cue(px)))
    rows = [c.select(F.lit(n).alias("cue"), *_R("r", "g", "b"), "n") for n, c in parts]
    return rows[0].union(rows[1]).union(rows[2])


def trimmed_sql(src: str, value: str, share: float) -> str:
    """Trimmed mean of a value in one row ``m``: sort, drop a share at either end."""
    return f"""(SELECT avg(v) AS m FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS n FROM {src})
 WHERE i >= floor(n * {C.num(share)}) AND i < n - floor(n * {C.num(share)}))"""


def cue_ctes(px: str) -> str:
    """CTEs gray, band, probe over a relation ``px(r, g, b)``."""
    milli = C.luma_milli()
    rank = lambda p: f"CAST(floor(round({C.num(p)} * (n - 1), 9) + 0.5e0) AS BIGINT)"
    return f"""gray AS (SELECT * FROM {px} WHERE {C.mid_luma(0.6)}), probe AS (SELECT * FROM {px} WHERE {C.mid_luma(0.10)}),
ranked AS (SELECT {milli} AS mv, row_number() OVER (ORDER BY {milli}) - 1 AS i, count(*) OVER () AS n FROM {px}),
marks AS (SELECT max(mv) FILTER (i = {rank(0.90)}) AS lo, max(mv) FILTER (i = {rank(0.99)}) AS hi FROM ranked),
band AS (SELECT r, g, b FROM {px} CROSS JOIN marks WHERE {milli} BETWEEN lo AND hi AND {C.unclipped()}),
gray_cue AS (SELECT {', '.join(f'{trimmed_sql("gray", c, 0.1)} AS {c}' for c in 'rgb')}, (SELECT count(*) FROM gray) AS n),
high_cue AS (SELECT avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS n FROM band),
probe_cue AS (SELECT avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS n FROM probe)"""


QUERIES["a09_white_balance_cues"] = cues
ORACLE_SQL["a09_white_balance_cues"] = f"""WITH px AS ({BAG}), {cue_ctes('px')}
SELECT * FROM (SELECT 'gray' AS cue, {sql.rounded('r', 'g', 'b')}, n FROM gray_cue UNION ALL SELECT 'highlight', {sql.rounded('r', 'g', 'b')}, n FROM high_cue
UNION ALL SELECT 'probe', {sql.rounded('r', 'g', 'b')}, n FROM probe_cue) WHERE n > 0"""


def gains_query(px: str) -> str:
    """Gains over the cue CTEs of ``px``."""
    g = stats.gains_sql()
    named = ", ".join(f"coalesce({q}.{c}, 0) AS {p}_{c}" for p, q in (("gray", "gray_cue"), ("high", "high_cue"), ("probe", "probe_cue")) for c in ("r", "g", "b", "n"))
    return f"""SELECT {g['r']} AS gain_r, {g['b']} AS gain_b FROM (SELECT {named}, (SELECT count(*) FROM {px}) AS size FROM gray_cue, high_cue, probe_cue)"""


QUERIES["a10_white_balance_gains"] = lambda spark, sf_dir: stats.white_balance_gains(raster.event_pixels(spark, sf_dir)).select(*_R("gain_r", "gain_b"))
ORACLE_SQL["a10_white_balance_gains"] = f"WITH px AS ({sql.EVENTS}), {cue_ctes('px')} SELECT {sql.rounded('gain_r', 'gain_b')} FROM ({gains_query('px')})"

QUERIES["a11_backlit_detector"] = lambda spark, sf_dir: stats.backlit(bag(spark, sf_dir)).select(*_R("dark", "bright", "mid", "strength"))
_y = C.luma()
ORACLE_SQL["a11_backlit_detector"] = f"""SELECT {sql.rounded('dark', 'bright', 'mid')}, round({stats.backlit_strength()}, 6) AS strength FROM (SELECT
 avg(CASE WHEN {_y} >= 24e0 AND {_y} < 60e0 THEN 1e0 ELSE 0e0 END) AS dark, avg(CASE WHEN {_y} > 160e0 THEN 1e0 ELSE 0e0 END) AS bright,
 avg(CASE WHEN {_y} >= 70e0 AND {_y} <= 150e0 THEN 1e0 ELSE 0e0 END) AS mid FROM ({BAG}))"""


def gray_burst(spark, sf_dir):
    v = F.col("v").cast("int")
    return raster.embedding_burst(spark, sf_dir).select("frame_id", "y", "x", *[v.alias(c) for c in "rgb"])


GRAY_BURST = f"SELECT frame_id, y, x, CAST(v AS INT) AS r, CAST(v AS INT) AS g, CAST(v AS INT) AS b FROM ({sql.burst()})"

QUERIES["a06_trimmed_mean_luma"] = lambda spark, sf_dir: stats.trimmed_mean(
    stats.counts(gray_burst(spark, sf_dir), F.expr(C.luma())), 0.05, "mean", at_most_half=True
).select("frame_id", *_R("mean"))
ORACLE_SQL["a06_trimmed_mean_luma"] = f"""SELECT frame_id, round(avg(v), 6) AS mean FROM (SELECT frame_id, {_y} AS v, row_number() OVER (PARTITION BY frame_id ORDER BY {_y}) - 1 AS i,
 count(*) OVER (PARTITION BY frame_id) AS n FROM ({GRAY_BURST})) WHERE i >= floor(n * 0.05e0) AND i < n - floor(n * 0.05e0) GROUP BY frame_id"""

QUERIES["a12_brightness_gain"] = lambda spark, sf_dir: stats.brightness_gain(gray_burst(spark, sf_dir)).select("frame_id", *_R("gain"))
ORACLE_SQL["a12_brightness_gain"] = f"""WITH m AS (SELECT frame_id, avg(v) AS mean FROM (SELECT frame_id, {_y} AS v, row_number() OVER (PARTITION BY frame_id ORDER BY {_y}) - 1 AS i,
 count(*) OVER (PARTITION BY frame_id) AS n FROM ({GRAY_BURST})) WHERE i >= floor(n * 0.05e0) AND i < n - floor(n * 0.05e0) GROUP BY frame_id)
SELECT frame_id, round(CASE WHEN mean <= 0 THEN 1e0 ELSE least(greatest((SELECT mean FROM m WHERE frame_id = 0) / mean, 0.7e0), 1.4e0) END, 6) AS gain FROM m"""

QUERIES["a05_robust_sigma"] = lambda spark, sf_dir: stats.robust_sigma(
    raster.embedding_burst(spark, sf_dir).filter("x % 4 = 0 AND y % 4 = 0"), "v", "sigma"
).select("frame_id", *_R("sigma"))
ORACLE_SQL["a05_robust_sigma"] = f"""WITH p AS (SELECT * FROM ({sql.burst()}) WHERE x % 4 = 0 AND y % 4 = 0), m AS (SELECT frame_id, median(v) AS mid FROM p GROUP BY frame_id)
SELECT p.frame_id, round(greatest(1.4826e0 * median(abs(v - mid)), 1e0), 6) AS sigma FROM p JOIN m ON m.frame_id = p.frame_id GROUP BY p.frame_id"""

QUERIES["a07_histogram_trimmed_mean"] = lambda spark, sf_dir: stats.trimmed_mean(stats.counts(bag(spark, sf_dir), "r"), 0.1, "mean").select(*_R("mean"))
ORACLE_SQL["a07_histogram_trimmed_mean"] = f"SELECT round(m, 6) AS mean FROM {trimmed_sql(f'({BAG})', 'r', 0.1)}"


def ranks(spark, sf_dir):
    hist = stats.counts(bag(spark, sf_dir), F.expr(C.luma_milli()))
    low, high = stats.value_at_rank(hist, 0.90, "p90"), stats.value_at_rank(hist, 0.99, "p99")
    return low.join(high, "frame_id").select("p90", "p99")


QUERIES["a08_rank_percentiles"] = ranks
_rank = lambda p: f"CAST(floor(round({C.num(p)} * (n - 1), 9) + 0.5e0) AS BIGINT)"
ORACLE_SQL["a08_rank_percentiles"] = f"""SELECT max(v) FILTER (i = {_rank(0.9)}) AS p90, max(v) FILTER (i = {_rank(0.99)}) AS p99
FROM (SELECT {C.luma_milli()} AS v, row_number() OVER (ORDER BY {C.luma_milli()}) - 1 AS i, count(*) OVER () AS n FROM ({BAG}))"""

QUERIES["f01_gray_world_admission"] = lambda spark, sf_dir: bag(spark, sf_dir).groupBy(F.expr(C.mid_luma(0.6)).alias("admitted")).agg(F.count(F.lit(1)).alias("n"))
ORACLE_SQL["f01_gray_world_admission"] = f"SELECT {C.mid_luma(0.6)} AS admitted, count(*) AS n FROM ({BAG}) GROUP BY 1"


def band(spark, sf_dir):
    return stats.highlight_cue(stats.colours(bag(spark, sf_dir))).select("n")


QUERIES["f03_highlight_band"] = band
ORACLE_SQL["f03_highlight_band"] = f"WITH px AS ({BAG}), {cue_ctes('px')} SELECT n FROM high_cue"

QUERIES["f07_no_subject"] = lambda spark, sf_dir: stats.no_subject(
    raster.embedding_burst(spark, sf_dir).select("frame_id", (F.col("v") / 255.0 - 0.4).cast("float").alias("conf"))
)
ORACLE_SQL["f07_no_subject"] = f"""SELECT frame_id, avg(CASE WHEN CAST(v / 255e0 - 0.4e0 AS FLOAT) >= 0.5 THEN 1e0 ELSE 0e0 END) < 0.02e0 AS no_subject FROM ({sql.burst()}) GROUP BY frame_id"""

QUERIES["f08_decile_marks"] = lambda spark, sf_dir: stats.decile_marks(bag(spark, sf_dir)).select("dark", "bright")
ORACLE_SQL["f08_decile_marks"] = f"""SELECT max(v) FILTER (i = t - 1) AS dark, max(v) FILTER (i = n - t) AS bright FROM (SELECT *, greatest(CAST(floor(n * 0.1e0) AS BIGINT), 1) AS t FROM
 (SELECT {C.luma_int()} AS v, row_number() OVER (ORDER BY {C.luma_int()}) - 1 AS i, count(*) OVER () AS n FROM ({BAG})))"""


def pair(spark, sf_dir):
    """The colour frame and a graded version of it."""
    a = raster.event_pixels(spark, sf_dir)
    return finish.contrast(finish.saturate(a, 1.08), 1.05), a


PAIR = f"""a AS ({sql.EVENTS}), s AS (SELECT frame_id, y, x, {', '.join(f'{C.saturate(c, 1.08)} AS {c}' for c in 'rgb')} FROM a),
c AS (SELECT frame_id, y, x, {', '.join(f'{C.contrast(c, 1.05)} AS {c}' for c in 'rgb')} FROM s),
p AS (SELECT c.y, c.x, c.r, c.g, c.b, a.r AS r2, a.g AS g2, a.b AS b2 FROM c JOIN a ON a.y = c.y AND a.x = c.x)"""
_SE = " + ".join(f"(CAST({c} AS BIGINT) - {c}2) * ({c} - {c}2)" for c in "rgb")
_AE = " + ".join(f"abs({c} - {c}2)" for c in "rgb")

QUERIES["a18_psnr_mae"] = lambda spark, sf_dir: stats.psnr_mae(*pair(spark, sf_dir)).select(*_R("psnr", "mae"))
ORACLE_SQL["a18_psnr_mae"] = f"""WITH {PAIR} SELECT round(10e0 * log10(65025e0 / (sum({_SE}) / (3e0 * count(*)))), 6) AS psnr, round(sum({_AE}) / (3e0 * count(*)), 6) AS mae FROM p"""

QUERIES["a18_masked_mae"] = lambda spark, sf_dir: stats.masked_mae(*pair(spark, sf_dir), C.luma_int("r2", "g2", "b2") + " <= 60").select(*_R("mae"))
ORACLE_SQL["a18_masked_mae"] = f"WITH {PAIR} SELECT round(sum({_AE}) / (3e0 * count(*)), 6) AS mae FROM p WHERE {C.luma_int('r2', 'g2', 'b2')} <= 60"

_SSIM = f"""w AS (SELECT p.*, {C.luma()} AS u, {C.luma('r2', 'g2', 'b2')} AS v FROM p), z AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM p),
k AS (SELECT 4 * i AS y0, 4 * j AS x0 FROM range(300) a(i) CROSS JOIN range(30) b(j) CROSS JOIN z WHERE 4 * i + 8 <= h AND 4 * j + 8 <= w),
m AS (SELECT avg(u) AS mu, avg(v) AS mv, avg(u * u) AS uu, avg(v * v) AS vv, avg(u * v) AS uv FROM k JOIN w ON w.y >= y0 AND w.y < y0 + 8 AND w.x >= x0 AND w.x < x0 + 8 GROUP BY y0, x0)"""
QUERIES["a19_ssim"] = lambda spark, sf_dir: stats.ssim(*pair(spark, sf_dir)).select(*_R("ssim"))
ORACLE_SQL["a19_ssim"] = f"WITH {PAIR}, {_SSIM} SELECT round(avg({stats.ssim_sql()}), 6) AS ssim FROM m"

QUERIES["a21_compare_metrics"] = lambda spark, sf_dir: stats.compare(*pair(spark, sf_dir)).select(*_R("psnr", "ssim", "mae"))
ORACLE_SQL["a21_compare_metrics"] = f"""WITH {PAIR}, {_SSIM} SELECT round(10e0 * log10(65025e0 / (sum({_SE}) / (3e0 * count(*)))), 6) AS psnr,
 (SELECT round(avg({stats.ssim_sql()}), 6) FROM m) AS ssim, round(sum({_AE}) / (3e0 * count(*)), 6) AS mae FROM p"""

QUERIES["a20_frequency_amplitude"] = lambda spark, sf_dir: stats.amplitude(raster.embedding_plane(spark, sf_dir), 8 / 3, "v").select(*_R("amplitude"))
_ph = f"{C.num(2 * 3.141592653589793)} * x / {C.num(8 / 3)}"
ORACLE_SQL["a20_frequency_amplitude"] = f"""SELECT round(2e0 * sqrt(sum(v * cos({_ph})) * sum(v * cos({_ph})) + sum(v * sin({_ph})) * sum(v * sin({_ph}))) / count(*), 6) AS amplitude FROM ({sql.EMBEDDINGS})"""

for _keep in (False, True):
    _n = f"a17_block_mean_{'ceil' if _keep else 'floor'}"
    QUERIES[_n] = lambda spark, sf_dir, k=_keep: N.block_mean(raster.event_pixels(spark, sf_dir), ["r", "g", "b"], 3, k).select("y", "x", *_R("r", "g", "b"))
    _cut = "" if _keep else "WHERE x < mx // 3 * 3 AND y < my // 3 * 3"
    ORACLE_SQL[_n] = f"""SELECT CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b
FROM (SELECT *, max(x) OVER () + 1 AS mx, max(y) OVER () + 1 AS my FROM ({sql.EVENTS})) {_cut} GROUP BY 1, 2"""


def ev_burst(spark, sf_dir):
    """The grey burst with exposures -2, 0, 2 in turn."""
    return gray_burst(spark, sf_dir).withColumn("ev", (F.col("frame_id") % 3 * 2 - 2).cast("double"))


EV_BURST = f"SELECT *, CAST(frame_id % 3 * 2 - 2 AS DOUBLE) AS ev FROM ({GRAY_BURST})"

QUERIES["a15_reference_exposure"] = lambda spark, sf_dir: merge.pick_reference_ev(ev_burst(spark, sf_dir))
ORACLE_SQL["a15_reference_exposure"] = f"SELECT ev FROM (SELECT DISTINCT ev FROM ({EV_BURST})) ORDER BY abs(ev), ev LIMIT 1"

QUERIES["a16_exposure_weights"] = lambda spark, sf_dir: merge.exposure_weights(ev_burst(spark, sf_dir)).select("frame_id", "y", "x", *_R("weight"))
WEIGHTED = f"""SELECT *, CASE WHEN sum(raw_) OVER (PARTITION BY y, x) <= 1e-6 THEN 1e0 / count(*) OVER (PARTITION BY y, x) ELSE raw_ / sum(raw_) OVER (PARTITION BY y, x) END AS weight
FROM (SELECT *, pow({C.exposure_weight('ev')}, 0.7e0) AS raw_ FROM ({EV_BURST}))"""
ORACLE_SQL["a16_exposure_weights"] = f"SELECT frame_id, y, x, {sql.rounded('weight')} FROM ({WEIGHTED})"

QUERIES["c08_exposure_fusion"] = lambda spark, sf_dir: merge.fuse_plain(ev_burst(spark, sf_dir))
_q = sql.Steps(EV_BURST)
_q.box({"wt": C.exposure_weight("ev")}, 8)
_mean = lambda c: C.code(f"sum((wt + 1e-6) * {c}) / sum(wt + 1e-6)")
ORACLE_SQL["c08_exposure_fusion"] = _q.done(f"SELECT y, x, {', '.join(f'{_mean(c)} AS {c}' for c in 'rgb')} FROM @ GROUP BY y, x")


def spans(spark, sf_dir):
    """Capture spans per user: sums and the first frame's time."""
    rows = raster.read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 900).alias("c"), (F.col("event_id") % 70).alias("d"))
    first = F.min(F.struct("event_id", (F.col("c") + F.col("d")).alias("ms")))["ms"]
    return rows.groupBy("user_id").agg(F.sum("c").alias("capture_ms"), F.sum("d").alias("decode_ms"), first.alias("first_frame_ms"), F.sum(F.col("c") + F.col("d")).alias("total_ms"))


QUERIES["a23_capture_spans"] = spans
ORACLE_SQL["a23_capture_spans"] = """SELECT user_id, CAST(sum(event_id % 900) AS BIGINT) AS capture_ms, CAST(sum(event_id % 70) AS BIGINT) AS decode_ms,
arg_min(event_id % 900 + event_id % 70, event_id) AS first_frame_ms, CAST(sum(event_id % 900 + event_id % 70) AS BIGINT) AS total_ms FROM events GROUP BY user_id"""

QUERIES["o02_distinct_exposures"] = lambda spark, sf_dir: ev_burst(spark, sf_dir).select("ev").distinct().orderBy("ev")
ORACLE_SQL["o02_distinct_exposures"] = f"SELECT DISTINCT ev FROM ({EV_BURST}) ORDER BY ev"

QUERIES["o03_top_one"] = lambda spark, sf_dir: raster.read(spark, sf_dir, "events").groupBy("event_type").agg(F.min(F.struct("value", "event_id"))["event_id"].alias("event_id"))
ORACLE_SQL["o03_top_one"] = "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i FROM events) WHERE i = 1"


def supported(spark, sf_dir):
    """Choices that a device supports, kept in order of the choices."""
    events = raster.read(spark, sf_dir, "events")
    devices = events.filter("event_type = 'purchase'").select("user_id").distinct()
    return events.join(devices, "user_id", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES["o04_set_membership"] = supported
ORACLE_SQL["o04_set_membership"] = "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY event_type"

QUERIES["o01_median"] = lambda spark, sf_dir: raster.read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))
ORACLE_SQL["o01_median"] = "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type"
