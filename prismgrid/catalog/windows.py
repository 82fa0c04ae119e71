"""Neighbourhood queries with their SQL: box means, extremes, guided filters, pyramids, upsampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismgrid.catalog import sql
from prismgrid.functions import color as C
from prismgrid.operators import finish, merge
from prismgrid.operators import neighborhood as N
from prismgrid.sources import raster

QUERIES, ORACLE_SQL = {}, {}
_R = lambda *names: [F.round(n, 6).alias(n) for n in names]


def plane(spark, sf_dir):
    return raster.embedding_plane(spark, sf_dir)


def box_blur_row_error(spark, sf_dir):
    """Mean absolute distance of each row from its blurred self."""
    p = N.box_mean(plane(spark, sf_dir), {"m": "v"}, 2)
    return p.groupBy("y").agg(F.round(F.avg(F.abs(F.col("v") - F.col("m"))), 6).alias("error"))


QUERIES["box_blur_row_error"] = box_blur_row_error
_q = sql.Steps(sql.EMBEDDINGS)
_q.box({"m": "v"}, 2)
ORACLE_SQL["box_blur_row_error"] = _q.done("SELECT y, round(avg(abs(v - m)), 6) AS error FROM @ GROUP BY y")

for _r in (3, 24):
    QUERIES[f"w01_box_blur_{_r}"] = lambda spark, sf_dir, r=_r: N.box_mean(plane(spark, sf_dir), {"m": "v"}, r).select("y", "x", *_R("m"))
    _q = sql.Steps(sql.EMBEDDINGS)
    _q.box({"m": "v"}, _r)
    ORACLE_SQL[f"w01_box_blur_{_r}"] = _q.done(f"SELECT y, x, {sql.rounded('m')} FROM @")

QUERIES["w02_dilate"] = lambda spark, sf_dir: N.extreme(plane(spark, sf_dir), {"m": "v"}, 5).select("y", "x", "m")
_q = sql.Steps(sql.EMBEDDINGS)
_q.extreme({"m": "v"}, 5)
ORACLE_SQL["w02_dilate"] = _q.done("SELECT y, x, m FROM @")

QUERIES["w03_erode_dilate_3x3"] = lambda spark, sf_dir: N.extreme(N.extreme(plane(spark, sf_dir), {"lo": "v"}, 1, False), {"hi": "v"}, 1).select("y", "x", "lo", "hi")
_q = sql.Steps(sql.EMBEDDINGS)
_q.extreme({"lo": "v"}, 1, "min")
_q.extreme({"hi": "v"}, 1)
ORACLE_SQL["w03_erode_dilate_3x3"] = _q.done("SELECT y, x, lo, hi FROM @")

QUERIES["w04_self_guided"] = lambda spark, sf_dir: N.guided(plane(spark, sf_dir), {"q": "v"}, "v", 4, finish.EPS_FINE).select("y", "x", *_R("q"))
_q = sql.Steps(sql.EMBEDDINGS)
_q.guided({"q": "v"}, "v", 4, finish.EPS_FINE)
ORACLE_SQL["w04_self_guided"] = _q.done(f"SELECT y, x, {sql.rounded('q')} FROM @")

QUERIES["w05_guided"] = lambda spark, sf_dir: N.guided(
    raster.event_pixels(spark, sf_dir).withColumn("l", F.expr(C.luma())), {"qb": "b", "qr": "r"}, "l", 4, finish.EPS_FINE
).select("y", "x", *_R("qb", "qr"))
_q = sql.Steps(sql.EVENTS)
_q.plus({"l": C.luma()})
_q.guided({"qb": "b", "qr": "r"}, "l", 4, finish.EPS_FINE)
ORACLE_SQL["w05_guided"] = _q.done(f"SELECT y, x, {sql.rounded('qb', 'qr')} FROM @")

QUERIES["w06_detail_energy"] = lambda spark, sf_dir: N.local_variance(plane(spark, sf_dir), "v", "e", 12).select("y", "x", *_R("e"))
_q = sql.Steps(sql.EMBEDDINGS)
_q.box({"m": "v"}, 12)
_q.box({"e": "(v - m) * (v - m)"}, 12)
ORACLE_SQL["w06_detail_energy"] = _q.done(f"SELECT y, x, {sql.rounded('e')} FROM @")


def masks(spark, sf_dir):
    """The four region masks of a frame."""
    px = raster.event_pixels(spark, sf_dir)
    size = px.groupBy("frame_id").agg((F.max("y") + 1).alias("h"))
    px = finish.scene_masks(finish.skin_mask(px).join(F.broadcast(size), "frame_id"))
    return px.select("y", "x", *_R("skin", "sky", "overcast", "foliage"))


QUERIES["c19_region_masks"] = masks


def mask_steps(q: sql.Steps) -> None:
    """Adds the scene masks to the last step, as the operator does."""
    at = "(y / CAST(h_ AS DOUBLE))"
    q.plus({"h_": "max(y) OVER (PARTITION BY frame_id) + 1", "y_": C.luma()})
    q.box({"mean_": "y_"}, 12)
    q.box({"energy_": "(y_ - mean_) * (y_ - mean_)"}, 12)
    q.box({"sky": C.sky(at), "overcast": C.overcast("energy_", at), "foliage": C.foliage()}, 12)
    q.replace({n: C.clamp(n, 0, 1) for n in ("sky", "overcast", "foliage")})
    q.drop("h_", "y_", "mean_", "energy_")


_q = sql.Steps(sql.EVENTS)
_q.box({"skin": C.skin()}, 8)
_q.replace({"skin": C.clamp("skin", 0, 1)})
mask_steps(_q)
ORACLE_SQL["c19_region_masks"] = _q.done(f"SELECT y, x, {sql.rounded('skin', 'sky', 'overcast', 'foliage')} FROM @")


def low_pass(spark, sf_dir):
    """Luma at the two low-pass radii of the gates, one as whole codes."""
    p = N.box_mean(merge.luma_plane(raster.event_pixels(spark, sf_dir)), {"soft": "v"}, 3)
    p = N.box_mean(p, {"fine": "v"}, 2)
    return p.select("y", "x", F.round("soft", 6).alias("soft"), F.expr(C.whole("fine")).alias("fine"))


QUERIES["w08_low_pass_luma"] = low_pass
_q = sql.Steps(f"SELECT frame_id, y, x, CAST({C.luma_int()} AS DOUBLE) AS v FROM ({sql.EVENTS})")
_q.box({"soft": "v"}, 3)
_q.box({"fine": "v"}, 2)
ORACLE_SQL["w08_low_pass_luma"] = _q.done(f"SELECT y, x, {sql.rounded('soft')}, {C.whole('fine')} AS fine FROM @")

_SIZE = """(SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM {src})"""
_TAPS = "(SELECT unnest([-2, -1, 0, 1, 2]) AS t, unnest([1e0, 4e0, 6e0, 4e0, 1e0]) AS k)"


def down_sql(src: str) -> str:
    """Half size by clamped taps, along x and then along y."""
    mid = f"""SELECT o.y, o.ox AS x, sum(k * s.v) / 16e0 AS v FROM (SELECT DISTINCT y, x // 2 AS ox FROM {src} WHERE x % 2 = 0) o
      CROSS JOIN {_TAPS} CROSS JOIN {_SIZE.format(src=src)} z JOIN {src} s ON s.y = o.y AND s.x = least(greatest(2 * o.ox + t, 0), z.w - 1) GROUP BY o.y, o.ox"""
    return f"""SELECT o.oy AS y, o.x, sum(k * s.v) / 16e0 AS v FROM (SELECT DISTINCT x, y // 2 AS oy FROM {src} WHERE y % 2 = 0 AND x % 2 = 0) p
      CROSS JOIN (SELECT 1) d JOIN (SELECT DISTINCT x // 2 AS x, y // 2 AS oy FROM {src} WHERE y % 2 = 0 AND x % 2 = 0) o ON o.x = p.x // 2 AND o.oy = p.oy
      CROSS JOIN {_TAPS} CROSS JOIN {_SIZE.format(src=src)} z JOIN ({mid}) s ON s.x = o.x AND s.y = least(greatest(2 * o.oy + t, 0), z.h - 1) GROUP BY o.oy, o.x"""


def up_sql(src: str, fine: str) -> str:
    """Twice the size: taps of even distance, along x and then along y, at the places of ``fine``."""
    mid = f"""SELECT s0.y, d.x, sum(2e0 * k * s.v) / 16e0 AS v FROM (SELECT DISTINCT y FROM {src}) s0 CROSS JOIN (SELECT DISTINCT x FROM {fine}) d CROSS JOIN {_TAPS}
      CROSS JOIN {_SIZE.format(src=src)} z JOIN {src} s ON s.y = s0.y AND (d.x - t) % 2 = 0 AND s.x = least(greatest(CAST(floor((d.x - t) / 2e0) AS INT), 0), z.w - 1) GROUP BY s0.y, d.x"""
    return f"""SELECT d.y, s.x, sum(2e0 * k * s.v) / 16e0 AS v FROM (SELECT DISTINCT y FROM {fine}) d CROSS JOIN {_TAPS} CROSS JOIN {_SIZE.format(src=src)} z
      JOIN ({mid}) s ON (d.y - t) % 2 = 0 AND s.y = least(greatest(CAST(floor((d.y - t) / 2e0) AS INT), 0), z.h - 1) GROUP BY d.y, s.x"""


QUERIES["w09_pyramid_down"] = lambda spark, sf_dir: N.pyramid_down(plane(spark, sf_dir)).select("y", "x", *_R("v"))
ORACLE_SQL["w09_pyramid_down"] = f"WITH e AS ({sql.EMBEDDINGS}), d AS ({down_sql('e')}) SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {sql.rounded('v')} FROM d"


def _band(spark, sf_dir):
    """The finest band: what half size loses."""
    p = plane(spark, sf_dir)
    size = raster.frame_size(p)
    up = N.pyramid_up(N.pyramid_down(p), size).withColumnRenamed("v", "u")
    return p.join(up, ["frame_id", "y", "x"]).select("y", "x", F.round(F.col("v") - F.col("u"), 6).alias("band"))


QUERIES["w10_laplacian_band"] = _band
ORACLE_SQL["w10_laplacian_band"] = f"""WITH e AS ({sql.EMBEDDINGS}), d AS ({down_sql('e')}), u AS ({up_sql('d', 'e')})
SELECT e.y, e.x, round(e.v - u.v, 6) AS band FROM e JOIN u ON u.y = e.y AND u.x = e.x"""


def _collapse(spark, sf_dir):
    """Bands built and collapsed again: the plane itself."""
    p = plane(spark, sf_dir)
    h = raster.read(spark, sf_dir, "embeddings").count()
    sizes = merge.levels((64, h))
    back = merge.collapse(merge.laplacian(merge.gaussian(p, (64, h)), sizes), sizes)
    return back.select("y", "x", *_R("v"))


QUERIES["w10_laplacian_collapse"] = _collapse
ORACLE_SQL["w10_laplacian_collapse"] = f"SELECT y, x, {sql.rounded('v')} FROM ({sql.EMBEDDINGS})"

QUERIES["w11_upsample2x"] = lambda spark, sf_dir: merge.upsample2x(raster.event_pixels(spark, sf_dir)).select("y", "x", "r", "g", "b")
_at = lambda c, j, i: f"p{j}{i}.{c}"
_mix = lambda c: C.code(
    f"({_at(c, 0, 0)} + ({_at(c, 0, 1)} - {_at(c, 0, 0)}) * fx) + (({_at(c, 1, 0)} + ({_at(c, 1, 1)} - {_at(c, 1, 0)}) * fx) - ({_at(c, 0, 0)} + ({_at(c, 0, 1)} - {_at(c, 0, 0)}) * fx)) * fy"
)
ORACLE_SQL["w11_upsample2x"] = f"""WITH e AS ({sql.EVENTS}), z AS (SELECT max(x) AS mx, max(y) AS my FROM e),
g AS (SELECT CAST(2 * e.y + j AS INT) AS y, CAST(2 * e.x + i AS INT) AS x, e.y AS y0, e.x AS x0, least(e.y + j, my) AS y1, least(e.x + i, mx) AS x1,
  CASE WHEN e.x + i <= mx THEN i / 2e0 ELSE 0e0 END AS fx, CASE WHEN e.y + j <= my THEN j / 2e0 ELSE 0e0 END AS fy FROM e CROSS JOIN z CROSS JOIN range(2) a(j) CROSS JOIN range(2) b(i))
SELECT g.y, g.x, {', '.join(f'{_mix(c)} AS {c}' for c in 'rgb')} FROM g
LEFT JOIN e p00 ON p00.y = y0 AND p00.x = x0 LEFT JOIN e p01 ON p01.y = y0 AND p01.x = x1 LEFT JOIN e p10 ON p10.y = y1 AND p10.x = x0 LEFT JOIN e p11 ON p11.y = y1 AND p11.x = x1"""


def _running(spark, sf_dir):
    from prismgrid.operators import stats

    return stats.running(stats.counts(plane(spark, sf_dir), "v")).select("v", "n", "upto", "total")


QUERIES["w12_running_histogram"] = _running
ORACLE_SQL["w12_running_histogram"] = f"""SELECT v, n, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS upto, CAST(sum(n) OVER () AS BIGINT) AS total
FROM (SELECT v, count(*) AS n FROM ({sql.EMBEDDINGS}) GROUP BY v)"""


def last_events(spark, sf_dir, keep: int = 3):
    """The last few events of each user, oldest first."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = raster.read(spark, sf_dir, "events").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= keep)
    return rows.select("user_id", "event_id", "back")


QUERIES["w13_last_n"] = last_events
ORACLE_SQL["w13_last_n"] = """SELECT user_id, event_id, CAST(back AS INT) AS back FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 3"""
