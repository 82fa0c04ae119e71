"""Source and sink round trips, and the metrics artefact."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.catalog import sql
from prismgrid.catalog.aggregates import PAIR, _AE, pair
from prismgrid.catalog.streams import folder
from prismgrid.operators import stats
from prismgrid.plans import blocks as B
from prismgrid.sources import images, raster

QUERIES, ORACLE_SQL = {}, {}


def through_files(spark, sf_dir):
    """The colour frame written as a picture table and read back."""
    path = f"{folder(spark)}/frames"
    images.save(B.from_pixels(raster.event_pixels(spark, sf_dir)), path)
    return B.to_pixels(spark.read.parquet(path)).select("y", "x", "r", "g", "b")


QUERIES["s10_picture_sink"] = through_files
ORACLE_SQL["s10_picture_sink"] = f"SELECT y, x, r, g, b FROM ({sql.EVENTS})"


def decoded(spark, sf_dir):
    """The colour frame as a pixmap file's bytes, decoded at half size by the sampling rule."""
    frames = B.from_pixels(raster.event_pixels(spark, sf_dir))
    files = B.map_frames(frames, lambda f: images.decode(images.to_ppm(f), most=max(1, f.shape[0] * f.shape[1] // 4)))
    return B.to_pixels(files).select("y", "x", "r", "g", "b")


QUERIES["s02_sampled_decode"] = decoded
ORACLE_SQL["s02_sampled_decode"] = f"""SELECT CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, r, g, b FROM (SELECT *, max(y) OVER () + 1 AS h, max(x) OVER () + 1 AS w FROM ({sql.EVENTS}))
WHERE y % 2 = 0 AND x % 2 = 0 AND y < h // 2 * 2 AND x < w // 2 * 2"""


def metrics_json(spark, sf_dir):
    """A metrics row as JSON text with four decimals."""
    four = lambda c: F.format_string("%.4f", F.round(c, 4)).alias(c)
    return stats.psnr_mae(*pair(spark, sf_dir)).select(F.to_json(F.struct(four("mae"))).alias("json"))


QUERIES["s15_metrics_json"] = metrics_json
ORACLE_SQL["s15_metrics_json"] = f"""WITH {PAIR} SELECT '{{"mae":"' || printf('%.4f', round(sum({_AE}) / (3e0 * count(*)), 4)) || '"}}' AS json FROM p"""


def mask_source(spark, sf_dir):
    """A segmentation confidence plane as an external table: float buffers keep their order."""
    rows = raster.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "conf"))
    return rows.select(F.col("vec_id").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.round(F.col("conf").cast("double"), 6).alias("conf"))


QUERIES["s09_mask_source"] = mask_source
ORACLE_SQL["s09_mask_source"] = """SELECT CAST(vec_id AS INT) AS y, CAST(x AS INT) AS x, round(CAST(e AS DOUBLE), 6) AS conf FROM (SELECT vec_id, unnest(range(64)) AS x, unnest(embedding) AS e FROM embeddings)"""
