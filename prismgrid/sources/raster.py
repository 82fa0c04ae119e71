"""Rasters out of tables: the adapters that give every operator its pixels.

The canonical pixel table is ``frame_id, y, x, r, g, b`` (codes 0..255); a plane is ``frame_id, y,
x, v`` (double). ``i`` is never stored: (frame_id, y, x) is the key and coordinates are dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.functions import color

#: Ordinals of the event types in the colour raster; others count as 0.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_WIDTH = 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as one luma plane, 64 wide: ``frame_id, y, x, v`` with whole codes."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = color.code("128e0 + 400e0 * CAST(e AS DOUBLE)")
    return rows.select(
        F.lit(0).cast("long").alias("frame_id"),
        F.col("vec_id").cast("int").alias("y"),
        F.col("x").cast("int").alias("x"),
        F.expr(v).cast("double").alias("v"),
    )


def embedding_burst(spark: SparkSession, sf_dir: str, frames: int = 5) -> DataFrame:
    """``embeddings`` dealt in turn to ``frames`` frames: ``frame_id, y, x, v``."""
    plane = embedding_plane(spark, sf_dir)
    return plane.select(
        (F.col("y") % frames).cast("long").alias("frame_id"), F.expr(f"CAST(floor(y / {frames}e0) AS INT)").alias("y"), "x", "v"
    )


def shifted(plane: DataFrame, dx: int, dy: int) -> DataFrame:
    """The plane as frame 0 and, as frame 1, itself moved by (dx, dy) with repeated edges: a pixel
    of frame 1 shows what frame 0 has ``(dx, dy)`` before it."""
    size = plane.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    own = plane.select(F.lit(0).cast("long").alias("frame_id"), "y", "x", "v")
    target = plane.crossJoin(F.broadcast(size)).select(
        F.col("y").alias("ty"),
        F.col("x").alias("tx"),
        F.least(F.greatest(F.col("y") - dy, F.lit(0)), F.col("h") - 1).alias("y"),
        F.least(F.greatest(F.col("x") - dx, F.lit(0)), F.col("w") - 1).alias("x"),
    )
    moved = target.join(own.select("y", "x", "v"), ["y", "x"]).select(
        F.lit(1).cast("long").alias("frame_id"), F.col("ty").alias("y"), F.col("tx").alias("x"), "v"
    )
    return own.union(moved)


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one colour frame, 100 wide: value, type and id give red, green and blue."""
    kind = F.lit(0)
    for i, name in enumerate(EVENT_TYPES):
        kind = F.when(F.col("event_type") == name, i).otherwise(kind)
    rows = read(spark, sf_dir, "events").withColumn("kind", kind)
    return rows.select(
        F.lit(0).cast("long").alias("frame_id"),
        F.expr(f"CAST(floor(event_id / {EVENT_WIDTH}e0) AS INT)").alias("y"),
        (F.col("event_id") % EVENT_WIDTH).cast("int").alias("x"),
        F.expr(color.code("value / 490.02e0 * 255e0")).alias("r"),
        (51 * F.col("kind")).cast("int").alias("g"),
        (F.col("event_id") * 7919 % 256).cast("int").alias("b"),
    )


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a bag of colours ``r, g, b`` without places (its keys repeat)."""
    return read(spark, sf_dir, "lineitem").select(
        F.expr(color.code("5e0 * l_quantity")).alias("r"),
        F.expr(color.code("l_discount * 2550e0")).alias("g"),
        F.expr(color.code("l_tax * 3187.5e0")).alias("b"),
    )


def frame_size(px: DataFrame) -> DataFrame:
    """``frame_id, w, h`` of dense frames; one row per frame."""
    return px.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def pack(px: DataFrame) -> DataFrame:
    """Pixels as signed 32-bit ARGB; a missing alpha is opaque."""
    alpha = "a" if "a" in px.columns else "255"
    value = f"CAST(CASE WHEN {alpha} >= 128 THEN {alpha} - 256 ELSE {alpha} END * 16777216 + r * 65536 + g * 256 + b AS INT)"
    return px.withColumn("argb", F.expr(value))


def unpack(df: DataFrame, argb: str = "argb") -> DataFrame:
    """Channels of packed pixels."""
    bits = lambda n: F.shiftrightunsigned(F.col(argb), n).bitwiseAND(F.lit(255)).cast("int")
    return df.select("*", bits(24).alias("a"), bits(16).alias("r"), bits(8).alias("g"), bits(0).alias("b"))
