"""Merging of bursts and exposures over pixel rows.

A burst is a pixel table whose frame 0 is the reference. Weighted sums are ``groupBy`` aggregates on
the pixel; what order they add in is rounded away before requantising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.functions import color
from prismgrid.operators import align as A
from prismgrid.operators import neighborhood as N
from prismgrid.operators import stats

#: Scales of the ghost rejection: plain bursts and night bursts.
PLAIN, NIGHT = (3.0, 8.0), (4.0, 12.0)


def luma_plane(px: DataFrame) -> DataFrame:
    """Integer luma as ``frame_id, y, x, v``."""
    return px.select("frame_id", "y", "x", F.expr(color.luma_int()).cast("double").alias("v"))


def normalize_brightness(px: DataFrame) -> DataFrame:
    """Bring every frame to the mean of frame 0 (codes; a gain of 1 changes nothing)."""
    gains = stats.brightness_gain(px).withColumn("gain", F.when(F.col("frame_id") == 0, F.lit(1.0)).otherwise(F.col("gain")))
    out = px.join(F.broadcast(gains), "frame_id")
    return out.withColumns({c: F.expr(color.gain(c, "gain")) for c in "rgb"}).drop("gain")


def merge_weights(px: DataFrame, tiles: DataFrame, scales: tuple[float, float] = PLAIN, night: bool = False) -> DataFrame:
    """``frame_id, y, x, r, g, b, weight``: every supporting frame on the reference grid with its weight.

    A pixel weighs by the smaller of two ghost weights, of its luma and of low-pass luma, and at
    night by how much its frame moves.
    """
    plane = N.box_mean(luma_plane(px), {"lp": "v"}, 3)
    ref = plane.filter("frame_id = 0").select("y", "x", F.col("v").alias("ref"), F.col("lp").alias("ref_lp"))
    grid = ref.select("y", "x").crossJoin(F.broadcast(tiles.select("frame_id").distinct()))
    at = A.offset_at(grid, tiles)
    at = at.withColumns({"sx": F.col("x") + F.col("ox"), "sy": F.col("y") + F.col("oy")}).select("frame_id", "y", "x", "sx", "sy")
    image = px.filter("frame_id > 0").join(plane.select("frame_id", "y", "x", "lp"), ["frame_id", "y", "x"])
    at = at.withColumnsRenamed({"y": "py", "x": "px"})
    got = N.sample(at, image, ["r", "g", "b", "lp"]).withColumnsRenamed({"py": "y", "px": "x"}).drop("sx", "sy")
    got = got.join(ref, ["y", "x"])
    got = got.withColumns({"d": F.expr(f"{color.luma()} - ref"), "d_lp": F.expr("lp - ref_lp")})
    some = got.filter("x % 4 = 0 AND y % 4 = 0").select("frame_id", "d", "d_lp")
    sigma = stats.robust_sigma(some, "d", "s").join(stats.robust_sigma(some, "d_lp", "s_lp"), "frame_id")
    if night:
        usual = sigma.agg(F.median("s").alias("usual"))
        sigma = sigma.crossJoin(F.broadcast(usual)).withColumn("own", F.expr(color.motion_weight("greatest(s - usual, 0e0)", "usual"))).drop("usual")
    else:
        sigma = sigma.withColumn("own", F.lit(1.0))
    got = got.join(F.broadcast(sigma), "frame_id")
    weight = f"own * least({color.ghost_weight('d', 's', *scales)}, {color.ghost_weight('d_lp', 's_lp', *scales)})"
    return got.select("frame_id", "y", "x", "r", "g", "b", F.expr(weight).alias("weight"))


def weighted_merge(reference: DataFrame, weighted: DataFrame, lone: bool = True) -> DataFrame:
    """Weighted mean with the reference at weight 1; unsupported pixels keep the reference. Pixels that
    ``weighted`` has no row for are left out unless ``lone``."""
    sums = weighted.groupBy("y", "x").agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(f"s{c}") for c in "rgb"], F.sum("weight").alias("sw")
    )
    both = reference.join(sums, ["y", "x"], "left" if lone else "inner").fillna(0.0, ["sr", "sg", "sb", "sw"])
    mean = lambda c: F.expr(f"CASE WHEN sw <= 1e-3 THEN {c} ELSE {color.code(f'({c} + s{c}) / (1e0 + sw)')} END").alias(c)
    return both.select("frame_id", "y", "x", *[mean(c) for c in "rgb"])


def merge_burst(px: DataFrame, size: tuple[int, int], night: bool = False) -> DataFrame:
    """A burst as one frame: align, refine by tiles, weigh, merge."""
    px = normalize_brightness(px) if night else px
    plane = luma_plane(px)
    alignment = A.align(plane, size)
    tiles = A.tile_offsets(plane, alignment)
    reference = px.filter("frame_id = 0").select("frame_id", "y", "x", "r", "g", "b")
    return weighted_merge(reference, merge_weights(px, tiles, NIGHT if night else PLAIN, night))


# --- exposures ----------------------------------------------------------------------------------


def exposure_weights(px: DataFrame, selectivity: float = 0.7) -> DataFrame:
    """``px`` (with ``ev``) with ``weight``, normalised over the frames of a pixel; equal shares if none counts."""
    raw = F.pow(F.expr(color.exposure_weight("ev")), F.lit(float(selectivity)))
    px = px.withColumn("_raw", raw)
    one = Window.partitionBy("y", "x")
    total, frames = F.sum("_raw").over(one), F.count(F.lit(1)).over(one)
    weight = F.when(total <= 1e-6, 1.0 / frames).otherwise(F.col("_raw") / total)
    return px.withColumn("weight", weight).drop("_raw")


def fuse_plain(px: DataFrame, radius: int = 8) -> DataFrame:
    """Exposures averaged with blurred weights: ``y, x, r, g, b``."""
    w = N.box_mean(px, {"weight": F.expr(color.exposure_weight("ev"))}, radius).withColumn("weight", F.col("weight") + 1e-6)
    sums = w.groupBy("y", "x").agg(*[(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c) for c in "rgb"])
    return sums.select("y", "x", *[F.expr(color.code(c)).alias(c) for c in "rgb"])


def levels(size: tuple[int, int], least: int = 8) -> list[tuple[int, int]]:
    """Sizes of a pyramid: halved, rounded up, while the smaller side keeps ``least``."""
    out = [size]
    while min((out[-1][0] + 1) // 2, (out[-1][1] + 1) // 2) >= least:
        out.append(((out[-1][0] + 1) // 2, (out[-1][1] + 1) // 2))
    return out


def _sized(plane: DataFrame, size: tuple[int, int]) -> DataFrame:
    return plane.select("frame_id").distinct().select("frame_id", F.lit(size[0]).alias("w"), F.lit(size[1]).alias("h"))


def gaussian(plane: DataFrame, size: tuple[int, int]) -> list[DataFrame]:
    out = [plane]
    for _ in levels(size)[1:]:
        out.append(N.pyramid_down(out[-1]))
    return out


def laplacian(pyramid: list[DataFrame], sizes: list[tuple[int, int]]) -> list[DataFrame]:
    """Each level less its coarser one brought up; the coarsest stays."""
    out = []
    for k, fine in enumerate(pyramid[:-1]):
        up = N.pyramid_up(pyramid[k + 1], _sized(pyramid[k + 1], sizes[k])).withColumnRenamed("v", "u")
        out.append(fine.join(up, ["frame_id", "y", "x"]).select("frame_id", "y", "x", (F.col("v") - F.col("u")).alias("v")))
    return [*out, pyramid[-1]]


def collapse(bands: list[DataFrame], sizes: list[tuple[int, int]]) -> DataFrame:
    cur = bands[-1]
    for k in range(len(bands) - 2, -1, -1):
        up = N.pyramid_up(cur, _sized(cur, sizes[k])).withColumnRenamed("v", "u")
        cur = bands[k].join(up, ["frame_id", "y", "x"]).select("frame_id", "y", "x", (F.col("v") + F.col("u")).alias("v"))
    return cur


def fuse_pyramid(px: DataFrame, size: tuple[int, int], selectivity: float = 0.7) -> DataFrame:
    """Exposures blended level by level: ``y, x, r, g, b`` from ``px(frame_id, ev, y, x, r, g, b)``.

    Frames and channels are one table keyed by ``4 frame_id + channel`` (0 is the weight), so each
    level costs the same exchanges whatever their number.
    """
    w = exposure_weights(px, selectivity)
    planes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(("weight", "r", "g", "b"))]))
    keyed = w.select("frame_id", "y", "x", planes.alias("p")).select((F.col("frame_id") * 4 + F.col("p.k")).alias("frame_id"), "y", "x", "p.v")
    sizes = levels(size)
    pyramid = gaussian(keyed, size)
    bands = laplacian([p.filter("frame_id % 4 > 0") for p in pyramid], sizes)
    fused = []
    for g, band in zip(pyramid, bands, strict=True):
        weight = g.filter("frame_id % 4 = 0").select(F.expr("CAST(frame_id / 4 AS BIGINT)").alias("f"), "y", "x", F.col("v").alias("wt"))
        own = band.select(F.expr("CAST(floor(frame_id / 4e0) AS BIGINT)").alias("f"), (F.col("frame_id") % 4).alias("frame_id"), "y", "x", "v")
        fused.append(own.join(weight, ["f", "y", "x"]).groupBy("frame_id", "y", "x").agg(F.sum(F.col("wt") * F.col("v")).alias("v")))
    flat = collapse(fused, sizes).groupBy("y", "x").agg(*[F.max(F.when(F.col("frame_id") == k, F.col("v"))).alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))])
    return flat.select("y", "x", *[F.expr(color.code(c)).alias(c) for c in "rgb"])


def pick_reference_ev(px: DataFrame) -> DataFrame:
    """``ev``: the exposure nearest 0, the lower one of two."""
    return px.select("ev").distinct().agg(F.min(F.struct(F.abs("ev").alias("far"), "ev")).alias("b")).select("b.ev")


# --- sampling, splatting, upscaling ----------------------------------------------------------------


def upsample2x(px: DataFrame) -> DataFrame:
    """Twice the size by linear interpolation at half places."""
    four = F.explode(F.expr("array(struct(0 AS j, 0 AS i), struct(0 AS j, 1 AS i), struct(1 AS j, 0 AS i), struct(1 AS j, 1 AS i))"))
    points = px.select("frame_id", "y", "x", four.alias("q")).select(
        "frame_id", (2 * F.col("y") + F.col("q.j")).alias("py"), (2 * F.col("x") + F.col("q.i")).alias("px")
    )
    points = points.withColumns({"sx": F.col("px") / 2.0, "sy": F.col("py") / 2.0})
    out = N.sample(points, px, ["r", "g", "b"])
    return out.select("frame_id", F.col("py").alias("y"), F.col("px").alias("x"), *[F.expr(color.code(c)).alias(c) for c in "rgb"])


def splat(points: DataFrame, width: int, height: int) -> DataFrame:
    """``y, x, sr, sg, sb, sw``: weighted colours of ``points(sx, sy, r, g, b, weight)`` spread on the
    four pixels around; what falls outside is dropped."""
    p = points.filter("weight > 0e0").withColumns({"x0": F.floor("sx").cast("int"), "y0": F.floor("sy").cast("int")})
    p = p.withColumns({"fx": F.col("sx") - F.col("x0"), "fy": F.col("sy") - F.col("y0")})
    taps = [
        f"struct(y0 + {j} AS y, x0 + {i} AS x, ({'fx' if i else '1e0 - fx'}) * ({'fy' if j else '1e0 - fy'}) AS k)" for j in (0, 1) for i in (0, 1)
    ]
    at = p.withColumn("t", F.explode(F.expr(f"array({', '.join(taps)})"))).select("t.y", "t.x", (F.col("weight") * F.col("t.k")).alias("w"), "r", "g", "b")
    at = at.filter(f"w > 0e0 AND x >= 0 AND y >= 0 AND x < {width} AND y < {height}")
    return at.groupBy("y", "x").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "rgb"], F.sum("w").alias("sw"))


def cover(splatted: DataFrame, fallback: DataFrame, least: float = 1e-3) -> DataFrame:
    """Normalised splats where they cover, the fallback ``y, x, r, g, b`` elsewhere."""
    both = fallback.join(splatted, ["y", "x"], "left")
    pick = lambda c: F.expr(f"CASE WHEN sw > {color.num(least)} THEN {color.code(f's{c} / sw')} ELSE {c} END").alias(c)
    return both.select("y", "x", *[pick(c) for c in "rgb"])


def reference_place(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Where frame pixels lie on the reference: the offset field is read at the reference, so one
    fixed-point step goes from the frame's place to it. Adds ``rx, ry``."""
    at = A.offset_at(points, tiles)
    at = at.withColumns({"_px": F.col("x") - F.col("ox"), "_py": F.col("y") - F.col("oy")}).drop("ox", "oy")
    at = at.withColumnsRenamed({"_px": "gx", "_py": "gy"})
    at = A.offset_at(at, tiles, px="gx", py="gy")
    return at.withColumns({"rx": F.col("x") - F.col("ox"), "ry": F.col("y") - F.col("oy")}).drop("ox", "oy", "gx", "gy")


def resize_mask(mask: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """A confidence plane ``frame_id, y, x, conf`` on another grid, pixel centres aligned."""
    spark = mask.sparkSession
    frames = mask.select("frame_id").distinct()
    grid = spark.range(dst[0] * dst[1]).select(
        F.expr(f"CAST(floor(id / {dst[0]}e0) AS INT)").alias("py"), (F.col("id") % dst[0]).cast("int").alias("px")
    )
    at = grid.crossJoin(F.broadcast(frames)).withColumns(
        {
            "sx": (F.col("px") + 0.5) * (src[0] / dst[0]) - 0.5,
            "sy": (F.col("py") + 0.5) * (src[1] / dst[1]) - 0.5,
        }
    )
    out = N.sample(at, mask, ["conf"])
    return out.select("frame_id", F.col("py").alias("y"), F.col("px").alias("x"), "conf")
