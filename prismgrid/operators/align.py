"""Registration of frames on frame 0 by exhaustive search over small offsets.

A search is an equi-join of the reference, crossed with a handful of offsets, to the frame at the
offset place; pixels outside drop out, as an inner join does. Mean absolute differences are
whole-number sums, so results do not depend on partitioning; ties go to the first offset in scan
order (dy, then dx), which the smallest struct gives. All frames go through one keyed plan. Rows
joined are pixels x frames x offsets (289 at the coarsest level, 25 and 49 below): use
``plans.blocks`` for large frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.functions import color
from prismgrid.sources.shared import barrier

VOTE_TILE, MIN_VOTES = 8, 3
FAR = 1e300  # a difference that no overlap gives


def half(plane: DataFrame) -> DataFrame:
    """Integer luma at half size: rounded means of 2 x 2, an odd last line dropped."""
    size = plane.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    own = plane.join(F.broadcast(size), "frame_id").filter("x < 2 * floor(w / 2e0) AND y < 2 * floor(h / 2e0)")
    place = [F.expr(f"CAST(floor({c} / 2e0) AS INT)").alias(c) for c in ("y", "x")]
    total = own.groupBy("frame_id", *place).agg(F.sum("v").alias("s"))
    return total.select("frame_id", "y", "x", F.floor((F.col("s") + 2) / 4).cast("double").alias("v"))


def offsets(spark: SparkSession, radius: int) -> DataFrame:
    """``i, j``: all whole steps within a radius (i along x)."""
    side = 2 * radius + 1
    return spark.range(side * side).select(
        (F.col("id") % side - radius).cast("int").alias("i"), (F.floor(F.col("id") / side) - radius).cast("int").alias("j")
    )


def differences(plane: DataFrame, centres: DataFrame, steps: DataFrame, region: list[Column], own: str | None = None) -> DataFrame:
    """``frame_id, region, i, j, dx, dy, mad, n``: mean absolute difference of frame 0 to each frame
    moved by centre + step, per region of frame 0.

    ``centres(frame_id, cx, cy)`` gives the frames; ``own`` filters reference pixels.
    """
    ref = plane.filter("frame_id = 0").drop("frame_id").withColumnRenamed("v", "ref")
    ref = ref.filter(own) if own else ref
    tries = centres.crossJoin(F.broadcast(steps)).select(
        "frame_id", "i", "j", (F.col("cx") + F.col("i")).alias("dx"), (F.col("cy") + F.col("j")).alias("dy")
    )
    asked = ref.select(*region, "y", "x", "ref").crossJoin(F.broadcast(tries))
    asked = asked.withColumn("fy", F.col("y") + F.col("dy")).withColumn("fx", F.col("x") + F.col("dx")).drop("y", "x")
    frames = plane.filter("frame_id > 0").select("frame_id", F.col("y").alias("fy"), F.col("x").alias("fx"), "v")
    names = [c for c in asked.columns if c not in ("frame_id", "i", "j", "dx", "dy", "fy", "fx", "ref")]
    gap = F.abs(F.col("ref") - F.col("v"))
    met = asked.join(frames, ["frame_id", "fy", "fx"]).groupBy("frame_id", *names, "i", "j", "dx", "dy")
    return met.agg((F.sum(gap) / F.count(F.lit(1))).alias("mad"), F.count(F.lit(1)).alias("n"))


def best(mads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dx, dy, mad, worst``: the first smallest difference and the largest."""
    low = F.min(F.struct("mad", "dy", "dx", "j", "i"))
    found = mads.groupBy(*keys).agg(low.alias("_b"), F.max("mad").alias("worst"))
    return found.select(*keys, "_b.dx", "_b.dy", "_b.i", "_b.j", "_b.mad", "worst")


def _central(size: tuple[int, int], share: float = 0.5) -> tuple[str, int]:
    """Filter of the middle of a frame and the least overlap a difference must have."""
    w, h = size
    mx, my = int(w * (1 - share) / 2), int(h * (1 - share) / 2)
    test = f"x >= {mx} AND x < {w - mx} AND y >= {my} AND y < {h - my}"
    return test, max(1, (w - 2 * mx) * (h - 2 * my) // 2)


def search(plane: DataFrame, centres: DataFrame, radius: int, size: tuple[int, int]) -> DataFrame:
    """``frame_id, cx, cy, mad``: best offset within ``radius`` of the centres, over the middle of the frame."""
    test, least = _central(size)
    found = differences(plane, centres, offsets(plane.sparkSession, radius), [], test).filter(F.col("n") >= least)
    out = centres.join(best(found, ["frame_id"]), "frame_id", "left")
    return out.select(
        "frame_id",
        F.coalesce("dx", "cx").cast("int").alias("cx"),
        F.coalesce("dy", "cy").cast("int").alias("cy"),
        F.coalesce("mad", F.lit(FAR)).alias("mad"),
    )


def coarse(plane: DataFrame, frames: DataFrame, size: tuple[int, int], radius: int = 8) -> DataFrame:
    """``frame_id, cx, cy``: median of the votes of 8 x 8 tiles that are not flat; with fewer than
    three votes a search over the middle."""
    w, h = size
    start = frames.select("frame_id", F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    steps = offsets(plane.sparkSession, radius)
    whole = search(plane, start, radius, size)
    if (w // VOTE_TILE) * (h // VOTE_TILE) < MIN_VOTES:
        return whole.select("frame_id", "cx", "cy")
    tile = [F.expr(f"CAST(floor({c} / {VOTE_TILE}e0) AS INT)").alias(f"t{c}") for c in ("y", "x")]
    inside = f"x < {w // VOTE_TILE * VOTE_TILE} AND y < {h // VOTE_TILE * VOTE_TILE}"
    mads = differences(plane, start, steps, tile, inside).filter(F.col("n") >= VOTE_TILE * VOTE_TILE // 2)
    votes = best(mads, ["frame_id", "ty", "tx"]).filter("worst - mad >= greatest(1e0, 0.25e0 * mad)")
    middle = votes.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("votes"), F.median("dx").alias("mx"), F.median("dy").alias("my")
    )
    enough = F.col("votes") >= MIN_VOTES
    out = whole.join(middle, "frame_id", "left")
    pick = lambda m, c: F.when(enough, F.expr(color.whole(m))).otherwise(F.col(c)).cast("int").alias(c)
    return out.select("frame_id", pick("mx", "cx"), pick("my", "cy"))


def align(plane: DataFrame, size: tuple[int, int], levels: int = 3) -> DataFrame:
    """``frame_id, dx, dy, mad, accepted`` of every frame of an integer luma burst; frame 0 is the reference.

    Coarse votes at the smallest level, then searches of two steps at each finer one. A frame is
    accepted if its difference is at most four times the median of all, at least 1.
    """
    pyramid, sizes = [barrier(plane)], [size]
    while len(pyramid) < levels and min(sizes[-1]) >= 2:
        pyramid.append(barrier(half(pyramid[-1])))
        sizes.append((sizes[-1][0] // 2, sizes[-1][1] // 2))
    frames = plane.filter("frame_id > 0").select("frame_id").distinct()
    at = barrier(coarse(pyramid[-1], frames, sizes[-1]))
    found = search(pyramid[-1], at, 0, sizes[-1])
    for k in range(len(pyramid) - 2, -1, -1):
        twice = found.select("frame_id", (2 * F.col("cx")).alias("cx"), (2 * F.col("cy")).alias("cy"))
        found = barrier(search(pyramid[k], barrier(twice), 2, sizes[k]))
    usual = found.agg(F.median("mad").alias("m"))
    judged = found.crossJoin(F.broadcast(usual)).select(
        "frame_id",
        F.col("cx").alias("dx"),
        F.col("cy").alias("dy"),
        "mad",
        (F.col("mad") <= 4.0 * F.greatest(F.col("m"), F.lit(1.0))).alias("accepted"),
    )
    first = plane.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("frame_id"), F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(0.0).alias("mad"), F.lit(True).alias("accepted")
    )
    return first.union(judged)


def tile_offsets(plane: DataFrame, alignment: DataFrame, tile: int = 32, dead_zone: float = 0.1) -> DataFrame:
    """``frame_id, ty, tx, dx, dy``: offsets of tiles, refined to fractions of a pixel.

    Two steps around the frame's offset are searched, and a parabola through the neighbours of the
    best gives the fraction (none if it is small or a neighbour has no overlap). Neighbours may lie a
    step beyond the search, so three steps are computed and the best is taken among two. A tile
    without overlap keeps the frame's offset.
    """
    centres = alignment.filter("frame_id > 0 AND accepted").select("frame_id", F.col("dx").alias("cx"), F.col("dy").alias("cy"))
    place = [F.expr(f"CAST(floor({c} / {float(tile)}e0) AS INT)").alias(f"t{c}") for c in ("y", "x")]
    mads = differences(plane, centres, offsets(plane.sparkSession, 3), place)
    found = best(mads.filter("abs(i) <= 2 AND abs(j) <= 2"), ["frame_id", "ty", "tx"])
    around = mads.select("frame_id", "ty", "tx", F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("mad").alias("nm"))
    near = found.join(around, ["frame_id", "ty", "tx"]).filter("abs(ni - i) + abs(nj - j) = 1")
    at = lambda di, dj: F.max(F.when((F.col("ni") - F.col("i") == di) & (F.col("nj") - F.col("j") == dj), F.col("nm")))
    sides = near.groupBy("frame_id", "ty", "tx").agg(at(-1, 0).alias("l"), at(1, 0).alias("r"), at(0, -1).alias("u"), at(0, 1).alias("d"))
    both = found.join(sides, ["frame_id", "ty", "tx"], "left")
    part = lambda a, b: F.expr(
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0e0 WHEN abs({color.parabola(a, 'mad', b)}) < {color.num(dead_zone)} THEN 0e0 ELSE {color.parabola(a, 'mad', b)} END"
    )
    fine = both.select("frame_id", "ty", "tx", (F.col("dx") + part("l", "r")).alias("dx"), (F.col("dy") + part("u", "d")).alias("dy"))
    tiles = plane.filter("frame_id = 0").select(*place).distinct().crossJoin(F.broadcast(centres))
    joined = tiles.join(fine, ["frame_id", "ty", "tx"], "left")
    return joined.select("frame_id", "ty", "tx", F.coalesce("dx", F.col("cx").cast("double")).alias("dx"), F.coalesce("dy", F.col("cy").cast("double")).alias("dy"))


def offset_at(points: DataFrame, tiles: DataFrame, tile: int = 32, px: str = "x", py: str = "y", to: tuple[str, str] = ("ox", "oy")) -> DataFrame:
    """``points`` with the offset at (px, py), interpolated between tile centres."""
    size = tiles.groupBy("frame_id").agg(F.max("ty").alias("_ly"), F.max("tx").alias("_lx"))
    p = points.join(F.broadcast(size), "frame_id")
    for axis, name in (("x", px), ("y", py)):
        g = (F.col(name) - tile / 2.0) / float(tile)
        p = p.withColumn(f"_g{axis}", F.floor(g).cast("int"))
        p = p.withColumn(f"_f{axis}", F.least(F.greatest(g - F.col(f"_g{axis}"), F.lit(0.0)), F.lit(1.0)))
        for k in (0, 1):
            p = p.withColumn(f"_t{axis}{k}", F.least(F.greatest(F.col(f"_g{axis}") + k, F.lit(0)), F.col(f"_l{axis}")))
    for j in (0, 1):
        for i in (0, 1):
            tap = tiles.select("frame_id", F.col("ty").alias(f"_ty{j}"), F.col("tx").alias(f"_tx{i}"), F.col("dx").alias(f"_dx{j}{i}"), F.col("dy").alias(f"_dy{j}{i}"))
            p = p.join(tap, ["frame_id", f"_ty{j}", f"_tx{i}"])
    for name, d in zip(to, ("dx", "dy"), strict=True):
        top = F.col(f"_{d}00") + (F.col(f"_{d}01") - F.col(f"_{d}00")) * F.col("_fx")
        low = F.col(f"_{d}10") + (F.col(f"_{d}11") - F.col(f"_{d}10")) * F.col("_fx")
        p = p.withColumn(name, top + (low - top) * F.col("_fy"))
    return p.drop(*[c for c in p.columns if c.startswith("_")])
