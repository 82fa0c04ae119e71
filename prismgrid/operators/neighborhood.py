"""Two-dimensional windows over pixel rows.

A square window is a pass along rows and a pass along columns; planes that share a radius share
the two exchanges. Windows are always partitioned by a line of one frame, so no task sees more than
a line. Input is dense: every (frame_id, y, x) once. Nulls in a plane count as absent values in sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.functions import color

#: From this radius on sums come from running totals instead of sliding frames.
RUNNING_FROM = 16

_LINES = ((("frame_id", "y"), "x"), (("frame_id", "x"), "y"))


def _mean_on_line(name: str, line: tuple[str, ...], along: str, radius: int) -> Column:
    """Mean over 2r+1 places of a line whose ends repeat."""
    order = Window.partitionBy(*line).orderBy(along)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, at = F.col(name), F.col(along)
    last_at = F.max(along).over(whole)
    inner = F.sum(v).over(order.rowsBetween(-radius, radius))
    before = F.greatest(F.lit(0), radius - at) * F.first(v).over(whole)
    after = F.greatest(F.lit(0), at + radius - last_at) * F.last(v).over(whole)
    return (inner + before + after) / F.lit(float(2 * radius + 1))


def _mean_running(df: DataFrame, names: list[str], line: tuple[str, ...], along: str, radius: int) -> DataFrame:
    """The same mean from running totals: two looks per place whatever the radius."""
    order = Window.partitionBy(*line).orderBy(along)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = {n: f"_t_{n}" for n in names}
    for n, t in totals.items():
        df = df.withColumn(t, F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_last", F.max(along).over(whole))
    new = {}
    for n, t in totals.items():
        high = F.coalesce(F.lead(t, radius).over(order), F.last(t).over(whole))
        low = F.coalesce(F.lag(t, radius + 1).over(order), F.lit(0.0))
        before = F.greatest(F.lit(0), radius - F.col(along)) * F.first(n).over(whole)
        after = F.greatest(F.lit(0), F.col(along) + radius - F.col("_last")) * F.last(n).over(whole)
        new[n] = (high - low + before + after) / F.lit(float(2 * radius + 1))
    return df.withColumns(new).drop("_last", *totals.values())


def box_mean(df: DataFrame, planes: dict[str, Column | str], radius: int) -> DataFrame:
    """Adds a column per entry of ``planes``: its mean over the square of a radius, edges repeated."""
    df = df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in planes.items()})
    if radius == 0:
        return df
    for line, along in _LINES:
        if radius >= RUNNING_FROM:
            df = _mean_running(df, list(planes), line, along, radius)
        else:
            df = df.withColumns({n: _mean_on_line(n, line, along, radius) for n in planes})
    return df


def extreme(df: DataFrame, planes: dict[str, str], radius: int, largest: bool = True) -> DataFrame:
    """Adds per entry the largest (smallest) value in the square of a radius, cut at the edges."""
    pick = F.max if largest else F.min
    df = df.withColumns({n: F.col(c) for n, c in planes.items()})
    for line, along in _LINES:
        window = Window.partitionBy(*line).orderBy(along).rowsBetween(-radius, radius)
        df = df.withColumns({n: pick(n).over(window) for n in planes})
    return df


def guided(df: DataFrame, planes: dict[str, str], guide: str, radius: int, eps: float) -> DataFrame:
    """Adds per entry (result name: input plane) the plane smoothed along the edges of ``guide``.

    All planes share four exchanges: means of inputs, guide and products, then of the two
    coefficients. A plane guided by itself needs no product of its own.
    """
    g = F.col(guide)
    first: dict[str, Column | str] = {"_mg": g, "_gg": g * g}
    for i, (_, plane) in enumerate(planes.items()):
        if plane != guide:
            first |= {f"_m{i}": F.col(plane), f"_c{i}": F.col(plane) * g}
    df = box_mean(df, first, radius)
    spread = F.greatest(F.lit(0.0), F.col("_gg") - F.col("_mg") * F.col("_mg"))
    second: dict[str, Column | str] = {}
    for i, (_, plane) in enumerate(planes.items()):
        if plane == guide:
            slope = spread / (spread + F.lit(float(eps)))
            second |= {f"_a{i}": slope, f"_b{i}": F.col("_mg") * (F.lit(1.0) - slope)}
        else:
            slope = (F.col(f"_c{i}") - F.col(f"_m{i}") * F.col("_mg")) / (spread + F.lit(float(eps)))
            second |= {f"_a{i}": slope, f"_b{i}": F.col(f"_m{i}") - slope * F.col("_mg")}
    df = box_mean(df, second, radius)
    df = df.withColumns({n: F.col(f"_a{i}") * g + F.col(f"_b{i}") for i, n in enumerate(planes)})
    return df.drop(*first, *second)


def local_variance(df: DataFrame, plane: str, to: str, radius: int) -> DataFrame:
    """Mean squared distance from the local mean: how much detail a place holds."""
    df = box_mean(df, {"_mean": plane}, radius)
    gap = F.col(plane) - F.col("_mean")
    return box_mean(df, {to: gap * gap}, radius).drop("_mean")


# --- pyramids and sampling: places of another grid -------------------------------------------

#: Five-tap kernel of the pyramids. Fixed values.
KERNEL = (1.0, 4.0, 6.0, 4.0, 1.0)


def _halve(df: DataFrame, line: tuple[str, ...], along: str) -> DataFrame:
    """Every second place of a line, smoothed by the kernel; the ends repeat."""
    order = Window.partitionBy(*line).orderBy(along)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("v").over(whole), F.last("v").over(whole)
    at = lambda t: (
        F.col("v") if t == 0 else F.coalesce((F.lag if t < 0 else F.lead)("v", abs(t)).over(order), first if t < 0 else last)
    )
    total = sum((KERNEL[t + 2] * at(t) for t in (-1, 0, 1, 2)), KERNEL[0] * at(-2))
    return df.withColumn("v", total / 16.0).filter(F.col(along) % 2 == 0).withColumn(along, (F.col(along) / 2).cast("int"))


def pyramid_down(plane: DataFrame) -> DataFrame:
    """``frame_id, y, x, v`` at half size, rounded up."""
    for line, along in _LINES:
        plane = _halve(plane, line, along)
    return plane


def _double(df: DataFrame, along: str, size: DataFrame, extent: str) -> DataFrame:
    """Places 2k and 2k+1 from k-1, k, k+1 of a line, up to the size of the finer grid."""
    line, _ = next(x for x in _LINES if x[1] == along)
    order = Window.partitionBy(*line).orderBy(along)
    left, right = F.coalesce(F.lag("v").over(order), F.col("v")), F.coalesce(F.lead("v").over(order), F.col("v"))
    even = 2.0 * (KERNEL[0] * left + KERNEL[2] * F.col("v") + KERNEL[4] * right) / 16.0
    odd = 2.0 * (KERNEL[1] * F.col("v") + KERNEL[3] * right) / 16.0
    df = df.withColumns({"_even": even, "_odd": odd})
    both = F.array(
        F.struct((F.col(along) * 2).alias("p"), F.col("_even").alias("v")),
        F.struct((F.col(along) * 2 + 1).alias("p"), F.col("_odd").alias("v")),
    )
    df = df.withColumn("_two", F.explode(both)).withColumns({along: F.col("_two.p"), "v": F.col("_two.v")})
    df = df.drop("_two", "_even", "_odd")
    return df.join(F.broadcast(size), "frame_id").filter(F.col(along) < F.col(extent)).drop("w", "h")


def pyramid_up(plane: DataFrame, size: DataFrame) -> DataFrame:
    """The plane on the grid of twice the size that ``size(frame_id, w, h)`` gives.

    ``size`` has one row per frame and is read once; frames per job are bounded by the caller.
    """
    return _double(_double(plane, "x", size, "w"), "y", size, "h")


def block_mean(df: DataFrame, columns: list[str], factor: int, keep_rest: bool = False) -> DataFrame:
    """Means over blocks; an incomplete last block is dropped unless ``keep_rest``."""
    own = df
    if not keep_rest:
        size = df.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
        own = df.join(F.broadcast(size), "frame_id").filter(
            f"x < greatest(1, floor(w / {factor}e0)) * {factor} AND y < greatest(1, floor(h / {factor}e0)) * {factor}"
        )
    place = [F.expr(f"CAST(floor({c} / {factor}e0) AS INT)").alias(c) for c in ("y", "x")]
    return own.groupBy("frame_id", *place).agg(*[F.avg(c).alias(c) for c in columns])


def sample(points: DataFrame, image: DataFrame, columns: list[str], sx: str = "sx", sy: str = "sy") -> DataFrame:
    """``points`` with ``columns`` of ``image`` read between pixels at (sx, sy), clamped to the frame.

    Both have ``frame_id``. The four neighbours come by four equi-joins on whole places, so
    interpolation keeps the order of operations: along x, then along y.
    """
    size = image.groupBy("frame_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    p = points.join(F.broadcast(size), "frame_id")
    p = p.withColumn("_cx", F.least(F.greatest(F.col(sx), F.lit(0.0)), (F.col("_w") - 1).cast("double")))
    p = p.withColumn("_cy", F.least(F.greatest(F.col(sy), F.lit(0.0)), (F.col("_h") - 1).cast("double")))
    p = p.withColumns({"_x0": F.floor("_cx").cast("int"), "_y0": F.floor("_cy").cast("int")})
    p = p.withColumns({"_x1": F.least(F.col("_x0") + 1, F.col("_w") - 1), "_y1": F.least(F.col("_y0") + 1, F.col("_h") - 1)})
    p = p.withColumns({"_fx": F.col("_cx") - F.col("_x0"), "_fy": F.col("_cy") - F.col("_y0")})
    for j in (0, 1):
        for i in (0, 1):
            tap = image.select(
                "frame_id", F.col("y").alias(f"_y{j}"), F.col("x").alias(f"_x{i}"), *[F.col(c).cast("double").alias(f"_{c}{j}{i}") for c in columns]
            )
            p = p.join(tap, ["frame_id", f"_y{j}", f"_x{i}"])
    mix = lambda c, j: F.col(f"_{c}{j}0") + (F.col(f"_{c}{j}1") - F.col(f"_{c}{j}0")) * F.col("_fx")
    p = p.withColumns({c: mix(c, 0) + (mix(c, 1) - mix(c, 0)) * F.col("_fy") for c in columns})
    return p.drop(*[c for c in p.columns if c.startswith("_")])


def disc_mean(px: DataFrame, columns: list[str], weight: str, radius: Column, taps: int) -> DataFrame:
    """``frame_id, y, x, columns``: weighted mean over the taps of a disc of a radius that varies by pixel.

    Taps lie on a spiral and are read between pixels, clamped to the frame; without weight the plain mean counts.
    """
    dx, dy = color.vogel("tap", taps)
    spiral = px.sparkSession.range(taps).select(F.col("id").alias("tap")).select("tap", F.expr(dx).alias("dx"), F.expr(dy).alias("dy"))
    at = px.select("frame_id", F.col("y").alias("py"), F.col("x").alias("px"), radius.alias("radius")).crossJoin(F.broadcast(spiral))
    at = at.select("frame_id", "py", "px", (F.col("px") + F.col("radius") * F.col("dx")).alias("sx"), (F.col("py") + F.col("radius") * F.col("dy")).alias("sy"))
    read = sample(at, px, [*columns, weight])
    mass = F.sum(weight)
    mean = lambda c: F.when(mass > 1e-4, F.sum(F.col(c) * F.col(weight)) / mass).otherwise(F.avg(c)).alias(c)
    return read.groupBy("frame_id", "py", "px").agg(*map(mean, columns)).withColumnsRenamed({"py": "y", "px": "x"})
