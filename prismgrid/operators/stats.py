"""Aggregates over frames: histograms, ranks, robust statistics, cues and quality metrics.

Statistics stay DataFrames with one row per frame (or per frame and channel); they are joined to
pixels, never collected. Ranks come from value counts: the window over a histogram sees at most
one row per distinct value of a frame. Empty input gives no row; a frame without admitted pixels
has a count of 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.functions import color
from prismgrid.sources.shared import barrier


def counts(df: DataFrame, value: Column | str, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """``keys, v, n``: how often each value occurs."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def running(hist: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """A histogram with ``upto`` (values up to and including v) and ``total``."""
    by = Window.partitionBy(*keys)
    order = by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(by))


def value_at_rank(hist: DataFrame, p: float, to: str, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """``keys, to``: the value at index round(p (n - 1)) of the sorted values."""
    rank = F.expr(color.whole(f"{color.num(p)} * (total - 1)"))
    return running(hist, keys).filter(F.col("upto") > rank).groupBy(*keys).agg(F.min("v").alias(to))


def trimmed_mean(hist: DataFrame, fraction: float, to: str, keys: tuple[str, ...] = ("frame_id",), at_most_half: bool = False) -> DataFrame:
    """Mean without a fraction of the values at either end; of all values if none would be left.

    ``at_most_half`` bounds what is dropped by half of the values instead.
    """
    drop = F.expr(f"CAST(floor(total * {color.num(fraction)}) AS BIGINT)")
    if at_most_half:
        drop = F.least(drop, F.expr("CAST(floor((total - 1) / 2e0) AS BIGINT)"))
    h = running(hist, keys).withColumn("drop", drop)
    h = h.withColumn("drop", F.when(F.col("total") - 2 * F.col("drop") <= 0, F.lit(0)).otherwise(F.col("drop")))
    kept = F.greatest(
        F.least(F.col("upto"), F.col("total") - F.col("drop")) - F.greatest(F.col("upto") - F.col("n"), F.col("drop")), F.lit(0)
    )
    h = h.withColumn("kept", kept)
    return h.groupBy(*keys).agg((F.sum(F.col("v") * F.col("kept")) / F.sum("kept")).alias(to))


def robust_sigma(df: DataFrame, value: str, to: str, keys: tuple[str, ...] = ("frame_id",), least: float = 1.0) -> DataFrame:
    """1.4826 times the median distance from the median, at least ``least``."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("_middle"))
    far = df.join(F.broadcast(middle), list(keys)).withColumn("_far", F.abs(F.col(value) - F.col("_middle")))
    return far.groupBy(*keys).agg(F.greatest(F.lit(1.4826) * F.median("_far"), F.lit(float(least))).alias(to))


def brightness_gain(px: DataFrame, low: float = 0.7, high: float = 1.4, fraction: float = 0.05) -> DataFrame:
    """``frame_id, gain``: what brings each frame's trimmed mean luma to that of frame 0."""
    hist = counts(px, F.expr(color.luma()))
    means = trimmed_mean(hist, fraction, "mean", at_most_half=True)
    first = means.filter("frame_id = 0").select(F.col("mean").alias("wanted"))
    gain = F.when(F.col("mean") <= 0, F.lit(1.0)).otherwise(
        F.least(F.greatest(F.col("wanted") / F.col("mean"), F.lit(low)), F.lit(high))
    )
    return means.crossJoin(F.broadcast(first)).select("frame_id", gain.alias("gain"))


# --- white balance -----------------------------------------------------------------------------

#: Bounds of the estimate. Fixed values.
MAX_GAIN, NEUTRAL, RAMP = 1.6, 0.09, 0.11
PROBE_SHARE, PROBE_SLACK = 0.08, 0.005
USABLE_SHARE, CUE_FLOOR = 0.01, 32.0


def colours(px: DataFrame) -> DataFrame:
    """``frame_id, r, g, b, n``: how often each colour occurs, 2^24 rows a frame at most. Written once, as the
    three cues and their ranks all read it."""
    return barrier(px.groupBy("frame_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")), "colours")


def gray_cue(bag: DataFrame) -> DataFrame:
    """``frame_id, r, g, b, n``: trimmed channel means over near-neutral pixels of middle luma, from counted colours."""
    own = bag.filter(color.mid_luma(0.6))
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in "rgb"]))
    hist = own.select("frame_id", "n", channels.alias("s")).groupBy("frame_id", F.col("s.c").alias("c"), F.col("s.v").alias("v"))
    means = trimmed_mean(hist.agg(F.sum("n").alias("n")), 0.1, "mean", ("frame_id", "c"))
    wide = means.groupBy("frame_id").agg(*[F.max(F.when(F.col("c") == c, F.col("mean"))).alias(c) for c in "rgb"])
    return wide.join(own.groupBy("frame_id").agg(F.sum("n").alias("n")), "frame_id")


def probe_cue(bag: DataFrame) -> DataFrame:
    """``frame_id, r, g, b, n``: plain means over strictly neutral pixels, from counted colours."""
    return _means(bag.filter(color.mid_luma(0.10)))


def highlight_cue(bag: DataFrame) -> DataFrame:
    """``frame_id, r, g, b, n``: means over the unclipped pixels between the 90th and 99th percentile of luma,
    from counted colours."""
    milli = F.expr(color.luma_milli())
    hist = running(bag.groupBy("frame_id", milli.alias("v")).agg(F.sum("n").alias("n")))
    at = lambda p: F.min(F.when(F.col("upto") > F.expr(color.whole(f"{color.num(p)} * (total - 1)")), F.col("v")))
    marks = hist.groupBy("frame_id").agg(at(0.90).alias("low"), at(0.99).alias("high"))
    band = bag.join(F.broadcast(marks), "frame_id")
    return _means(band.filter((milli >= F.col("low")) & (milli <= F.col("high"))).filter(color.unclipped()))


def _means(bag: DataFrame) -> DataFrame:
    sums = [(F.sum(F.col(c).cast("long") * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"]
    return bag.groupBy("frame_id").agg(*sums, F.sum("n").alias("n"))


def combine_sql(raw: str) -> str:
    """Bounded gain of a raw one: nothing within the neutral band, then a smooth ramp."""
    gap = f"({raw} - 1e0)"
    eased = f"1e0 + {gap} * {color.smoothstep(NEUTRAL, NEUTRAL + RAMP, f'abs{gap}')}"
    return f"CASE WHEN abs{gap} <= {color.num(NEUTRAL)} THEN 1e0 ELSE {color.clamp(eased, 1 / MAX_GAIN, MAX_GAIN)} END"


def white_balance_gains(px: DataFrame) -> DataFrame:
    """``frame_id, gain_r, gain_b`` (green is 1). Identity where too little is usable.

    The two cues vote by their counts; where enough strictly neutral pixels exist no gain may push
    them past neutral.
    """
    bag = colours(px)
    sizes = bag.groupBy("frame_id").agg(F.sum("n").alias("size"))
    named = lambda df, p: df.select("frame_id", *[F.col(c).alias(f"{p}_{c}") for c in ("r", "g", "b", "n")])
    all_ = sizes
    for cue, p in ((gray_cue(bag), "gray"), (highlight_cue(bag), "high"), (probe_cue(bag), "probe")):
        all_ = all_.join(named(cue, p), "frame_id", "left")
    return gains_from(all_.fillna(0))


def gains_from(cues: DataFrame) -> DataFrame:
    """Gains from ``frame_id, size`` and the three cues as columns ``gray_*, high_*, probe_*``.

    Step by step, so that no expression repeats another inside itself.
    """
    good = lambda p: (F.col(f"{p}_n") > 0) & (F.least(*[F.col(f"{p}_{c}") for c in "rgb"]) > 1e-6)
    at_least = lambda share: F.greatest(F.lit(1), F.expr(color.whole(f"size * {color.num(share)}")))
    c = cues.withColumns({f"{p}_w": F.when(good(p), F.greatest(F.col(f"{p}_n").cast("double"), F.lit(CUE_FLOOR))).otherwise(0.0) for p in ("gray", "high")})
    c = c.withColumns(
        {
            "usable": (F.col("gray_n") + F.col("high_n") >= at_least(USABLE_SHARE)) & (F.col("gray_w") + F.col("high_w") > 0),
            "probed": (F.col("probe_n") >= at_least(PROBE_SHARE)) & good("probe"),
        }
    )
    for k in "rb":
        ratio = lambda p, k=k: F.when(F.col(f"{p}_w") > 0, F.col(f"{p}_g") / F.col(f"{p}_{k}")).otherwise(0.0)
        mean = (F.col("gray_w") * ratio("gray") + F.col("high_w") * ratio("high")) / (F.col("gray_w") + F.col("high_w"))
        c = c.withColumn("raw", F.when(F.col("usable"), mean).otherwise(1.0))
        c = c.withColumn("neutral", F.when(F.col("probed"), F.col("probe_g") / F.col(f"probe_{k}")))
        low, high = F.least(F.lit(1.0), F.col("neutral") * (1 - PROBE_SLACK)), F.greatest(F.lit(1.0), F.col("neutral") * (1 + PROBE_SLACK))
        c = c.withColumn("held", F.when(F.col("probed"), F.least(F.greatest("raw", low), high)).otherwise(F.col("raw")))
        c = c.withColumn("gap", F.col("held") - 1.0)
        c = c.withColumn("t", F.least(F.greatest((F.abs("gap") - NEUTRAL) / RAMP, F.lit(0.0)), F.lit(1.0)))
        eased = 1.0 + F.col("gap") * F.col("t") * F.col("t") * (3.0 - 2.0 * F.col("t"))
        bounded = F.least(F.greatest(eased, F.lit(1 / MAX_GAIN)), F.lit(MAX_GAIN))
        c = c.withColumn(f"gain_{k}", F.when(F.col("usable") & (F.abs("gap") > NEUTRAL), bounded).otherwise(1.0))
    return c.select("frame_id", "gain_r", "gain_b")


def gains_sql() -> dict[str, str]:
    """The two gains as expressions over the cue columns."""
    good = lambda p: f"({p}_n > 0 AND {p}_r > 1e-6 AND {p}_g > 1e-6 AND {p}_b > 1e-6)"
    weight = lambda p: f"CASE WHEN {good(p)} THEN greatest(CAST({p}_n AS DOUBLE), {color.num(CUE_FLOOR)}) ELSE 0e0 END"
    out = {}
    for c in "rb":
        ratio = lambda p, c=c: f"CASE WHEN {good(p)} THEN {p}_g / {p}_{c} ELSE 0e0 END"
        raw = f"(({weight('gray')}) * ({ratio('gray')}) + ({weight('high')}) * ({ratio('high')})) / (({weight('gray')}) + ({weight('high')}))"
        enough = f"probe_n >= greatest(1, {color.whole(f'size * {color.num(PROBE_SHARE)}')}) AND {good('probe')}"
        probe = f"(probe_g / probe_{c})"
        top, bottom = f"greatest(1e0, {probe} * {color.num(1 + PROBE_SLACK)})", f"least(1e0, {probe} * {color.num(1 - PROBE_SLACK)})"
        held = f"(CASE WHEN {enough} THEN least(greatest({raw}, {bottom}), {top}) ELSE {raw} END)"
        usable = f"gray_n + high_n >= greatest(1, {color.whole(f'size * {color.num(USABLE_SHARE)}')}) AND ({good('gray')} OR {good('high')})"
        out[c] = f"CASE WHEN {usable} THEN {combine_sql(held)} ELSE 1e0 END"
    return out


def backlit(px: DataFrame) -> DataFrame:
    """``frame_id, dark, bright, mid, strength`` of the backlit detector."""
    y = color.luma()
    share = lambda test: F.avg(F.expr(f"CASE WHEN {test} THEN 1e0 ELSE 0e0 END"))
    shares = px.groupBy("frame_id").agg(
        share(f"{y} >= 24e0 AND {y} < 60e0").alias("dark"), share(f"{y} > 160e0").alias("bright"), share(f"{y} >= 70e0 AND {y} <= 150e0").alias("mid")
    )
    shares = shares.withColumns({f"_{i}": F.expr(color.clamp(m, 0, 1)) for i, m in enumerate(BACKLIT_MARGINS)})
    eased = F.least(*[F.expr(f"_{i} * _{i} * (3e0 - 2e0 * _{i})") for i in range(3)])
    return shares.withColumn("strength", eased).drop("_0", "_1", "_2")


#: How far the three shares are inside the bounds of a backlit scene.
BACKLIT_MARGINS = ("(dark - 0.25e0) / 0.1e0", "(bright - 0.15e0) / 0.1e0", "(0.35e0 - mid) / 0.1e0")


def backlit_strength() -> str:
    return f"least({', '.join(color.smoothstep(0, 1, m) for m in BACKLIT_MARGINS)})"


# --- quality ------------------------------------------------------------------------------------


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("frame_id", "y", "x", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    return a.select("frame_id", "y", "x", "r", "g", "b").join(other, ["frame_id", "y", "x"])


def psnr_mae(a: DataFrame, b: DataFrame) -> DataFrame:
    """``frame_id, psnr, mae``; equal frames have an infinite PSNR. Sums are exact in whole numbers."""
    square = sum((F.col(c) - F.col(f"{c}2")).cast("long") * (F.col(c) - F.col(f"{c}2")) for c in "rgb")
    away = sum(F.abs(F.col(c) - F.col(f"{c}2")).cast("long") for c in "rgb")
    sums = _pairs(a, b).groupBy("frame_id").agg(F.sum(square).alias("se"), F.sum(away).alias("ae"), (3 * F.count(F.lit(1))).alias("n"))
    mse = F.col("se").cast("double") / F.col("n")
    psnr = F.when(F.col("se") == 0, F.lit(math.inf)).otherwise(10.0 * F.log10(255.0 * 255.0 / mse))
    return sums.select("frame_id", psnr.alias("psnr"), (F.col("ae").cast("double") / F.col("n")).alias("mae"))


def ssim(a: DataFrame, b: DataFrame) -> DataFrame:
    """``frame_id, ssim``: mean over windows of 8 x 8 every 4 pixels, of double luma.

    A pixel belongs to at most four windows; windows are cut to those wholly inside the frame.
    """
    px = _pairs(a, b).select(
        "frame_id", "y", "x", F.expr(color.luma()).alias("u"), F.expr(color.luma("r2", "g2", "b2")).alias("v")
    )
    size = px.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    window = lambda c: F.explode(F.expr(f"array(CAST(floor({c} / 4e0) AS INT), CAST(floor({c} / 4e0) AS INT) - 1)"))
    at = px.withColumn("wy", window("y")).withColumn("wx", window("x")).join(F.broadcast(size), "frame_id")
    at = at.filter("wy >= 0 AND wx >= 0 AND 4 * wy + 8 <= h AND 4 * wx + 8 <= w")
    sums = at.groupBy("frame_id", "wy", "wx").agg(
        *[F.avg(e).alias(n) for n, e in (("mu", F.col("u")), ("mv", F.col("v")))],
        F.avg(F.col("u") * F.col("u")).alias("uu"),
        F.avg(F.col("v") * F.col("v")).alias("vv"),
        F.avg(F.col("u") * F.col("v")).alias("uv"),
    )
    return sums.groupBy("frame_id").agg(F.avg(F.expr(ssim_sql())).alias("ssim"))


def ssim_sql() -> str:
    """Similarity of a window from its five means."""
    c1, c2 = color.num((0.01 * 255) ** 2), color.num((0.03 * 255) ** 2)
    return (
        f"((2e0 * mu * mv + {c1}) * (2e0 * (uv - mu * mv) + {c2})) / "
        f"((mu * mu + mv * mv + {c1}) * (uu - mu * mu + vv - mv * mv + {c2}))"
    )


def masked_mae(a: DataFrame, b: DataFrame, mask: str) -> DataFrame:
    """``frame_id, mae`` over pixels of ``b`` where ``mask`` (an expression on r2, g2, b2) holds."""
    away = sum(F.abs(F.col(c) - F.col(f"{c}2")).cast("long") for c in "rgb")
    own = _pairs(a, b).filter(mask)
    return own.groupBy("frame_id").agg((F.sum(away).cast("double") / (3 * F.count(F.lit(1)))).alias("mae"))


def decile_marks(px: DataFrame, share: float = 0.1) -> DataFrame:
    """``frame_id, dark, bright``: the luma codes that bound the darkest and brightest share, ties included."""
    hist = running(counts(px, F.expr(color.luma_int())))
    take = F.greatest(F.expr(f"CAST(floor(total * {color.num(share)}) AS BIGINT)"), F.lit(1))
    dark = F.min(F.when(F.col("upto") >= take, F.col("v")))
    bright = F.min(F.when(F.col("upto") > F.col("total") - take, F.col("v")))
    return hist.withColumn("take", take).groupBy("frame_id").agg(dark.alias("dark"), bright.alias("bright"))


def amplitude(px: DataFrame, period: float, value: str | None = None) -> DataFrame:
    """``frame_id, amplitude`` of one frequency along x."""
    v, phase = F.expr(value or color.luma()), F.lit(2 * math.pi) * F.col("x") / F.lit(float(period))
    c, s = F.sum(v * F.cos(phase)), F.sum(v * F.sin(phase))
    return px.groupBy("frame_id").agg((2.0 * F.sqrt(c * c + s * s) / F.count(F.lit(1))).alias("amplitude"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """``frame_id, psnr, ssim, mae``; null metrics unless both frames have one size of at least 8 x 8."""
    size = lambda df: df.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    both = size(a).join(size(b).select("frame_id", F.col("w").alias("w2"), F.col("h").alias("h2")), "frame_id")
    fits = both.withColumn("fits", F.expr("w = w2 AND h = h2 AND w >= 8 AND h >= 8")).select("frame_id", "fits")
    metrics = psnr_mae(a, b).join(ssim(a, b), "frame_id")
    joined = fits.join(metrics, "frame_id", "left")
    return joined.select("frame_id", *[F.when(F.col("fits"), F.col(c)).alias(c) for c in ("psnr", "ssim", "mae")])


def no_subject(mask: DataFrame) -> DataFrame:
    """``frame_id, no_subject``: less than 2 % of a mask's confidences reach one half."""
    sure = F.avg((F.col("conf") >= 0.5).cast("double"))
    return mask.groupBy("frame_id").agg((F.coalesce(sure, F.lit(0.0)) < 0.02).alias("no_subject"))
