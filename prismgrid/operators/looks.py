"""Colour lookup tables: lattices of the looks and their trilinear use.

A lattice ``ri, gi, bi, r, g, b`` has ``size`` cubed rows, 4,913 for 17 points, so it is broadcast
(sizes are limited to 65 points).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.functions import color

MAX_POINTS = 65


def lattice(spark: SparkSession, size: int = 17, look: str = "neutral") -> DataFrame:
    """The lattice of a look: neutral, cinematic or skin_safe. Red runs fastest."""
    if not 2 <= size <= MAX_POINTS:
        raise ValueError(f"2 to {MAX_POINTS} points")
    at = spark.range(size**3).select(
        *[F.expr(f"CAST(floor(id / {float(size**k)}e0) AS INT) % {size}").alias(f"{c}i") for k, c in enumerate("rgb")]
    )
    unit = tuple(f"({c}i / {float(size - 1)}e0)" for c in "rgb")
    values = dict(zip("rgb", unit, strict=True)) if look == "neutral" else {c: color.look(c, look == "skin_safe", unit) for c in "rgb"}
    return at.select("ri", "gi", "bi", *[F.expr(e).alias(c) for c, e in values.items()])


def apply_lattice(px: DataFrame, lut: DataFrame, size: int) -> DataFrame:
    """``px`` with channels in 0..1 read from the lattice: along red, then green, then blue."""
    last = size - 1
    at = {c: F.col(c) / 255.0 * float(last) for c in "rgb"}
    q = px.withColumns({f"_{c}0": F.floor(e).cast("int") for c, e in at.items()})
    q = q.withColumns({f"_t{c}": at[c] - F.col(f"_{c}0") for c in "rgb"})
    q = q.withColumns({f"_{c}1": F.least(F.col(f"_{c}0") + 1, F.lit(last)) for c in "rgb"})
    small = F.broadcast(lut)
    for k in range(8):
        b, g, r = k >> 2 & 1, k >> 1 & 1, k & 1
        corner = small.select(
            F.col("ri").alias(f"_r{r}"), F.col("gi").alias(f"_g{g}"), F.col("bi").alias(f"_b{b}"), *[F.col(c).alias(f"_{c}_{b}{g}{r}") for c in "rgb"]
        )
        q = q.join(F.broadcast(corner), [f"_r{r}", f"_g{g}", f"_b{b}"])
    mix = lambda a, b, t: a + (b - a) * F.col(t)

    def value(c: str):
        line = lambda b, g: mix(F.col(f"_{c}_{b}{g}0"), F.col(f"_{c}_{b}{g}1"), "_tr")
        face = lambda b: mix(line(b, 0), line(b, 1), "_tg")
        return mix(face(0), face(1), "_tb")

    rest = [c for c in px.columns if c not in "rgb"]
    return q.select(*rest, *[value(c).alias(c) for c in "rgb"])
