"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; every document of it the same expected number
of copies, target / source size. The whole part is certain. The fractional parts are rounded
together: two fractional documents exchange word mass at random (a martingale) until one of
them has 0 or 1 extra copies, so the words a source takes are off by at most one document.

The rounding is a reduction tree. Groups of about ``group_rows`` documents of one source
each leave at most one fractional document, and the residuals of ``group_rows`` groups meet
on the next level, so no task holds more than a bounded group however hot the source is.

Random numbers are hashes of the seed and the document, the groups hashes of the document:
reruns agree whatever the partitioning.

Null text has size 0 and takes 0 words; null sources form one source, ordered last. Rows of equal
id, source and text are one unit with a multiplicity, so repeated rows and null ids fill no group;
each of them counts as a document of its own. An empty table gives an empty result. Targets are
found in one task that sees a row per source.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.llm.common import WORD, small_batches, staged

_MASK = (1 << 64) - 1


def uniform(*keys: int) -> float:
    """A number in [0, 1) that depends on the keys alone (splitmix64)."""
    x = 0x9E3779B97F4A7C15
    for key in keys:
        x = (x ^ (key & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
        x ^= x >> 31
    return (x >> 11) / (1 << 53)


def pivotal(ids: list[int], sizes: list[int], parts: list[float], seed: int, last: bool) -> list[float]:
    """Round fractions in [0, 1] so that the sum of size x fraction stays as it is.

    At most one fraction is left strictly between 0 and 1; with ``last`` that one is rounded
    at random too. Documents without words carry no mass and are rounded on their own.
    """
    out, held = list(parts), -1
    for i, size in enumerate(sizes):
        if not 0 < out[i] < 1:
            continue
        if size <= 0:
            out[i] = float(uniform(seed, ids[i], 1) < out[i])
            continue
        if held < 0:
            held = i
            continue
        mass_h, mass_i = out[held] * sizes[held], out[i] * size
        room_h, room_i = sizes[held] - mass_h, size - mass_i
        up, down = min(room_h, mass_i), min(room_i, mass_h)  # words that may go to the held one, or from it
        if uniform(seed, ids[held], ids[i]) * (up + down) < down:
            h = 1.0 if room_h <= mass_i else (mass_h + up) / sizes[held]
            j = 0.0 if mass_i <= room_h else (mass_i - up) / size
        else:
            h = 0.0 if mass_h <= room_i else (mass_h - down) / sizes[held]
            j = 1.0 if room_i <= mass_h else (mass_i + down) / size
        out[held], out[i] = h, j
        held = held if 0 < h < 1 else i if 0 < j < 1 else -1
    if last and held >= 0:
        out[held] = float(uniform(seed, ids[held], 2) < out[held])
    return out


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """Per source of ``sized(source, size, rows)``: ``source, source_size, n, target``.

    Sources by code point, null last, take the weights in turn and share all words; a target
    stops at ``cap`` times the source's size and the excess is shared again by weight. Sorted
    by cap / weight the stopped sources are a prefix, found with running sums. The windows see
    one aggregated row per source, never documents.
    """
    each = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(
        F.sum("most").over(before), F.lit(0.0)
    )
    each = each.withColumn("level", left / F.sum("weight").over(onward))
    each = each.withColumn("stopped", F.col("most") <= F.col("level") * F.col("weight"))
    ratio = F.struct(F.col("most") / F.col("weight"), F.col("level"))
    level = F.min(F.when(~F.col("stopped"), ratio)).over(all_rows)["level"]
    target = F.when(F.col("stopped"), F.col("most")).otherwise(level * F.col("weight"))
    return each.select("source", "source_size", "n", target.alias("target"))


def _round(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    # Longest first: the document that stays fractional is then one of the shortest.
    rows = rows.sort_values(["size", "order"], ascending=[False, True], kind="stable")
    rows = rows.reset_index(drop=True)
    ids = [int(x) for x in rows["order"]]
    last = bool(rows["last"].iloc[0])
    rows["part"] = pivotal(ids, rows["size"].tolist(), rows["part"].tolist(), seed, last)
    return rows


def _size() -> F.Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def _keys() -> list[F.Column]:
    """128 bits that stand for a document: equal for rows of equal id, source and text alone."""
    parts = [c for name in ("doc_id", "source", "text") for c in (F.col(name).isNull(), F.col(name))]
    return [F.xxhash64(F.lit(i), *parts).alias(f"k{i}") for i in (1, 2)]


def _units(docs: DataFrame, weights: tuple[float, ...], cap: float, seed: int, group_rows: int) -> DataFrame:
    """``k1, k2, doc_id, source, size, source_size, target, rows, whole, extra``: ``rows`` equal rows take
    ``whole`` copies each and ``extra`` more in all. More than ``group_rows`` equal rows are several units."""
    small_batches(docs.sparkSession, 4096)
    sized = docs.select(*_keys(), "doc_id", "source", _size().alias("size")).groupBy("k1", "k2")
    units = sized.agg(*[F.any_value(c).alias(c) for c in ("doc_id", "source", "size")], F.count(F.lit(1)).alias("n"))
    slices = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / group_rows))
    units = units.withColumn("slice", F.explode(slices))
    units = staged(units.withColumn("rows", F.least(F.lit(group_rows), F.col("n") - F.col("slice") * group_rows)).drop("n"), "sizes")
    sources = staged(targets(units, weights, cap), "sources")
    most = sources.agg(F.max("n")).first()[0] or 0
    rows = units.join(sources, units["source"].eqNullSafe(sources["source"]), "inner").drop(sources["source"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (copies - F.floor(copies)) * F.col("rows")
    rows = (
        rows.withColumn("whole", F.floor(copies).cast("long"))
        .withColumn("extra", F.floor(extra).cast("long"))
        .withColumn("part", extra - F.floor(extra))
        .withColumn("order", F.xxhash64(F.lit(seed), "k1", "slice"))
        .withColumn("groups", F.ceil(F.col("n") / group_rows).cast("long"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "k1", "slice"), F.col("groups")))
        .withColumn("last", F.col("groups") == 1)
        .drop("n", "slice")
    )
    done = []
    while True:
        solved = rows.groupBy("source", "bucket").applyInPandas(lambda g: _round(g, seed), rows.schema)
        if most <= group_rows:  # every group is the last of its source
            done.append(solved)
            break
        solved = staged(solved, "rounded")
        settled = (F.col("part") <= 0) | (F.col("part") >= 1)
        done.append(solved.filter(settled))
        rows = (
            solved.filter(~settled)
            .withColumn("groups", F.ceil(F.col("groups") / group_rows).cast("long"))
            .withColumn("bucket", F.floor(F.col("bucket") / group_rows))
            .withColumn("last", F.col("groups") == 1)
        )
        most = math.ceil(most / group_rows)
    done = reduce(DataFrame.union, done)
    return done.withColumn("extra", F.col("extra") + F.col("part").cast("long"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3,
    seed: int = 42,
    group_rows: int = 4096,
) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: ``doc_id, source, size, source_size, target,
    copies, taken``; ``taken`` is ``copies x size``, at most ``cap`` times the size."""
    units = _units(docs, weights, cap, seed, group_rows)
    each = units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("whole") + (F.col("nth") <= F.col("extra")).cast("long")
    return each.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3,
    seed: int = 42,
    group_rows: int = 4096,
) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as :func:`mix` takes it, same columns.

    Of rows with equal id, source and text that take unequal copies, the first by a hash of the
    whole row take more; columns of any name pass through.
    """
    own = _keys()
    plan = _units(docs, weights, cap, seed, group_rows).groupBy("k1", "k2")
    plan = staged(plan.agg(F.sum("rows").alias("_m"), F.max("whole").alias("_whole"), F.sum("extra").alias("_extra")), "plan")
    uneven = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_m"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *own)
    even = rows.join(plan.filter(~uneven), ["k1", "k2"])
    even = even.select("_row", (F.col("_whole") + (F.col("_extra") > 0).cast("long")).alias("_n"))
    if plan.filter(uneven).limit(1).count():
        nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64(F.col("_row").cast("string"))))
        odd = rows.join(plan.filter(uneven), ["k1", "k2"])
        even = even.unionByName(odd.select("_row", (F.col("_whole") + (nth <= F.col("_extra")).cast("long")).alias("_n")))
    copied = even.filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return copied.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
