"""Quality reports: scene, burst, merge, finish, compare, as one keyed plan per report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.operators import finish as P
from prismgrid.plans import blocks as B
from prismgrid.plans import kernels as K
from prismgrid.sources import scenes as S

SEED = 0xC0FFEE


def scene_bursts(spark: SparkSession, seed: int = SEED, size: int = 8, names=S.NAMES) -> DataFrame:
    """Noisy bursts of the scenes, made where they are used: ``burst_id (scene), frame_id, ...``."""
    plan = [(name, seed + i * S.SCENE_STEP, k) for i, name in enumerate(names) for k in range(size)]
    jobs = spark.createDataFrame(plan, "burst_id string, seed long, frame_id long")

    def make(batches):
        for batch in batches:
            f = [S.noisy(S.clean(r.burst_id), r.seed + r.frame_id * S.FRAME_STEP) for r in batch.itertuples(index=False)]
            yield batch.assign(width=[x.shape[1] for x in f], height=[x.shape[0] for x in f], rgb=[B.encode(x) for x in f]).drop(columns="seed")

    return jobs.repartition("burst_id", "frame_id").mapInPandas(make, "burst_id string, frame_id long, width int, height int, rgb binary")


def truths(spark: SparkSession, render=None, names=S.NAMES) -> DataFrame:
    """``burst_id, rgb`` of the clean scenes, rendered where asked."""
    frames = [S.clean(n) for n in names]
    return B.from_arrays(spark, [render(f) if render else f for f in frames], burst_id=list(names))


def pipeline_quality(spark: SparkSession, params: P.Params = P.DEFAULT, seed: int = SEED, size: int = 8, render=None) -> DataFrame:
    """``scene, psnr, ssim, mae`` of merged and finished bursts against the clean (or rendered) scenes."""
    merged = B.merge_bursts(scene_bursts(spark, seed, size))
    done = B.map_frames(merged, lambda f: K.finish(f, params))
    return B.measure(done, truths(spark, render), ("burst_id",)).withColumnRenamed("burst_id", "scene")


def rendition_quality(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """The same for the stronger rendition, against clean scenes rendered without noise."""
    from dataclasses import replace

    target = replace(P.RENDITION, white_balance=0.0, chroma_denoise=0.0)
    return pipeline_quality(spark, P.RENDITION, seed, render=lambda f: K.finish(f, target))


def hdr_quality(spark: SparkSession, seed: int = 0xDEC1) -> DataFrame:
    """One row: fused against truth, and its darkest and brightest tenths against the best single exposure."""

    def run(batches):
        for batch in batches:
            for job in batch.itertuples(index=False):
                truth = S.hdr_truth()
                fused, merged = K.hdr(*S.hdr_burst(int(job.seed)))
                fused = K.finish(fused)
                singles = [K.finish(f) for f in merged.values()]
                codes = np.sort(K.luma_int(truth).ravel())
                n = max(1, int(len(codes) * 0.1))
                dark, bright = K.luma_int(truth) <= codes[n - 1], K.luma_int(truth) >= codes[len(codes) - n]
                row = {"psnr": K.psnr(fused, truth), "ssim": K.ssim(fused, truth), "mae": K.mae(fused, truth)}
                for name, mask in (("shadow", dark), ("highlight", bright)):
                    row[f"{name}_mae"] = K.mae(fused[mask], truth[mask])
                    row[f"best_single_{name}_mae"] = min(K.mae(f[mask], truth[mask]) for f in singles)
                yield pd.DataFrame([row])

    schema = "psnr double, ssim double, mae double, shadow_mae double, best_single_shadow_mae double, highlight_mae double, best_single_highlight_mae double"
    return spark.createDataFrame([(seed,)], "seed long").mapInPandas(run, schema)


def amplitude(f: np.ndarray, box, period: float) -> float:
    x0, y0, x1, y1 = box
    v, phase = K.luma(f)[y0:y1, x0:x1], 2 * np.pi * np.arange(x0, x1) / period
    return 2 * float(np.hypot((v * np.cos(phase)).sum(), (v * np.sin(phase)).sum())) / v.size


def super_resolution_quality(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """One row: what comes back of bars that half the size cannot hold."""

    def run(batches):
        for batch in batches:
            for job in batch.itertuples(index=False):
                truth, frames = S.resolution_truth(), S.resolution_burst(int(job.seed))
                sharp, merged = K.super_resolve(frames)
                plain = K.upsample2x(frames[0])
                row = {}
                for name, period in (("above", S.ABOVE), ("near", S.NEAR)):
                    row[f"{name}_amplitude"] = amplitude(sharp, S.BANDS[name], period)
                    row[f"{name}_bilinear"] = amplitude(plain, S.BANDS[name], period)
                row["recovery"] = row["above_amplitude"] / row["above_bilinear"]
                yield pd.DataFrame([row | {"mae": K.mae(sharp, truth), "merged_mae": K.mae(K.upsample2x(merged), truth)}])

    names = "above_amplitude above_bilinear near_amplitude near_bilinear recovery mae merged_mae".split()
    return spark.createDataFrame([(seed,)], "seed long").mapInPandas(run, ", ".join(f"{n} double" for n in names))


def night_quality(spark: SparkSession, seed: int = SEED) -> DataFrame:
    """One row: a dark, drifting burst merged and finished for night against its clean scene."""
    frames = S.night_burst(seed)
    bursts = B.from_arrays(spark, frames, burst_id=["night"] * len(frames))
    done = B.map_frames(B.merge_bursts(bursts, "night"), lambda f: K.finish(f, P.NIGHT))
    return B.measure(done, B.from_arrays(spark, [S.night()], burst_id=["night"]), ("burst_id",)).withColumnRenamed("burst_id", "scene")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
