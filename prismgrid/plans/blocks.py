"""The block layouts: one row per frame, per tile or per burst, worked on by the array kernels.

``frames``: ``frame_id long, width int, height int, rgb binary`` (row-major, three bytes a pixel),
plus any columns of the caller's. A frame is one row, so frames spread over the cluster without a
shuffle; a burst is a group by ``burst_id``. Frames too large for one task go as tiles with a halo
(:func:`finish_tiles`): statistics come from the small analysis frame, tiles are cut where the rows
are, and each finished core is written back by its place. Memory per task is bounded by one frame,
one burst or one padded tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.operators.finish import DEFAULT, Params
from prismgrid.plans import kernels as K
from prismgrid.sources.shared import barrier

FRAMES = "frame_id long, width int, height int, rgb binary"


def encode(f: np.ndarray) -> bytes:
    return np.ascontiguousarray(f, np.uint8).tobytes()


def decode(rgb: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def from_arrays(spark: SparkSession, frames: list[np.ndarray], **columns) -> DataFrame:
    """Frames of the caller as a frame table; keyword columns hold one value per frame."""
    rows = pd.DataFrame(
        {
            "frame_id": range(len(frames)),
            "width": [f.shape[1] for f in frames],
            "height": [f.shape[0] for f in frames],
            "rgb": [encode(f) for f in frames],
            **columns,
        }
    )
    kinds = {str: "string", float: "double", int: "long", bool: "boolean"}
    extra = "".join(f", {n}: {kinds[type(v[0])]}" for n, v in columns.items())
    return spark.createDataFrame(rows, FRAMES.replace(" long", ": long").replace(" int", ": int").replace(" binary", ": binary") + extra)


def to_pixels(frames: DataFrame) -> DataFrame:
    """A frame table as pixel rows ``frame_id, y, x, r, g, b`` (and the other columns)."""
    rest = [c for c in frames.columns if c not in ("width", "height", "rgb")]

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                f = decode(row.rgb, row.width, row.height)
                y, x = np.mgrid[0 : row.height, 0 : row.width].astype(np.int32)
                out = pd.DataFrame({c: getattr(row, c) for c in rest}, index=range(f.shape[0] * f.shape[1]))
                out["y"], out["x"] = y.ravel(), x.ravel()
                for k, c in enumerate("rgb"):
                    out[c] = f[..., k].ravel().astype(np.int32)
                yield out

    kept = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in rest)
    return frames.mapInPandas(explode, f"{kept}, y int, x int, r int, g int, b int")


def from_pixels(px: DataFrame) -> DataFrame:
    """Dense pixel rows as a frame table; each frame is gathered in one task, as a frame row is."""

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        w, h = int(group["x"].max()) + 1, int(group["y"].max()) + 1
        f = np.zeros((h, w, 3), np.uint8)
        f[group["y"], group["x"]] = group[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"frame_id": [group["frame_id"].iloc[0]], "width": [w], "height": [h], "rgb": [encode(f)]})

    return px.select("frame_id", "y", "x", "r", "g", "b").groupBy("frame_id").applyInPandas(gather, FRAMES)


def map_frames(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel to every frame; other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [kernel(decode(r.rgb, r.width, r.height)) for r in batch.itertuples(index=False)]
            yield batch.assign(width=[f.shape[1] for f in done], height=[f.shape[0] for f in done], rgb=[encode(f) for f in done])

    return frames.mapInPandas(run, frames.schema)


def finish_frames(frames: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The finishing chain on every frame."""
    return map_frames(frames, lambda f: K.finish(f, params))


def merge_bursts(frames: DataFrame, kind: str = "plain") -> DataFrame:
    """``burst_id, used, width, height, rgb``: each burst as one frame.

    ``frames`` has ``burst_id`` and, for ``hdr``, ``ev``; the frame of smallest ``frame_id`` is the
    reference. ``kind``: plain, night, hdr, super (twice the size) or single.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame_id")
        own = [decode(r.rgb, r.width, r.height) for r in group.itertuples(index=False)]
        used = len(own)
        if kind == "hdr":
            out, _ = K.hdr(own, group["ev"].tolist())
        elif kind == "super":
            out, _ = K.super_resolve(own)
        elif kind == "single":
            out = own[0]
        else:
            out, used, _ = K.merge(own, night=kind == "night")
        return pd.DataFrame(
            {"burst_id": [group["burst_id"].iloc[0]], "used": [used], "width": [out.shape[1]], "height": [out.shape[0]], "rgb": [encode(out)]}
        )

    kept = f"burst_id {frames.schema['burst_id'].dataType.simpleString()}"
    return frames.groupBy("burst_id").applyInPandas(run, f"{kept}, used int, width int, height int, rgb binary")


def render_bokeh(frames: DataFrame, scaled: bool = True) -> DataFrame:
    """Depth of field on frames with a ``mask`` column (float32 bytes of the frame's size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                p = K.bokeh_params(r.width) if scaled else {}
                mask = np.frombuffer(r.mask, np.float32).reshape(r.height, r.width)
                out.append(encode(K.bokeh(decode(r.rgb, r.width, r.height), mask, **p)))
            yield batch.assign(rgb=out).drop(columns="mask")

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name != "mask")
    return frames.mapInPandas(run, kept)


def bokeh_tiles(frames: DataFrame, scaled: bool = True, tile: int = 384) -> DataFrame:
    """Depth of field with one task per tile: ``frame_id, ty, tx, y0, x0, width, height, rgb``.

    Tiles are cut where the rows are, with a halo of what a pixel looks at, and dealt evenly.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f = decode(r.rgb, r.width, r.height)
                mask = np.frombuffer(r.mask, np.float32).reshape(r.height, r.width)
                p = K.bokeh_params(r.width) if scaled else {}
                edge = K.bokeh_halo(**p)
                for y0, x0, own in _tiles(r.height, r.width, tile, edge):
                    part = f[own]
                    place = (r.frame_id, y0 // tile, x0 // tile, y0, x0, own[0].start, own[1].start, part.shape[1], part.shape[0], r.width, r.height)
                    row = (*place, encode(part), np.ascontiguousarray(mask[own]).tobytes())
                    yield pd.DataFrame([row], columns=names)

    schema = "frame_id long, ty int, tx int, y0 int, x0 int, py int, px int, pw int, ph int, iw int, ih int, rgb binary, mask binary"
    names = [c.split()[0] for c in schema.split(", ")]
    tiles = frames.select("frame_id", "width", "height", "rgb", "mask").mapInPandas(cut, schema).repartition("frame_id", "ty", "tx")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                p = K.bokeh_params(r.iw) if scaled else {}
                mask = np.frombuffer(r.mask, np.float32).reshape(r.ph, r.pw)
                done = K.bokeh(decode(r.rgb, r.pw, r.ph), mask, **p)
                core = done[r.y0 - r.py : min(r.y0 + tile, r.ih) - r.py, r.x0 - r.px : min(r.x0 + tile, r.iw) - r.px]
                out.append((r.frame_id, r.ty, r.tx, r.y0, r.x0, core.shape[1], core.shape[0], encode(core)))
            yield pd.DataFrame(out, columns=["frame_id", "ty", "tx", "y0", "x0", "width", "height", "rgb"])

    return tiles.mapInPandas(work, TILES)


TILES = "frame_id long, ty int, tx int, y0 int, x0 int, width int, height int, rgb binary"


def _tiles(height: int, width: int, tile: int, edge: int):
    """``(y0, x0, (rows, columns) with the halo)`` of a frame's tiles."""
    for y0 in range(0, height, tile):
        for x0 in range(0, width, tile):
            rows = slice(max(0, y0 - edge), min(y0 + tile + edge, height))
            yield y0, x0, (rows, slice(max(0, x0 - edge), min(x0 + tile + edge, width)))


def merge_tiles(frames: DataFrame, night: bool = False, tile: int = 512) -> DataFrame:
    """A burst as one frame, by tiles: ``burst_id, used, ty, tx, y0, x0, width, height, rgb``.

    Each frame is aligned on its burst's reference (the smallest ``frame_id``) in a task of its own; the
    offsets and spreads, a few numbers a frame, decide which frames are used; every frame is then cut
    into the pieces that a tile of the reference needs of it, and a tile's pieces meet in one task. The
    frame is that of the reference; frames of other sizes are read at their edge beyond it.
    """
    burst = frames.schema["burst_id"].dataType.simpleString()
    rows = frames.select("burst_id", "frame_id", "width", "height", "rgb")
    first = rows.groupBy("burst_id").agg(F.min("frame_id").alias("first"))
    rows = rows.join(first, "burst_id")
    ref = rows.filter("frame_id = first").select("burst_id", F.col("rgb").alias("ref"), F.col("width").alias("rw"), F.col("height").alias("rh"))

    def measure_pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f, own = decode(r.rgb, r.width, r.height), decode(r.ref, r.rw, r.rh)
                gain = K.brightness_gain(f, own) if night else 1.0
                f = K.code(f * gain) if night else f
                a, b = K.luma_int(own), K.luma_int(f)
                dx, dy, mad = K.pair_offset(a, b)
                grid = K.tile_offsets(a, b, dx, dy)
                s, sl = K.spread(own, f, grid)
                blob = np.stack(grid).tobytes()
                yield pd.DataFrame([(r.burst_id, r.frame_id, gain, mad, s, sl, grid[0].shape[0], grid[0].shape[1], blob)], columns=kept)

    found = f"burst_id {burst}, frame_id long, gain double, mad double, s double, sl double, gh int, gw int, grid binary"
    kept = [c.split()[0] for c in found.split(", ")]
    others = rows.filter("frame_id <> first").join(ref, "burst_id").repartition("burst_id", "frame_id")
    facts = barrier(others.mapInPandas(measure_pair, found), "pairs")
    # Acceptance and the usual spread are medians over a burst's few frames.
    limit = facts.groupBy("burst_id").agg((4 * F.greatest(F.median("mad"), F.lit(1.0))).alias("most"))
    used = facts.join(limit, "burst_id").filter("mad <= most").drop("most")
    usual = used.groupBy("burst_id").agg(F.median("s").alias("usual"), F.count(F.lit(1)).cast("int").alias("others"))
    used = rows.join(used, ["burst_id", "frame_id"], "left").join(usual, "burst_id", "left").join(ref.drop("ref"), "burst_id")
    used = used.filter("frame_id = first or mad is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f, is_ref = decode(r.rgb, r.width, r.height), r.frame_id == r.first
                grid = None if is_ref else np.frombuffer(r.grid, np.float64).reshape(2, int(r.gh), int(r.gw))
                low, high = ([0, 0], [0, 0]) if is_ref else (np.floor(grid.min((1, 2))), np.ceil(grid.max((1, 2))))
                for y0 in range(0, r.rh, tile):
                    for x0 in range(0, r.rw, tile):
                        # Four pixels around for the smoothing and the reads between pixels, also of the edge where a tile lies beyond it.
                        span = lambda at, k, size: (max(0, min(at + int(low[k]), size - 1) - 5), min(max(at + tile + int(high[k]), 1) + 5, size))
                        (a, b), (c, d) = span(y0, 1, r.height), span(x0, 0, r.width)
                        part = f[a:b, c:d] if is_ref or not night else K.code(f[a:b, c:d] * r.gain)
                        facts_ = (0.0, 0.0, 1.0, 0, 0, None) if is_ref else (r.s, r.sl, r.usual, int(r.gh), int(r.gw), r.grid)
                        count = 0 if pd.isna(r.others) else int(r.others)
                        yield pd.DataFrame([(r.burst_id, y0 // tile, x0 // tile, y0, x0, r.frame_id, is_ref, a, c, d - c, b - a, r.rw, r.rh, count, *facts_, encode(part))], columns=names)

    schema = (
        f"burst_id {burst}, ty int, tx int, y0 int, x0 int, frame_id long, is_ref boolean, py int, px int, pw int, ph int, iw int, ih int, "
        "others int, s double, sl double, usual double, gh int, gw int, grid binary, rgb binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("frame_id")
        own = group[group["is_ref"]].iloc[0]
        y0, x0 = int(own["y0"]), int(own["x0"])
        y1, x1 = min(y0 + tile, int(own["ih"])), min(x0 + tile, int(own["iw"]))
        moved = [
            (decode(r.rgb, r.pw, r.ph), r.py, r.px, np.frombuffer(r.grid, np.float64).reshape(2, r.gh, r.gw), r.s, r.sl, r.usual)
            for r in group[~group["is_ref"]].itertuples(index=False)
        ]
        core = (int(own["py"]), int(own["px"]), y0, x0, y1, x1)
        out = K.merge_region(decode(own["rgb"], own["pw"], own["ph"]), core, moved, night, K.scales_of(night))
        row = (own["burst_id"], int(own["others"]) + 1, int(own["ty"]), int(own["tx"]), y0, x0, x1 - x0, y1 - y0, encode(out))
        return pd.DataFrame([row], columns=["burst_id", "used", *[c.split()[0] for c in TILES.split(", ")[1:]]])

    pieces = used.mapInPandas(cut, schema)
    kind = f"burst_id {burst}, used int, " + TILES.partition(", ")[2]
    return pieces.groupBy("burst_id", "ty", "tx").applyInPandas(merge, kind)


def apply_look(frames: DataFrame, lut: np.ndarray) -> DataFrame:
    """A 3-D lookup table (``lut[b, g, r]``, float32) on every frame."""
    return map_frames(frames, lambda f: K.code(K.lut_sample(lut, f / np.float32(255)).astype(np.float64) * 255))


def finish_tiles(frames: DataFrame, params: Params = DEFAULT, tile: int = 512) -> DataFrame:
    """The chain with one task per tile instead of per frame: ``frame_id, ty, tx, y0, x0, width,
    height, rgb`` of the finished cores.

    A first pass over the frames rescues backlight, takes the statistics and cuts padded tiles; the
    tiles are then dealt evenly and finished apart.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f = K.rescued(decode(r.rgb, r.width, r.height), params)
                (gr, gb), knee = K.finish_stats(K.analysis_frame(f), params)
                edge = K.halo(r.width)
                for y0 in range(0, r.height, tile):
                    for x0 in range(0, r.width, tile):
                        py, px = max(0, y0 - edge), max(0, x0 - edge)
                        part = f[py : min(y0 + tile, r.height) + edge, px : min(x0 + tile, r.width) + edge]
                        row = (r.frame_id, y0 // tile, x0 // tile, y0, x0, py, px, part.shape[1], part.shape[0], r.width, r.height, gr, gb, knee, encode(part))
                        yield pd.DataFrame([row], columns=names)

    schema = (
        "frame_id long, ty int, tx int, y0 int, x0 int, py int, px int, pw int, ph int, iw int, ih int, "
        "gain_r double, gain_b double, knee double, rgb binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    # Tiles follow a hash of their place: a few large frames still fill all tasks.
    tiles = frames.select("frame_id", "width", "height", "rgb").mapInPandas(cut, schema).repartition("frame_id", "ty", "tx")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                f = decode(r.rgb, r.pw, r.ph)
                done = K.region_finish(f, params, (r.gain_r, r.gain_b), r.knee, r.py, r.ih, r.iw)
                core = done[r.y0 - r.py : min(r.y0 + tile, r.ih) - r.py, r.x0 - r.px : min(r.x0 + tile, r.iw) - r.px]
                out.append((r.frame_id, r.ty, r.tx, r.y0, r.x0, core.shape[1], core.shape[0], encode(core)))
            yield pd.DataFrame(out, columns=["frame_id", "ty", "tx", "y0", "x0", "width", "height", "rgb"])

    return tiles.mapInPandas(work, TILES)


def assemble(tiles: DataFrame, key: str = "frame_id") -> DataFrame:
    """Finished tiles as a frame table again, one row for each ``key``; ``used`` stays if it is there."""
    more = [c for c in ("used",) if c in tiles.columns]

    def paste(group: pd.DataFrame) -> pd.DataFrame:
        w, h = int((group["x0"] + group["width"]).max()), int((group["y0"] + group["height"]).max())
        f = np.zeros((h, w, 3), np.uint8)
        for r in group.itertuples(index=False):
            f[r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = decode(r.rgb, r.width, r.height)
        row = {key: [group[key].iloc[0]]} | {c: [group[c].iloc[0]] for c in more}
        return pd.DataFrame(row | {"width": [w], "height": [h], "rgb": [encode(f)]})

    kept = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in (key, *more))
    return tiles.groupBy(key).applyInPandas(paste, f"{kept}, width int, height int, rgb binary")


def measure(frames: DataFrame, truth: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, psnr, ssim, mae`` of frames against the truths of equal keys."""
    other = truth.select(*keys, F.col("rgb").alias("truth"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            pairs = [(decode(r.rgb, r.width, r.height), decode(r.truth, r.width, r.height)) for r in batch.itertuples(index=False)]
            for name, metric in (("psnr", K.psnr), ("ssim", K.ssim), ("mae", K.mae)):
                out[name] = [metric(a, b) for a, b in pairs]
            yield out

    kept = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    joined = frames.select(*keys, "width", "height", "rgb").join(other, list(keys))
    return joined.mapInPandas(run, f"{kept}, psnr double, ssim double, mae double")
