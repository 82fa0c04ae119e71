"""Image files in and out, as far as the installed libraries go.

JPEG and PNG need Pillow, which is optional; portable pixmaps (PPM) are read and written without it.
Files are listed and read by Spark's ``binaryFile`` source, so any store that Spark reads will do;
decoding, sampling included, happens on the executors.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from prismgrid.plans import blocks as B

try:
    from PIL import Image
except ImportError:  # pragma: no cover - not installed here
    Image = None

MAX_PIXELS = 12_500_000


def sample_size(width: int, height: int, most: int = MAX_PIXELS) -> int:
    """Smallest power of two by which an image fits ``most`` pixels."""
    step = 1
    while width > 0 and height > 0 and (width // step) * (height // step) > most:
        step *= 2
    return step


def to_ppm(f: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (f.shape[1], f.shape[0]) + B.encode(f)


def _ppm_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, where pixels begin) of a binary PPM of depth 255."""
    numbers, at = [], 2
    while len(numbers) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    if numbers[2] != 255:
        raise ValueError("only 8-bit pixmaps")
    return numbers[0], numbers[1], at + 1


def decode(data: bytes, rotation: int = 0, most: int = MAX_PIXELS) -> np.ndarray:
    """Bounds first, then pixels at the sampled size, then upright."""
    if data[:2] == b"P6":
        w, h, at = _ppm_header(data)
        f = np.frombuffer(data, np.uint8, w * h * 3, at).reshape(h, w, 3)
        step = sample_size(w, h, most)
        f = f[: h // step * step : step, : w // step * step : step]
    elif Image is not None:
        image = Image.open(io.BytesIO(data))
        step = sample_size(*image.size, most)
        image.draft("RGB", (image.width // step, image.height // step))
        f = np.asarray(image.convert("RGB"))
    else:
        raise ValueError("this image format needs Pillow")
    return np.rot90(f, -(rotation % 360) // 90) if rotation % 360 else f


def read_frames(spark: SparkSession, path: str, most: int = MAX_PIXELS, pattern: str = "*") -> DataFrame:
    """``path, frame_id, width, height, rgb`` of the image files under a path; ids follow the path's hash."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                f = decode(r.content, most=most)
                yield pd.DataFrame({"path": [r.path], "frame_id": [r.id], "width": [f.shape[1]], "height": [f.shape[0]], "rgb": [B.encode(f)]})

    from pyspark.sql import functions as F

    named = files.select("path", F.xxhash64("path").alias("id"), "content")
    return named.mapInPandas(run, "path string, frame_id long, width int, height int, rgb binary")


def with_files(frames: DataFrame) -> DataFrame:
    """Frames with the bytes of a picture file in ``file`` (quality 95 where JPEG can be written)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = []
            for r in batch.itertuples(index=False):
                f = B.decode(r.rgb, r.width, r.height)
                if Image is None:
                    files.append(to_ppm(f))
                else:
                    out = io.BytesIO()
                    Image.fromarray(f).save(out, "JPEG", quality=95)
                    files.append(out.getvalue())
            yield batch.assign(file=files)

    kept = ", ".join(f"{c} {t}" for c, t in frames.dtypes)
    return frames.mapInPandas(run, f"{kept}, file binary")


def save(frames: DataFrame, path: str) -> None:
    """Publish frames as a table: Spark's commit makes all of them visible at once or none."""
    frames.write.parquet(path)
