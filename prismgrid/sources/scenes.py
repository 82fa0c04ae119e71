"""Deterministic synthetic scenes, their noise and their bursts.

Scenes are 128 x 128 (the resolution chart 256). Random numbers come from a 32-bit linear
congruential generator whose n-th state is computed directly, so noise is addressed by pixel and
needs no order. Frames are ``uint8 (h, w, 3)``; :func:`pixels` makes them pixel tables and
:func:`chart_pixels` builds the closed-form scenes as expressions without leaving the engine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.functions import color
from prismgrid.plans import kernels as K

SIZE = 128
NAMES = ("edges", "texture", "gradients", "lowlight", "highcontrast", "colorchart")

#: The generator, the step between the seeds of a burst's frames and of a report's scenes. Fixed values.
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32
FRAME_STEP, SCENE_STEP = 0x9E3779B1, 0x1000193

#: Colour patches of the chart, row by row. Fixed values.
PATCHES = (
    (150, 20, 20), (120, 210, 215), (20, 110, 30), (240, 190, 205), (25, 35, 140), (225, 215, 90),
    (150, 200, 240), (90, 25, 120), (190, 225, 180), (110, 70, 45), (245, 205, 175), (20, 90, 95),
    (140, 25, 60), (210, 195, 235), (85, 80, 20), (255, 220, 180), (30, 60, 150), (235, 230, 185),
    (245, 215, 195), (30, 95, 55), (195, 230, 235), (130, 30, 110), (225, 180, 140), (60, 30, 120),
    (150, 80, 20), (170, 225, 150), (20, 100, 110), (245, 200, 210), (100, 40, 150), (195, 215, 240),
    (50, 50, 50), (210, 210, 210), (75, 75, 75), (195, 195, 195), (40, 40, 40), (225, 225, 225),
)

#: Regions of the skin chart: name, colour, box (x0, y0, x1, y1), skin, textured. Fixed values.
SKIN_REGIONS = (
    ("light", (247, 214, 185), (0, 0, 32, 32), True, False),
    ("fair", (241, 194, 167), (32, 0, 64, 32), True, False),
    ("medium", (222, 168, 128), (64, 0, 96, 32), True, False),
    ("olive", (186, 129, 92), (96, 0, 128, 32), True, False),
    ("brown", (135, 90, 62), (0, 32, 32, 64), True, False),
    ("deep", (88, 58, 42), (32, 32, 64, 64), True, False),
    ("foliage", (60, 110, 45), (64, 32, 96, 64), False, False),
    ("sky", (110, 155, 210), (96, 32, 128, 64), False, False),
    ("fabric", (200, 30, 40), (0, 64, 32, 96), False, False),
    ("neutral", (128, 128, 128), (32, 64, 64, 96), False, False),
    ("texskin", (222, 168, 128), (64, 64, 128, 128), True, True),
    ("texnonskin", (150, 150, 150), (0, 96, 64, 128), False, True),
)


def jumps(bits: int = 32) -> list[tuple[int, int]]:
    """(multiplier, increment) of 1, 2, 4, ... steps of the generator at once."""
    out, a, c = [], MULTIPLIER, INCREMENT
    for _ in range(bits):
        out.append((a, c))
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return out


def states(seed: int, index: np.ndarray) -> np.ndarray:
    """The generator's state after ``index`` steps (1 is the first number drawn)."""
    state = np.full(index.shape, seed % MODULUS, np.uint64)
    for k, (a, c) in enumerate(jumps()):
        on = (index >> k) & 1 == 1
        if on.any():
            state[on] = (state[on] * np.uint64(a) + np.uint64(c)) & np.uint64(MODULUS - 1)
    return state


def gaussians(seed: int, index: np.ndarray) -> np.ndarray:
    """The ``index``-th normal numbers: a pair of uniforms gives two, by cosine and by sine."""
    pair = index // 2
    unit = lambda k: ((states(seed, k) >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float64) / (1 << 24)
    size = np.sqrt(-2 * np.log(np.maximum(unit(2 * pair + 1), 1e-12)))
    angle = 2 * math.pi * unit(2 * pair + 2)
    return size * np.where(index % 2 == 0, np.cos(angle), np.sin(angle))


def state_sql(seed: str, steps: str) -> str:
    """The generator's state as an expression: the jump of each bit of ``steps`` is applied in turn.

    Products are split so that they stay below 2^63.
    """
    table = ", ".join(f"struct({a}L AS a, {c}L AS c)" for a, c in jumps(26))
    times = f"(((s * (p.a div 65536L)) % 65536L) * 65536L + s * (p.a % 65536L) + p.c) % {MODULUS}L"
    return (
        f"aggregate(array({table}), named_struct('s', CAST({seed} AS BIGINT) % {MODULUS}L, 'n', CAST({steps} AS BIGINT)), "
        f"(acc, p) -> named_struct('s', CASE WHEN acc.n % 2 = 1 THEN {times.replace('s *', 'acc.s *')} ELSE acc.s END, 'n', acc.n div 2L), acc -> acc.s)"
    )


def noise_pixels(px: DataFrame, seed: int, width: int, read: float = 6.0, shot: float = 0.5) -> DataFrame:
    """Sensor noise on a pixel table as expressions: draw 3 i + channel of pixel i."""
    px = px.withColumn("_i", F.col("y").cast("long") * width + F.col("x"))
    sigma = f"sqrt({color.num(read * read)} + {color.num(shot)} * {color.luma()})"
    new = {}
    for k, c in enumerate("rgb"):
        index = f"(3L * _i + {k})"
        unit = lambda n, index=index: f"(({state_sql(str(seed), f'2L * ({index} div 2L) + {n}')}) div 256L) / 16777216e0"
        turn = f"({color.num(2 * math.pi)} * {unit(2)})"
        normal = f"sqrt(-2e0 * ln(greatest({unit(1)}, 1e-12))) * CASE WHEN {index} % 2 = 0 THEN cos({turn}) ELSE sin({turn}) END"
        new[f"_{c}"] = F.expr(color.code(f"{c} + {sigma} * {normal}"))
    px = px.withColumns(new).drop("r", "g", "b", "_i")
    return px.withColumnsRenamed({f"_{c}": c for c in "rgb"})


def noisy(f: np.ndarray, seed: int, read: float = 6.0, shot: float = 0.5, extra: np.ndarray | float = 0.0) -> np.ndarray:
    """Noise that grows with luma; draws in raster order, red, green, blue."""
    sigma = np.sqrt(read * read + np.square(extra) + shot * K.luma(f))
    return K.code(f + sigma[..., None] * gaussians(seed, np.arange(f.size).reshape(f.shape)))


def lattice(seed: int, cell: int, low: int = 0, high: int = 255, size: int = SIZE) -> np.ndarray:
    """Random bytes on a coarse grid, interpolated, spread over low..high."""
    n = size // cell + 2
    grid = (states(seed, np.arange(1, n * n + 1)) >> np.uint64(24)).astype(np.float64).reshape(n, n)
    at, part = np.arange(size) // cell, (np.arange(size) % cell) / cell
    y, x, fy, fx = at[:, None], at[None, :], part[:, None], part[None, :]
    top = grid[y, x] + (grid[y, x + 1] - grid[y, x]) * fx
    rest = grid[y + 1, x] + (grid[y + 1, x + 1] - grid[y + 1, x]) * fx
    return K.code(low + (top + (rest - top) * fy) / 255 * (high - low)).astype(np.int64)


def gray(v: np.ndarray) -> np.ndarray:
    return np.repeat(np.asarray(v, np.uint8)[..., None], 3, -1)


def _xy(size: int = SIZE):
    y, x = np.mgrid[0:size, 0:size]
    return x, y


def clean(name: str) -> np.ndarray:
    """One of the six scenes of the quality report."""
    x, y = _xy()
    last, mid = SIZE - 1, SIZE // 2
    if name == "edges":
        v = np.where(y < mid, np.where(x < mid, 40, 200), np.where(x < mid, 128, 90))
        for test, value in (((x - y) % 24 == 0, 230), ((x + y) % 24 == 0, 20), ((x - 2 * y) % 31 == 0, 255)):
            v = np.where(test, value, v)
        return gray(v)
    if name == "texture":
        return gray(lattice(0x7E57, 4))
    if name == "gradients":
        far = np.hypot(x - last / 2, y - last / 2) / math.hypot(last / 2, last / 2)
        return gray(K.code(0.5 * (x / last * 255) + 0.5 * ((1 - far) * 255)))
    if name == "lowlight":
        return gray(3 + lattice(0x10E0, 16) * 48 // 255)
    if name == "highcontrast":
        ramp = np.where(x < mid, np.floor(x / (mid - 1) * 25 + 0.5), np.floor(230 + (x - mid) / (mid - 1) * 25 + 0.5))
        return gray(np.clip(ramp + y % 8 - 4, 0, 255))
    if name == "colorchart":
        return np.array(PATCHES, np.uint8)[np.minimum(y * 6 // SIZE, 5) * 6 + np.minimum(x * 6 // SIZE, 5)]
    raise ValueError(f"no scene {name}")


def chart_sql(name: str, x: str = "x", y: str = "y") -> dict[str, str]:
    """Closed-form scenes as expressions of red, green, blue."""
    if name == "edges":
        mod = lambda e, n: f"((({e}) % {n} + {n}) % {n})"
        v = (
            f"CASE WHEN {mod(f'{x} - 2 * {y}', 31)} = 0 THEN 255 WHEN {mod(f'{x} + {y}', 24)} = 0 THEN 20 "
            f"WHEN {mod(f'{x} - {y}', 24)} = 0 THEN 230 WHEN {x} < 64 AND {y} < 64 THEN 40 WHEN {y} < 64 THEN 200 "
            f"WHEN {x} < 64 THEN 128 ELSE 90 END"
        )
    elif name == "gradients":
        far = f"sqrt(({x} - 63.5e0) * ({x} - 63.5e0) + ({y} - 63.5e0) * ({y} - 63.5e0)) / {color.num(math.hypot(63.5, 63.5))}"
        v = color.code(f"0.5e0 * ({x} / 127e0 * 255e0) + 0.5e0 * ((1e0 - {far}) * 255e0)")
    elif name == "highcontrast":
        low, high = color.whole(f"{x} / 63e0 * 25e0"), color.whole(f"230e0 + ({x} - 64) / 63e0 * 25e0")
        v = f"CAST(least(greatest((CASE WHEN {x} < 64 THEN {low} ELSE {high} END) + {y} % 8 - 4, 0), 255) AS INT)"
    elif name == "colorchart":
        cell = f"(CAST(floor({y} * 6 / 128e0) AS INT) * 6 + CAST(floor({x} * 6 / 128e0) AS INT))"
        pick = lambda k: f"CASE {cell} " + " ".join(f"WHEN {i} THEN {p[k]}" for i, p in enumerate(PATCHES)) + " END"
        return {c: pick(k) for k, c in enumerate("rgb")}
    else:
        raise ValueError(f"{name} has no closed form")
    return dict.fromkeys("rgb", v)


def chart_pixels(spark: SparkSession, name: str) -> DataFrame:
    """A closed-form scene as a pixel table."""
    grid = spark.range(SIZE * SIZE).select(
        F.lit(0).cast("long").alias("frame_id"), F.expr(f"CAST(floor(id / {SIZE}e0) AS INT)").alias("y"), F.expr(f"CAST(id % {SIZE} AS INT)").alias("x")
    )
    return grid.select("*", *[F.expr(e).alias(c) for c, e in chart_sql(name).items()])


def shift(f: np.ndarray, dx: int, dy: int) -> np.ndarray:
    h, w = f.shape[:2]
    return f[np.clip(np.arange(h) - dy, 0, h - 1)][:, np.clip(np.arange(w) - dx, 0, w - 1)]


def cast(f: np.ndarray, r: float, g: float, b: float) -> np.ndarray:
    """A colour cast."""
    return K.code(f * np.array([r, g, b]))


def cast_pixels(px: DataFrame, r: float, g: float, b: float) -> DataFrame:
    """A colour cast on pixel rows."""
    by = {"r": r, "g": g, "b": b}
    return px.withColumns({c: F.expr(color.gain(c, color.num(k))) for c, k in by.items()})


def drift_pixels(px: DataFrame, frames: int, across: float, down: float) -> DataFrame:
    """Frame i of ``frames`` moved by its share of ``across`` and ``down``, edges repeated."""
    share = lambda far: F.floor(F.col("frame_id") * (far / max(frames - 1, 1)) + 0.5).cast("int")
    return _shifted(px, share(across), share(down))


def shift_pixels(px: DataFrame, dx: int, dy: int) -> DataFrame:
    """Pixel rows moved by (dx, dy), edges repeated."""
    return _shifted(px, F.lit(dx), F.lit(dy))


def _shifted(px: DataFrame, dx, dy) -> DataFrame:
    """Every place takes the pixel that lies (dx, dy) before it: an equi-join on clamped places."""
    size = px.groupBy("frame_id").agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))
    inside = lambda at, most: F.least(F.greatest(at, F.lit(0)), F.col(most))
    place = px.select("frame_id", F.col("y").alias("_y"), F.col("x").alias("_x")).join(F.broadcast(size), "frame_id")
    place = place.select("frame_id", "_y", "_x", inside(F.col("_y") - dy, "_my").alias("y"), inside(F.col("_x") - dx, "_mx").alias("x"))
    moved = place.join(px, ["frame_id", "y", "x"]).drop("y", "x")
    return moved.withColumnsRenamed({"_y": "y", "_x": "x"})


def burst(f: np.ndarray, seed: int, count: int, **noise) -> list[np.ndarray]:
    return [noisy(f, seed + i * FRAME_STEP, **noise) for i in range(count)]


def _fill(f: np.ndarray, box, rgb) -> None:
    x0, y0, x1, y1 = box
    f[y0:y1, x0:x1] = rgb


# HDR: a radiance ramp with texture, captured at three exposures.
HDR_EVS = (-2.0, 0.0, 2.0)


def hdr_radiance() -> np.ndarray:
    x, y = _xy()
    texture = (lattice(0x4DE7, 8) / 255 - 0.5) * 2 * 120
    return np.clip((x + y) / (2 * (SIZE - 1)) * 1020 + texture, 0, 1020)


def hdr_truth() -> np.ndarray:
    tone = lambda v: v / 170 / (1 + v / 170)
    return gray(K.code(255 * tone(hdr_radiance()) / tone(1020)))


def hdr_burst(seed: int) -> tuple[list[np.ndarray], list[float]]:
    evs = [ev for ev in HDR_EVS for _ in range(2)]
    frames = [gray(K.code(hdr_radiance() * 2.0**ev)) for ev in evs]
    return [noisy(f, seed + i * FRAME_STEP) for i, f in enumerate(frames)], evs


# Night: a dim texture with a lamp, drifting; optionally with a moving object.
LAMP = (83, 21, 102, 40)
NIGHT_NOISE = {"read": 18.0, "shot": 1.0}


def night(moving: int | None = None) -> np.ndarray:
    f = gray(8 + lattice(0x9147, 16) * 20 // 255)
    _fill(f, LAMP, 250)
    if moving is not None:
        x0 = 8 + 5 * moving
        f[44:84, x0 : x0 + 24] = gray(lattice(0xA117, 6, 55, 85)[:40, :24])
    return f


def night_burst(seed: int, count: int = 12, moving: bool = False) -> list[np.ndarray]:
    out = []
    for i in range(count):
        t = i / (count - 1) if count > 1 else 0
        f = shift(night(i if moving else None), math.floor(3 * t + 0.5), math.floor(1.5 * t + 0.5))
        out.append(noisy(f, seed + i * FRAME_STEP, **NIGHT_NOISE))
    return out


# Resolution chart: bars above and near what half the size can hold.
ABOVE, NEAR = 8 / 3, 5.0
BANDS = {"above": (32, 96, 224, 160), "near": (32, 24, 224, 88)}
PHASES = ((0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5), (1.5, 0.5))
CHART_NOISE = {"read": 2.5, "shot": 0.08}


def chart_value(x, y):
    x, y = np.broadcast_arrays(np.asarray(x, np.float64), np.asarray(y, np.float64))
    v = 120 + 34 * np.sin(2 * math.pi * x / 53) + 20 * np.sin(2 * math.pi * y / 47 + 0.7) + 16 * (x + y) / 510
    v = np.where((y >= 96) & (y < 160), v + 34 * np.cos(2 * math.pi * x / ABOVE), v)
    return np.where((y >= 24) & (y < 88), v + 34 * np.cos(2 * math.pi * x / NEAR), v)


def resolution_truth() -> np.ndarray:
    x, y = _xy(256)
    return gray(K.code(chart_value(x, y)))


def resolution_burst(seed: int, count: int = 6) -> list[np.ndarray]:
    truth, at = resolution_truth(), 2.0 * np.arange(128)
    out = []
    for k in range(count):
        dx, dy = PHASES[k % 6]
        f = K.code(K.bilinear(truth, (at + dx)[None, :], (at + dy)[:, None]))
        out.append(noisy(f, seed + k * FRAME_STEP, **CHART_NOISE))
    return out


def warped_burst(seed: int, count: int = 6) -> list[np.ndarray]:
    """The chart moved by (7, 41) and sheared by up to two pixels, in turn to either side."""
    x, y = _xy(128)
    out = []
    for k in range(count):
        dx, dy = PHASES[k % 6] if k else (0, 0)
        ty = 2.0 * y + dy + (41 if k else 0)
        shear = 0.0 if k == 0 else (1 if k % 2 else -1) * 2 / 128 * (ty - 128)
        v = chart_value(2.0 * x + dx + (7 if k else 0) + shear, ty)
        out.append(noisy(gray(K.code(v)), seed + k * FRAME_STEP, **CHART_NOISE))
    return out


def moved_block_burst(seed: int, count: int = 6) -> list[np.ndarray]:
    out = []
    for k in range(count):
        f = gray(lattice(0x5111, 20, 70, 150))
        x0 = 86 if k else 18
        _fill(f, (x0, 52, x0 + 24, 76), 235)
        out.append(noisy(f, seed + k * FRAME_STEP, **CHART_NOISE))
    return out


def skin_chart() -> np.ndarray:
    f = np.zeros((SIZE, SIZE, 3), np.uint8)
    t = 1 + 0.18 * (lattice(0x5C1F, 3) / 255 - 0.5) * 2
    for _, rgb, (x0, y0, x1, y1), _, textured in SKIN_REGIONS:
        by = t[y0:y1, x0:x1, None] if textured else 1.0
        f[y0:y1, x0:x1] = K.code(np.array(rgb) * by * np.ones((y1 - y0, x1 - x0, 1)))
    return f


BACKLIT_SUBJECT, BACKLIT_SKIN = (28, 24, 100, 112), (46, 40, 82, 84)


def backlit_portrait() -> np.ndarray:
    wave = lambda seed, cell: (lattice(seed, cell) / 255 - 0.5) * 2
    f = gray(K.code(200 + 15 * wave(0xB4C1, 10)))
    x0, y0, x1, y1 = BACKLIT_SUBJECT
    f[y0:y1, x0:x1] = gray(K.code(37 + 8 * wave(0x5B17, 6)))[y0:y1, x0:x1]
    _fill(f, BACKLIT_SKIN, (54, 36, 26))
    return f


LIPS, FACE = (44, 80, 84, 96), (30, 40, 98, 72)
ROLLOFF_PATCHES = (((120, 150, 145), (8, 8, 32, 32)), ((160, 150, 128), (40, 8, 64, 32)), ((170, 140, 145), (72, 8, 96, 32)))


def rolloff_portrait() -> np.ndarray:
    f = np.full((SIZE, SIZE, 3), (175, 152, 138), np.uint8)
    for rgb, at in ROLLOFF_PATCHES:
        _fill(f, at, rgb)
    _fill(f, LIPS, (190, 75, 82))
    return f


def landscape() -> np.ndarray:
    t = (np.arange(44) / 43)[:, None, None]
    f = gray(np.clip(118 + lattice(0x6D17, 10) * 28 // 255 - 14, 0, 255))
    top, low = np.array([140.0, 178, 224]), np.array([92.0, 140, 208])
    f[:44] = K.code(top + (low - top) * t)
    leaf = 1 + 0.22 * (lattice(0x1EAF, 5) / 255 - 0.5) * 2
    f[44:84] = K.code(np.array([58, 108, 52]) * leaf[44:84, :, None])
    _fill(f, (88, 92, 120, 120), (206, 150, 120))
    return f


def landscape_burst(seed: int, count: int) -> list[np.ndarray]:
    extra = np.where(np.arange(SIZE) < 44, 22.0, 0.0)[:, None] * np.ones((1, SIZE))
    return burst(landscape(), seed, count, extra=extra)


def overcast() -> np.ndarray:
    f = gray(np.clip(118 + lattice(0x2F91, 10) * 28 // 255 - 14, 0, 255))
    f[:44] = gray(K.code(215 - 15 * np.arange(44) / 43))[:, None, :]
    f[44:84] = gray(K.code(200 + 20 * (lattice(0x0CA5, 7) / 255 - 0.5) * 2))[44:84]
    return f


def overcast_burst(seed: int, count: int) -> list[np.ndarray]:
    """Sky pixels draw two more numbers: chroma noise that leaves luma as it is."""
    f = overcast().astype(np.float64)
    sky = 44 * SIZE
    i = np.arange(SIZE * SIZE)
    first = np.where(i < sky, 5 * i, 5 * sky + 3 * (i - sky))
    out = []
    for k in range(count):
        draw = lambda n, s=seed + k * FRAME_STEP: gaussians(s, first + n).reshape(SIZE, SIZE)
        v = f + np.sqrt(36 + 0.5 * K.luma(f))[..., None] * np.stack([draw(0), draw(1), draw(2)], -1)
        on = (i < sky).reshape(SIZE, SIZE)
        cr, cb = np.where(on, 12 * draw(3), 0), np.where(on, 12 * draw(4), 0)
        v += np.stack([cr, -(0.299 * cr + 0.114 * cb) / 0.587, cb], -1)
        out.append(K.code(v))
    return out


def benchmark_scene(width: int, height: int, seed: int) -> np.ndarray:
    """Smooth random colour of any size."""
    out = np.empty((height, width, 3), np.uint8)
    for k, (salt, cell) in enumerate(((0x111111, 24), (0x222222, 32), (0x333333, 20))):
        gw, gh = width // cell + 2, height // cell + 2
        grid = (states(seed ^ salt, np.arange(1, gw * gh + 1)) >> np.uint64(24)).astype(np.float64).reshape(gh, gw)
        x, y = np.arange(width), np.arange(height)
        rows = K.bilinear(grid, (x / cell)[None, :], (y / cell)[:, None])
        out[..., k] = np.clip(rows, 0, 255).astype(np.uint8)
    return out


def disc_scene(width: int, height: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A textured disc before a textured background with highlights, and its mask."""
    base = benchmark_scene(width, height, seed).astype(np.int64)
    y, x = np.mgrid[0:height, 0:width]
    inside = np.hypot(x - width / 2, y - height / 2) <= 0.22 * min(width, height)
    f = np.empty((height, width, 3), np.int64)
    f[...] = np.where(inside[..., None], [165, 35, 40], [30, 150, 45])
    f[..., 0] += np.where(inside, (base[..., 0] - 128) * 40 // 128, 0)
    f[..., 1] += np.where(inside, 0, (base[..., 1] - 128) * 55 // 128)
    r = max(1, width // 200)
    for fx, fy in ((0.14, 0.16), (0.83, 0.14), (0.5, 0.06)):
        hx, hy = int(fx * width), int(fy * height)
        f[max(0, hy - r) : hy + r + 1, max(0, hx - r) : hx + r + 1] = 252
    return np.clip(f, 0, 255).astype(np.uint8), inside.astype(np.float32)


def pixels(spark: SparkSession, frames: list[np.ndarray], **columns) -> DataFrame:
    """Frames as one pixel table; extra keyword columns hold one value per frame."""
    from prismgrid.plans import blocks

    return blocks.to_pixels(blocks.from_arrays(spark, frames, **columns))
