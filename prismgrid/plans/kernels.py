"""NumPy kernels of the frame and tile layouts.

A frame is ``uint8 (h, w, 3)``, a plane ``float64 (h, w)``. The kernels compute what the pixel-row
operators compute (tests hold them against each other); they exist because a neighbourhood of
hundreds of pixels is cheaper as an array than as rows. Nothing here touches Spark.
"""

from __future__ import annotations

import math

import numpy as np

from prismgrid.functions import color
from prismgrid.operators.finish import (
    ANALYSIS_PIXELS,
    DEFAULT,
    EPS_DETAIL,
    EPS_FINE,
    TILED_PIXELS,
    Params,
    rolloff_radius,
)
from prismgrid.operators.stats import CUE_FLOOR, MAX_GAIN, NEUTRAL, PROBE_SHARE, PROBE_SLACK, RAMP, USABLE_SHARE

WR, WG, WB = color.WEIGHTS


def code(x: np.ndarray) -> np.ndarray:
    """Nearest 8-bit codes, halves up."""
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def smoothstep(lo: float, hi: float, x):
    t = np.clip((x - lo) / (hi - lo), 0, 1)
    return t * t * (3 - 2 * t)


def luma(f: np.ndarray) -> np.ndarray:
    f = f.astype(np.float64)
    return WR * f[..., 0] + WG * f[..., 1] + WB * f[..., 2]


def luma_int(f: np.ndarray) -> np.ndarray:
    f = f.astype(np.int64)
    return (299 * f[..., 0] + 587 * f[..., 1] + 114 * f[..., 2] + 500) // 1000


def _line_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Means along the last axis, ends repeated."""
    wide = np.concatenate([np.repeat(x[..., :1], radius + 1, -1), x, np.repeat(x[..., -1:], radius, -1)], -1)
    total = np.cumsum(wide, -1)
    return (total[..., 2 * radius + 1 :] - total[..., : -(2 * radius + 1)]) / (2 * radius + 1)


def box(x: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square, edges repeated."""
    if radius == 0:
        return x.astype(np.float64)
    x = np.asarray(x, np.float64)
    return _line_mean(_line_mean(x, radius).swapaxes(-1, -2), radius).swapaxes(-1, -2)


def extreme(x: np.ndarray, radius: int, pick=np.maximum) -> np.ndarray:
    """Largest (smallest) value of a square cut at the edges, by doubling spans."""
    for axis in (0, 1):
        x = np.moveaxis(x, axis, 0)
        fill = -np.inf if pick is np.maximum else np.inf
        pad = np.full((radius, *x.shape[1:]), fill)
        y, span, want = np.concatenate([pad, x, pad]), 1, 2 * radius + 1
        while 2 * span <= want:
            y, span = pick(y[: len(y) - span], y[span:]), 2 * span
        if span < want:
            y = pick(y[: len(y) - (want - span)], y[want - span :])
        x = np.moveaxis(y, 0, axis)
    return x


def guided(plane: np.ndarray, guide: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """A plane smoothed along the edges of a guide."""
    mg = box(guide, radius)
    spread = np.maximum(box(guide * guide, radius) - mg * mg, 0)
    if plane is guide:
        slope, mp = spread / (spread + eps), mg
        rest = mg * (1 - slope)
    else:
        mp = box(plane, radius)
        slope = (box(plane * guide, radius) - mp * mg) / (spread + eps)
        rest = mp - slope * mg
    return box(slope, radius) * guide + box(rest, radius)


def robust_sigma(x: np.ndarray, least: float = 1.0) -> float:
    x = np.asarray(x, np.float64).ravel()
    return max(1.4826 * float(np.median(np.abs(x - np.median(x)))), least) if x.size else least


# --- masks ------------------------------------------------------------------------------------


def skin_likelihood(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    r, g, b = (f[..., k].astype(np.float64) for k in range(3))
    cb = (128 - 0.168736 * r - 0.331264 * g + 0.5 * b - 107) / 14
    cr = (128 + 0.5 * r - 0.418688 * g - 0.081312 * b - 152) / 13
    return (1 - smoothstep(1.0, 2.2, np.hypot(cb, cr))) * smoothstep(6, 14, y)


def sky_position(at: np.ndarray) -> np.ndarray:
    return np.interp(at, [0, 0.6, 0.75], [1, 0.3, 0])


def masks(f: np.ndarray, y: np.ndarray, row: int, height: int) -> dict[str, np.ndarray]:
    """Sky, overcast and foliage masks of rows ``row...`` of an image of a height."""
    r, g, b = (f[..., k].astype(np.float64) for k in range(3))
    at = sky_position((row + np.arange(len(f))) / height)[:, None]
    cr, cg, cb = r - y, g - y, b - y
    sky = smoothstep(8, 30, cb) * (1 - smoothstep(6, 26, cr)) * (0.4 + 0.6 * smoothstep(90, 150, y)) * at
    energy = box((y - box(y, 12)) ** 2, 12)
    over = (1 - smoothstep(12, 36, energy)) * smoothstep(140, 180, y) * (1 - smoothstep(6, 12, np.hypot(cr, cb))) * at
    leaf = smoothstep(8, 24, cg) * (1 - smoothstep(6, 26, cr)) * (1 - smoothstep(2, 22, cb))
    leaf = leaf * smoothstep(18, 46, y) * (1 - smoothstep(205, 236, y))
    return {n: np.clip(box(m, 12), 0, 1) for n, m in (("sky", sky), ("overcast", over), ("foliage", leaf))}


# --- statistics -------------------------------------------------------------------------------


def _trimmed(v: np.ndarray, share: float) -> float:
    v = np.sort(v.astype(np.int64))
    drop = int(len(v) * share)
    v = v[drop : len(v) - drop] if len(v) > 2 * drop else v
    return float(v.sum()) / len(v)


def _admitted(f: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    top, low = f.max(-1).astype(np.float64), f.min(-1)
    saturation = np.divide(top - low, top, out=np.zeros_like(top), where=top > 0)
    return (y >= 0.12 * 255) & (y <= 0.92 * 255) & (saturation <= most)


def white_balance_gains(f: np.ndarray) -> tuple[float, float]:
    """Gains of red and blue (green is 1)."""
    flat = f.reshape(-1, 3)
    y, n = luma(flat), len(flat)
    gray = flat[_admitted(flat, y, 0.6)]
    milli = flat.astype(np.int64) @ np.array([299, 587, 114])
    ordered = np.sort(milli)
    at = lambda p: ordered[min(max(int(math.floor(p * (n - 1) + 0.5)), 0), n - 1)]
    bright = flat[(milli >= at(0.90)) & (milli <= at(0.99)) & (flat.max(-1) < 250)]
    if len(gray) + len(bright) < max(1, math.floor(n * USABLE_SHARE + 0.5)):
        return 1.0, 1.0
    cues = []
    if len(gray):
        cues.append((len(gray), [_trimmed(gray[:, k], 0.1) for k in range(3)]))
    if len(bright):
        cues.append((len(bright), bright.mean(0).tolist()))
    cues = [c for c in cues if min(c[1]) > 1e-6]
    if not cues:
        return 1.0, 1.0
    probe = flat[_admitted(flat, y, 0.10)]
    out = []
    for k in (0, 2):
        weight = [max(float(c[0]), CUE_FLOOR) for c in cues]
        raw = sum(w * c[1][1] / c[1][k] for w, c in zip(weight, cues, strict=True)) / sum(weight)
        if len(probe) >= max(1, math.floor(n * PROBE_SHARE + 0.5)) and probe.mean(0).min() > 1e-6:
            p = probe[:, 1].mean() / probe[:, k].mean()
            raw = min(max(raw, min(1.0, p * (1 - PROBE_SLACK))), max(1.0, p * (1 + PROBE_SLACK)))
        gap = raw - 1
        eased = 1 + gap * float(smoothstep(NEUTRAL, NEUTRAL + RAMP, abs(gap)))
        out.append(1.0 if abs(gap) <= NEUTRAL else min(max(eased, 1 / MAX_GAIN), MAX_GAIN))
    return out[0], out[1]


def backlit_strength(f: np.ndarray) -> float:
    y = luma(f)
    dark, bright, mid = (float(m.mean()) for m in ((y >= 24) & (y < 60), y > 160, (y >= 70) & (y <= 150)))
    steps = ((dark - 0.25) / 0.1, (bright - 0.15) / 0.1, (0.35 - mid) / 0.1)
    return min(float(smoothstep(0, 1, s)) for s in steps)


def analysis_frame(f: np.ndarray) -> np.ndarray:
    """Block means down to the analysis size."""
    h, w = f.shape[:2]
    k = 1
    while (w // k) * (h // k) > ANALYSIS_PIXELS:
        k += 1
    if k == 1:
        return f
    oh, ow = max(1, h // k), max(1, w // k)
    return code(f[: oh * k, : ow * k].reshape(oh, k, ow, k, 3).astype(np.float64).mean((1, 3)))


# --- stages -----------------------------------------------------------------------------------


def _moved(old: np.ndarray, new: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
    return code(new if keep is None else old + keep[..., None] * (new - old))


def balance(f: np.ndarray, gains: tuple[float, float], strength: float) -> np.ndarray:
    by = np.array([1 + strength * (gains[0] - 1), 1.0, 1 + strength * (gains[1] - 1)])
    return code(f * by)


def denoise_chroma(f: np.ndarray, strength: float) -> np.ndarray:
    y = luma(f)
    cb, cr = f[..., 2] - y, f[..., 0] - y
    cb = cb + strength * (guided(cb, y, 4, EPS_FINE) - cb)
    cr = cr + strength * (guided(cr, y, 4, EPS_FINE) - cr)
    return code(np.stack([y + cr, y - (WR * cr + WB * cb) / WG, y + cb], -1))


def local_tone(f: np.ndarray, strength: float, keep=None) -> np.ndarray:
    s, y = min(max(strength, 0.0), 1.0), luma(f)
    base = guided(y, y, 16, EPS_FINE)
    new = 128 + (base - 128) * (1 - 0.15 * s) + (1 + 0.15 * s) * (y - base)
    ratio = np.clip((new + 1) / (y + 1), 0.25, 4)
    return _moved(f.astype(np.float64), f * ratio[..., None], keep)


def detail_of(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = luma(f)
    return y, y - guided(y, y, 3, EPS_DETAIL)


def detail_knee(f: np.ndarray) -> float:
    return 2.0 * robust_sigma(detail_of(f)[1], least=0.0)


def enhance_detail(f: np.ndarray, strength: float, keep=None, knee: float | None = None) -> np.ndarray:
    y, d = detail_of(f)
    knee = 2.0 * robust_sigma(d, least=0.0) if knee is None else knee
    square = d * d
    cored = np.divide(d * square, square + knee * knee, out=np.zeros_like(d), where=square > 0)
    sharp = y + 0.6 * min(max(strength, 0.0), 1.0) * cored
    sharp = np.clip(sharp, extreme(y, 1, np.minimum) - 5, extreme(y, 1) + 5)
    ratio = np.clip((sharp + 1) / (y + 1), 0.25, 4)
    return _moved(f.astype(np.float64), f * ratio[..., None], keep)


def grade(f: np.ndarray, p: Params, keep=None) -> np.ndarray:
    """Tone curve, saturation and contrast."""
    f = np.array(color.tone_table(p.shadows_lift, p.highlight_rolloff), np.uint8)[f]
    y = luma_int(f)[..., None].astype(np.float64)
    f = _moved(f.astype(np.float64), y + p.saturation * (f - y), keep)
    return code(128 + p.contrast * (f.astype(np.float64) - 128))


def roll_off_chroma(f: np.ndarray, strength: float, radius: int) -> np.ndarray:
    y = luma(f)
    m = np.hypot(f[..., 0] - y, f[..., 2] - y)
    knee = np.maximum(30, 1.5 * extreme(box(m, radius), radius // 2))
    over = m - knee
    full = np.divide(knee + over / (1 + over / 18), m, out=np.ones_like(m), where=m > knee)
    scale = np.where(m > knee, 1 + strength * (full - 1), 1)[..., None]
    return code(y[..., None] + (f - y[..., None]) * scale)


def render_regions(f: np.ndarray, m: dict[str, np.ndarray], strength: float) -> np.ndarray:
    y = luma(f)
    cb, cr = f[..., 2] - y, f[..., 0] - y
    smooth = strength * 0.7 * np.maximum(m["sky"], m["overcast"])
    cb = cb + smooth * (guided(cb, y, 8, EPS_FINE) - cb)
    cr = cr + smooth * (guided(cr, y, 8, EPS_FINE) - cr)
    lifted = y + strength * 4 * m["foliage"]
    extra = strength * (0.14 * m["sky"] + 0.16 * m["foliage"])
    cap = strength * (12 * m["sky"] + 8 * m["foliage"])
    size = np.hypot(cr, cb)
    safe = np.maximum(size, 1e-300)
    wanted = np.minimum(size * (1 + extra), size + cap) / safe
    a = np.clip(lifted, 0, 255)
    room = np.full_like(y, np.inf)
    for c in (cr, cb, -(WR * cr + WB * cb) / WG):
        up = np.divide(255 - a, c, out=np.full_like(c, np.inf), where=c > 1e-9)
        down = np.divide(-a, c, out=np.full_like(c, np.inf), where=c < -1e-9)
        room = np.minimum(room, np.minimum(up, down))
    scale = np.where((size > 1e-6) & (extra > 0), np.minimum(wanted, np.maximum(1, room)), 1)
    cb, cr = cb * scale, cr * scale
    return code(np.stack([lifted + cr, lifted - (WR * cr + WB * cb) / WG, lifted + cb], -1))


def rescue_factor(width: int, height: int, most: int = 2_000_000) -> int:
    """Block size at which the base of the backlit rescue has at most ``most`` pixels."""
    if width * height <= most:
        return 1
    k = max(2, math.ceil(math.sqrt(width * height / most)))
    while -(-width // k) * -(-height // k) > most:
        k += 1
    return k


def rescue_gain(base: np.ndarray) -> np.ndarray:
    base = np.maximum(base, 1)
    gain = np.where(base < 150, np.minimum((158 / (base + 8)) ** 0.9, 7.5), 1)
    protect = smoothstep(150, 220, base)
    return gain * (1 - protect) + protect


def rescue_backlit(f: np.ndarray, engagement: float, factor: int | None = None) -> np.ndarray:
    """Lift shadows against a bright background; large frames take the gain from block means."""
    if engagement <= 0:
        return f
    h, w = f.shape[:2]
    y, eps = luma(f), (0.035 * 255) ** 2
    k = factor or rescue_factor(w, h)
    if k == 1:
        gain = rescue_gain(guided(y, y, 32, eps))
    else:
        dh, dw = -(-h // k), -(-w // k)
        sums, area = np.zeros((dh, dw)), np.zeros((dh, dw))
        np.add.at(sums, (np.arange(h)[:, None] // k, np.arange(w)[None, :] // k), y)
        np.add.at(area, (np.arange(h)[:, None] // k, np.arange(w)[None, :] // k), 1.0)
        small = sums / area
        coarse = rescue_gain(guided(small, small, max(1, 32 // k), eps))
        gain = bilinear(coarse, ((np.arange(w) - (k - 1) * 0.5) / k)[None, :], ((np.arange(h) - (k - 1) * 0.5) / k)[:, None])
    eff = 1 + min(engagement, 1.0) * (gain - 1)
    lift = np.clip((eff - 1) / 6.5, 0, 1)
    v = f * np.stack([eff * (1 + 0.05 * lift), eff, eff * (1 - 0.05 * 0.7 * lift)], -1)
    eased = np.minimum(210 + 45 * (1 - np.exp(-np.maximum(v - 210, 0) / 45)), 255)
    return code(np.where(v <= 210, v, eased))


def region_finish(f: np.ndarray, p: Params, gains, knee: float | None, row: int, height: int, width: int) -> np.ndarray:
    """All stages but the rescue on a region whose statistics are known (knee None: its own)."""
    if p.white_balance > 0:
        f = balance(f, gains, p.white_balance)
    if p.chroma_denoise > 0:
        f = denoise_chroma(f, p.chroma_denoise)
    y, keep, regions = luma(f), None, None
    if p.skin_protection > 0:
        skin = np.clip(box(skin_likelihood(f, y), 8), 0, 1)
        keep = (1 - p.skin_protection * skin).astype(np.float32).astype(np.float64)
    if p.semantic > 0:
        regions = masks(f, y, row, height)
    if p.local_contrast > 0:
        f = local_tone(f, p.local_contrast, keep)
    if p.detail > 0:
        f = enhance_detail(f, p.detail, keep, knee)
    f = grade(f, p, keep)
    if p.chroma_rolloff > 0:
        f = roll_off_chroma(f, p.chroma_rolloff, rolloff_radius(width))
    if regions is not None:
        f = render_regions(f, regions, p.semantic)
    return f


def rescued(f: np.ndarray, p: Params) -> np.ndarray:
    if p.backlit_rescue <= 0:
        return f
    return rescue_backlit(f, p.backlit_rescue * (backlit_strength(f) if p.rescue_gated else 1.0))


def finish_stats(small: np.ndarray, p: Params) -> tuple[tuple[float, float], float]:
    """Gains and detail knee from the analysis frame (without modulation), for the tiled path."""
    gains = white_balance_gains(small) if p.white_balance > 0 else (1.0, 1.0)
    if p.detail <= 0:
        return gains, 0.0
    f = balance(small, gains, p.white_balance) if p.white_balance > 0 else small
    f = denoise_chroma(f, p.chroma_denoise) if p.chroma_denoise > 0 else f
    f = local_tone(f, p.local_contrast) if p.local_contrast > 0 else f
    return gains, detail_knee(f)


#: How far the fixed stages look (two radii per guided filter), without the roll-off.
FIXED_SUPPORT = 2 * (4 + 16 + 3 + 8)


def halo(width: int) -> int:
    radius = rolloff_radius(width)
    return FIXED_SUPPORT + radius + radius // 2 + 2


def finish_tiled(f: np.ndarray, p: Params, tile: int = 512, stats=None) -> np.ndarray:
    """The chain by tiles with a halo, statistics once; input is already rescued."""
    h, w = f.shape[:2]
    gains, knee = stats or finish_stats(analysis_frame(f), p)
    edge, out = halo(w), np.empty_like(f)
    for y0 in range(0, h, tile):
        for x0 in range(0, w, tile):
            y1, x1 = min(y0 + tile, h), min(x0 + tile, w)
            py, px = max(0, y0 - edge), max(0, x0 - edge)
            part = region_finish(f[py : y1 + edge, px : x1 + edge], p, gains, knee, py, h, w)
            out[y0:y1, x0:x1] = part[y0 - py : y1 - py, x0 - px : x1 - px]
    return out


def finish(f: np.ndarray, p: Params = DEFAULT) -> np.ndarray:
    """The whole chain on a frame; frames of nine megapixels go by tiles."""
    f = rescued(f, p)
    h, w = f.shape[:2]
    if h * w >= TILED_PIXELS:
        return finish_tiled(f, p)
    gains = white_balance_gains(analysis_frame(f)) if p.white_balance > 0 else (1.0, 1.0)
    return region_finish(f, p, gains, None, 0, h, w)


# --- alignment and merging ---------------------------------------------------------------------


def bilinear(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Read between pixels, clamped; trailing axes of ``plane`` are channels."""
    h, w = plane.shape[:2]
    x, y = np.broadcast_arrays(np.clip(x, 0, w - 1), np.clip(y, 0, h - 1))
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if plane.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    p = plane if plane.dtype.kind == "f" else plane.astype(np.float64)
    top = p[y0, x0] + (p[y0, x1] - p[y0, x0]) * fx
    low = p[y1, x0] + (p[y1, x1] - p[y1, x0]) * fx
    return top + (low - top) * fy


def half(p: np.ndarray) -> np.ndarray:
    h, w = p.shape[0] // 2 * 2, p.shape[1] // 2 * 2
    q = p[:h, :w]
    return (q[::2, ::2] + q[::2, 1::2] + q[1::2, ::2] + q[1::2, 1::2] + 2) // 4


def _span(start: int, stop: int, step: int, limit: int) -> tuple[int, int]:
    """The part of start..stop whose places moved by ``step`` stay within 0..limit."""
    return max(start, -step), max(max(start, -step), min(stop, limit - step))


def _overlap(ref: np.ndarray, frame: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Absolute differences on the reference grid, 0 where the moved frame does not reach."""
    out = np.zeros(ref.shape, np.int32)
    (y0, y1), (x0, x1) = _span(0, ref.shape[0], dy, frame.shape[0]), _span(0, ref.shape[1], dx, frame.shape[1])
    np.abs(ref[y0:y1, x0:x1] - frame[y0 + dy : y1 + dy, x0 + dx : x1 + dx], out=out[y0:y1, x0:x1])
    return out


def _counts(shape: tuple[int, int], frame: tuple[int, int], dx: int, dy: int, tile: int) -> np.ndarray:
    """How many pixels of each tile the moved frame reaches."""
    sides = []
    for size, limit, step in zip(shape, frame, (dy, dx), strict=True):
        a, b = _span(0, size, step, limit)
        begin = np.arange(0, size, tile)
        sides.append(np.maximum(np.minimum(np.minimum(begin + tile, size), b) - np.maximum(begin, a), 0))
    return sides[0][:, None] * sides[1][None, :]


def _search(ref, frame, cx: int, cy: int, radius: int):
    h, w = ref.shape
    mx, my = int(w * 0.5 / 2), int(h * 0.5 / 2)
    least = max(1, (w - 2 * mx) * (h - 2 * my) // 2)
    best = (math.inf, cy, cx)
    for dy in range(cy - radius, cy + radius + 1):
        for dx in range(cx - radius, cx + radius + 1):
            (y0, y1), (x0, x1) = _span(my, h - my, dy, frame.shape[0]), _span(mx, w - mx, dx, frame.shape[1])
            n = (y1 - y0) * (x1 - x0)
            if n >= least:
                d = np.abs(ref[y0:y1, x0:x1] - frame[y0 + dy : y1 + dy, x0 + dx : x1 + dx])
                mad = float(d.sum(dtype=np.int64)) / n
                if mad < best[0]:
                    best = (mad, dy, dx)
    return best


def _tile_sums(x: np.ndarray, tile: int) -> np.ndarray:
    h, w = x.shape
    x = np.add.reduceat(x, np.arange(0, h, tile), 0)
    return np.add.reduceat(x, np.arange(0, w, tile), 1).astype(np.int64)


def _coarse(ref, frame, radius: int = 8):
    h, w = ref.shape
    rows, cols = h // 8, w // 8
    if rows * cols < 3:
        return _search(ref, frame, 0, 0, radius)
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    mads = np.full((len(steps), rows, cols), np.nan)
    for k, (dy, dx) in enumerate(steps):
        s = _tile_sums(_overlap(ref, frame, dx, dy)[: rows * 8, : cols * 8], 8)
        n = _counts(ref.shape, frame.shape, dx, dy, 8)[:rows, :cols]
        mads[k] = np.where(n >= 32, s / np.maximum(n, 1), np.nan)
    filled = np.where(np.isnan(mads), np.inf, mads)
    low, at = filled.min(0), filled.argmin(0)
    high = np.where(np.isnan(mads), -np.inf, mads).max(0)
    sure = np.isfinite(low) & (high - low >= np.maximum(1.0, 0.25 * low))
    if sure.sum() < 3:
        return _search(ref, frame, 0, 0, radius)
    votes = np.array(steps)[at[sure]]
    dy, dx = (math.floor(float(np.median(votes[:, k])) + 0.5) for k in (0, 1))
    return _search(ref, frame, dx, dy, 0)


def pair_offset(ref: np.ndarray, other: np.ndarray) -> tuple[int, int, float]:
    """(dx, dy, difference) of a plane on another, over a pyramid; sizes may differ."""
    levels, own = [ref.astype(np.int32)], [other.astype(np.int32)]
    while len(levels) < 3 and min(*levels[-1].shape, *own[-1].shape) >= 2:
        levels.append(half(levels[-1]))
        own.append(half(own[-1]))
    mad, dy, dx = _coarse(levels[-1], own[-1])
    for k in range(len(levels) - 2, -1, -1):
        mad, dy, dx = _search(levels[k], own[k], 2 * dx, 2 * dy, 2)
    return dx, dy, mad


def accepted(differences: list[float]) -> list[bool]:
    """Which frames of a burst fit the reference, by the median of their differences."""
    limit = 4 * max(float(np.median(differences)), 1.0) if differences else 0
    return [not d > limit for d in differences]


def align(lumas: list[np.ndarray]) -> list[tuple[int, int, float, bool]]:
    """(dx, dy, difference, accepted) of each frame on the first."""
    found = [pair_offset(lumas[0], other) for other in lumas[1:]]
    return [(0, 0, 0.0, True), *((*f, ok) for f, ok in zip(found, accepted([m for *_, m in found]), strict=True))]


def tile_offsets(ref: np.ndarray, frame: np.ndarray, dx: int, dy: int, tile: int = 32, dead: float = 0.1):
    """Offsets (x, y) of tiles to fractions of a pixel."""
    ref, frame = ref.astype(np.int32), frame.astype(np.int32)
    mads = {}
    for j in range(-3, 4):
        for i in range(-3, 4):
            s, n = _tile_sums(_overlap(ref, frame, dx + i, dy + j), tile), _counts(ref.shape, frame.shape, dx + i, dy + j, tile)
            mads[j, i] = np.where(n > 0, s / np.maximum(n, 1), np.nan)
    inner = [(j, i) for j in range(-2, 3) for i in range(-2, 3)]
    stack = np.array([np.where(np.isnan(mads[k]), np.inf, mads[k]) for k in inner])
    at, low = stack.argmin(0), stack.min(0)
    every = np.array([[mads[j, i] for i in range(-3, 4)] for j in range(-3, 4)])
    bj, bi = np.array(inner)[at, 0], np.array(inner)[at, 1]
    r, c = np.indices(low.shape)
    near = lambda dj, di: every[bj + dj + 3, bi + di + 3, r, c]

    def part(a, b):
        bend = a + b - 2 * low
        with np.errstate(invalid="ignore", divide="ignore"):
            v = np.clip(np.where(bend > 1e-12, 0.5 * (a - b) / bend, 0), -0.5, 0.5)
        v = np.where(np.isnan(a) | np.isnan(b) | ~np.isfinite(low), 0, v)
        return np.where(np.abs(v) < dead, 0, v)

    some = np.isfinite(low)
    ox = np.where(some, dx + bi + part(near(0, -1), near(0, 1)), dx)
    oy = np.where(some, dy + bj + part(near(-1, 0), near(1, 0)), dy)
    return ox.astype(np.float64), oy.astype(np.float64)


def field(grid: np.ndarray, x: np.ndarray, y: np.ndarray, tile: int = 32) -> np.ndarray:
    """A tile grid read at pixel places, linear between tile centres."""
    return bilinear(grid, (x - tile / 2) / tile, (y - tile / 2) / tile)


def ghost(diff, sigma: float, lo: float = 3.0, hi: float = 8.0):
    s = max(sigma, 1.0)
    return np.clip((hi * s - np.abs(diff)) / (hi * s - lo * s), 0, 1)


def spread(ref: np.ndarray, f: np.ndarray, offset) -> tuple[float, float]:
    """Robust spreads of the differences between a moved frame and the reference, plain and smoothed, on every
    fourth pixel of every fourth row."""
    h, w = ref.shape[:2]
    y, x = np.mgrid[0:h:4, 0:w:4]
    sx, sy = x + field(offset[0], x, y), y + field(offset[1], x, y)
    rl, soft = luma_int(ref).astype(np.float64), box(luma_int(f).astype(np.float64), 3)
    plain = luma(bilinear(f, sx, sy)) - rl[::4, ::4]
    return robust_sigma(plain), robust_sigma(bilinear(soft, sx, sy) - box(rl, 3)[::4, ::4])


def merge_region(ref: np.ndarray, core, frames, night: bool, scales) -> np.ndarray:
    """Weighted mean on a region of the reference. ``ref`` is cut at ``(y, x)`` and its core is the last four of
    ``core = (y, x, y0, x0, y1, x1)``, in places of the whole frame; ``frames`` holds ``(cut, y, x, offset,
    spread, smoothed spread, usual spread)`` of the others."""
    ry, rx, y0, x0, y1, x1 = core
    y, x = np.mgrid[y0:y1, x0:x1]
    inner = (slice(y0 - ry, y1 - ry), slice(x0 - rx, x1 - rx))
    soft = luma_int(ref).astype(np.float64)
    rl, rlp, own_ref = soft[inner], box(soft, 3)[inner], ref[inner]
    total, weight = own_ref.astype(np.float64), np.ones(rl.shape)
    for f, fy, fx, o, s, sl, usual in frames:
        sx, sy = x + field(o[0], x, y) - fx, y + field(o[1], x, y) - fy
        rgb = bilinear(f, sx, sy)
        d = luma(rgb) - rl
        dl = bilinear(box(luma_int(f).astype(np.float64), 3), sx, sy) - rlp
        own = 1 / (1 + max(s - usual, 0) / max(usual, 1.0)) if night else 1.0
        k = own * np.minimum(ghost(d, s, *scales), ghost(dl, sl, *scales))
        total += k[..., None] * rgb
        weight += k
    return np.where((weight <= 1.001)[..., None], own_ref, code(total / weight[..., None]))


def merge_aligned(frames, offsets, scales=(3.0, 8.0), night: bool = False) -> np.ndarray:
    """Weighted mean on the first frame; ``offsets`` are tile grids or None."""
    ref, kept = frames[0], [(f, o) for f, o in zip(frames[1:], offsets[1:], strict=True) if o is not None]
    sigmas = [spread(ref, f, o) for f, o in kept]
    usual = float(np.median([s for s, _ in sigmas])) if kept else 1.0
    others = [(f, 0, 0, o, s, sl, usual) for (f, o), (s, sl) in zip(kept, sigmas, strict=True)]
    return merge_region(ref, (0, 0, 0, 0, *ref.shape[:2]), others, night, scales)


def scales_of(night: bool) -> tuple[float, float]:
    return (4.0, 12.0) if night else (3.0, 8.0)


def brightness_gain(f: np.ndarray, ref: np.ndarray) -> float:
    def mean(v):
        v = np.sort(luma(v).ravel())
        drop = min(int(len(v) * 0.05), (len(v) - 1) // 2)
        return float(v[drop : len(v) - drop].mean())

    own = mean(f)
    return 1.0 if own <= 0 else min(max(mean(ref) / own, 0.7), 1.4)


def merge(frames: list[np.ndarray], night: bool = False):
    """(merged, frames used, offsets) of a burst."""
    if len(frames) == 1:
        return frames[0], 1, [(0, 0)]
    if night:
        frames = [frames[0], *(code(f * brightness_gain(f, frames[0])) for f in frames[1:])]
    lumas = [luma_int(f) for f in frames]
    found = align(lumas)
    tiles = [None, *(tile_offsets(lumas[0], p, a[0], a[1]) if a[3] else None for p, a in zip(lumas[1:], found[1:], strict=True))]
    merged = merge_aligned(frames, tiles, scales_of(night), night)
    return merged, sum(a[3] for a in found), [(a[0], a[1]) for a in found]


# --- exposures --------------------------------------------------------------------------------

_KERNEL = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16


def _down_line(p: np.ndarray) -> np.ndarray:
    wide = np.concatenate([p[..., :1], p[..., :1], p, p[..., -1:], p[..., -1:]], -1)
    n = p.shape[-1]
    return sum(_KERNEL[t] * wide[..., t : t + n : 1] for t in range(5))[..., ::2]


def pyramid_down(p: np.ndarray) -> np.ndarray:
    return _down_line(_down_line(p).swapaxes(0, 1)).swapaxes(0, 1)


def _up_line(p: np.ndarray, size: int) -> np.ndarray:
    left = np.concatenate([p[..., :1], p[..., :-1]], -1)
    right = np.concatenate([p[..., 1:], p[..., -1:]], -1)
    out = np.empty((*p.shape[:-1], 2 * p.shape[-1]))
    out[..., ::2] = 2 * (left + 6 * p + right) / 16
    out[..., 1::2] = 2 * (4 * p + 4 * right) / 16
    return out[..., :size]


def pyramid_up(p: np.ndarray, h: int, w: int) -> np.ndarray:
    return _up_line(_up_line(p, w).swapaxes(0, 1), h).swapaxes(0, 1)


def gaussian(p: np.ndarray, least: int = 8) -> list[np.ndarray]:
    out = [p]
    while min((s + 1) // 2 for s in out[-1].shape) >= least:
        out.append(pyramid_down(out[-1]))
    return out


def laplacian(g: list[np.ndarray]) -> list[np.ndarray]:
    return [*(a - pyramid_up(b, *a.shape) for a, b in zip(g, g[1:], strict=False)), g[-1]]


def collapse(bands: list[np.ndarray]) -> np.ndarray:
    out = bands[-1]
    for band in bands[-2::-1]:
        out = band + pyramid_up(out, *band.shape)
    return out


def exposure_weight(f: np.ndarray, ev: float) -> np.ndarray:
    z = luma(f) / 255 - 0.5
    w = np.exp(-(z * z) / (2 * 0.2 * 0.2))
    if ev > 0:
        w[f.max(-1) >= 250] = 0
    elif ev < 0:
        w[f.min(-1) <= 5] = 0
    return w


def fuse_pyramid(frames: list[np.ndarray], evs: list[float], selectivity: float = 0.7) -> np.ndarray:
    w = np.array([exposure_weight(f, e) ** selectivity for f, e in zip(frames, evs, strict=True)])
    total = w.sum(0)
    w = np.where(total <= 1e-6, 1 / len(w), w / np.where(total <= 1e-6, 1, total))
    weights = [gaussian(v) for v in w]
    out = []
    for c in range(3):
        bands = [laplacian(gaussian(f[..., c].astype(np.float64))) for f in frames]
        out.append(collapse([sum(wt[k] * b[k] for wt, b in zip(weights, bands, strict=True)) for k in range(len(bands[0]))]))
    return code(np.stack(out, -1))


def fuse_plain(frames, evs, radius: int = 8) -> np.ndarray:
    w = [box(exposure_weight(f, e), radius) + 1e-6 for f, e in zip(frames, evs, strict=True)]
    return code(sum(k[..., None] * f for k, f in zip(w, frames, strict=True)) / sum(w)[..., None])


def hdr(frames: list[np.ndarray], evs: list[float]):
    """(fused, {ev: merged}) of a bracketed burst: merge per exposure, align on the one nearest 0, fuse."""
    merged = {ev: merge([f for f, e in zip(frames, evs, strict=True) if e == ev])[0] for ev in sorted(set(evs))}
    centre = min(merged, key=lambda e: (abs(e), e))
    ref = luma_int(merged[centre])
    y, x = np.mgrid[0 : ref.shape[0], 0 : ref.shape[1]]
    for ev, f in merged.items():
        if ev != centre:
            own = luma_int(f)
            dx, dy, _, _ = align([ref, own])[1]
            ox, oy = tile_offsets(ref, own, dx, dy)
            merged[ev] = code(bilinear(f, x + field(ox, x, y), y + field(oy, x, y)))
    return fuse_pyramid(list(merged.values()), list(merged)), merged


# --- super-resolution ---------------------------------------------------------------------------


def upsample2x(f: np.ndarray) -> np.ndarray:
    h, w = f.shape[:2]
    return code(bilinear(f, np.arange(2 * w)[None, :] / 2, np.arange(2 * h)[:, None] / 2))


def super_resolve(frames: list[np.ndarray]):
    """(twice the size, merged): frames, whatever their sizes, splatted on the finer grid of the first
    where the offset field puts them."""
    ref = frames[0]
    if len(frames) == 1:
        return upsample2x(ref), ref
    h, w = ref.shape[:2]
    lumas = [luma_int(f) for f in frames]
    soft = [box(p.astype(np.float64), 2) for p in lumas]
    codes = [np.floor(s + 0.5).astype(np.int64) for s in soft]
    found = align(lumas)
    tiles = [None, *(tile_offsets(codes[0], c, a[0], a[1], dead=0.0) if a[3] else None for c, a in zip(codes[1:], found[1:], strict=True))]
    merged = merge_aligned(frames, tiles)
    sums = np.zeros((4 * h * w, 4))
    for f, o, s in zip(frames, tiles, soft, strict=True):
        if o is None and f is not ref:
            continue
        y, x = np.mgrid[0 : f.shape[0], 0 : f.shape[1]].astype(np.float64)
        if o is None:
            rx, ry, k = x, y, np.ones((h, w))
        else:
            gx, gy = x - field(o[0], x, y), y - field(o[1], x, y)
            rx, ry = x - field(o[0], gx, gy), y - field(o[1], gx, gy)
            d = s - bilinear(soft[0], rx, ry)
            k = ghost(d, robust_sigma(d[::4, ::4]))
        tx, ty = 2 * rx, 2 * ry
        x0, y0 = np.floor(tx).astype(np.int64), np.floor(ty).astype(np.int64)
        fx, fy = tx - x0, ty - y0
        for j in (0, 1):
            for i in (0, 1):
                wt = k * (fx if i else 1 - fx) * (fy if j else 1 - fy)
                px, py = x0 + i, y0 + j
                ok = (wt > 0) & (px >= 0) & (px < 2 * w) & (py >= 0) & (py < 2 * h)
                at, wt = (py * 2 * w + px)[ok], wt[ok]
                for c in range(3):
                    sums[:, c] += np.bincount(at, wt * f[..., c][ok], len(sums))
                sums[:, 3] += np.bincount(at, wt, len(sums))
    covered = sums[:, 3] > 1e-3
    mean = code(sums[:, :3] / np.where(covered, sums[:, 3], 1)[:, None])
    out = np.where(covered[:, None], mean, upsample2x(merged).reshape(-1, 3))
    return out.reshape(2 * h, 2 * w, 3), merged


# --- depth of field ------------------------------------------------------------------------------


def bokeh_params(width: int) -> dict[str, int]:
    scaled = lambda base, least: max(int(math.floor(base * width / 2000 + 0.5)), least)
    return {"max_radius": scaled(12, 1), "feather": scaled(12, 1), "smooth": scaled(2, 0)}


def bokeh_halo(max_radius: int = 12, feather: int = 12, smooth: int = 2) -> int:
    """How far the rendering of a pixel looks."""
    return max_radius + 2 + 2 * feather + smooth


def disc_taps(n: int) -> np.ndarray:
    i = np.arange(n)
    r, a = np.sqrt((i + 0.5) / n), i * math.pi * (3 - math.sqrt(5))
    return np.stack([r * np.cos(a), r * np.sin(a)], 1)


def _even_blur(flat: np.ndarray, radius: float, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the taps at one radius everywhere: shifted planes instead of reads by place."""
    h, w = flat.shape[:2]
    edge = int(math.ceil(radius)) + 1
    wide = np.pad(flat, ((edge, edge + 1), (edge, edge + 1), (0, 0)), mode="edge")
    total, plain = np.zeros((h, w, 4), np.float32), np.zeros((h, w, 3), np.float32)
    for dx, dy in taps:
        x0, y0 = math.floor(dx * radius), math.floor(dy * radius)
        fx, fy = np.float32(dx * radius - x0), np.float32(dy * radius - y0)
        rows = wide[edge + y0 : edge + y0 + h + 1, edge + x0 : edge + x0 + w + 1]
        v = (1 - fx) * rows[:, :-1] + fx * rows[:, 1:]
        v = (1 - fy) * v[:-1] + fy * v[1:]
        plain += v[..., :3]
        v[..., :3] *= v[..., 3:]
        total += v
    return total, plain


def disc_blur(rgb: np.ndarray, radius: np.ndarray, weight: np.ndarray | None, taps: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Mean over the taps of a disc of varying radius, weighted; single precision. Where the radius is the
    largest one, as in all of a background, planes are shifted as a whole."""
    h, w = radius.shape
    k = np.ones((h, w), np.float32) if weight is None else weight.astype(np.float32)
    image = np.dstack([rgb.astype(np.float32), k])  # colour and weight in one read
    flat = image.reshape(-1, 4)
    out = rgb.astype(np.float32).copy()

    def mean(total, plain, mass):
        enough = mass > 1e-4
        return np.where(enough, total / np.where(enough, mass, 1), plain / np.float32(len(taps)))

    top = float(radius.max()) if radius.size else 0.0
    even = (radius == np.float32(top)) & (top >= least)
    if even.sum() > 4096:
        rows, columns = np.flatnonzero(even.any(1)), np.flatnonzero(even.any(0))
        edge = int(math.ceil(top)) + 2  # the part of the frame that is wanted, and what it reads
        y0, y1, x0, x1 = rows[0], rows[-1] + 1, columns[0], columns[-1] + 1
        py, px = max(0, y0 - edge), max(0, x0 - edge)
        sums, plain = _even_blur(image[py : y1 + edge, px : x1 + edge], top, taps)
        at = np.argwhere(even)
        here = (at[:, 0] - py, at[:, 1] - px)
        out[even] = mean(sums[here][:, :3], plain[here], sums[here][:, 3:])
    else:
        even[:] = False
    at = np.argwhere((radius >= least) & ~even)
    for s in range(0, len(at), 16_384):
        py, px = at[s : s + 16_384].T
        r = radius[py, px].astype(np.float64)
        total, plain = np.zeros((len(r), 3), np.float32), np.zeros((len(r), 3), np.float32)
        mass = np.zeros((len(r), 1), np.float32)
        for dx, dy in taps:
            x, y = np.clip(px + dx * r, 0, w - 1), np.clip(py + dy * r, 0, h - 1)
            x0, y0 = x.astype(np.int32), y.astype(np.int32)
            fx, fy = (x - x0).astype(np.float32)[:, None], (y - y0).astype(np.float32)[:, None]
            right, down = (x0 < w - 1).astype(np.int32), (y0 < h - 1) * np.int32(w)
            i = y0 * w + x0
            v = (1 - fy) * ((1 - fx) * flat[i] + fx * flat[i + right]) + fy * ((1 - fx) * flat[i + down] + fx * flat[i + down + right])
            total += v[:, 3:] * v[:, :3]
            plain += v[:, :3]
            mass += v[:, 3:]
        out[py, px] = mean(total, plain, mass)
    return out


def bokeh(f: np.ndarray, mask: np.ndarray, max_radius: int = 12, feather: int = 12, smooth: int = 2, strength: float = 1.0, taps: int = 24) -> np.ndarray:
    """Blur what the mask leaves out, brighter near clipping, composed along a feathered mask."""
    y = luma(f)
    m = np.clip(box(guided(mask.astype(np.float64), y, feather, 150.0), smooth), 0, 1)
    back = (1 - m.astype(np.float32)).astype(np.float32)
    radius = (max_radius * (1 - m) * strength).astype(np.float32)
    boost = 1 + 2.0 * strength
    gain = (1 + (boost - 1) * smoothstep(235, 255, f.max(-1).astype(np.float64)) * back).astype(np.float32)
    blurred = disc_blur(f.astype(np.float32) * gain[..., None], radius, back, disc_taps(taps))
    sharp = f.astype(np.float32)
    return code((sharp + back[..., None] * (blurred - sharp)).astype(np.float64))


# --- looks and metrics ----------------------------------------------------------------------------


def lut_sample(lut: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Trilinear read of ``lut[b, g, r]`` (float32) at colours in 0..1."""
    n = len(lut) - 1
    at = np.clip(rgb.astype(np.float32), 0, 1) * np.float32(n)
    lo = np.floor(at).astype(np.int64)
    hi = np.minimum(lo + 1, n)
    t = (at - lo).astype(np.float32)
    pick = lambda b, g, r: lut[(hi if b else lo)[..., 2], (hi if g else lo)[..., 1], (hi if r else lo)[..., 0]]
    mix = lambda a, b, k: a + (b - a) * k[..., None]
    plane = [mix(mix(pick(b, 0, 0), pick(b, 0, 1), t[..., 0]), mix(pick(b, 1, 0), pick(b, 1, 1), t[..., 0]), t[..., 1]) for b in (0, 1)]
    return mix(plane[0], plane[1], t[..., 2])


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    d = a.astype(np.int64) - b
    mse = float((d * d).sum()) / d.size
    return math.inf if mse == 0 else 10 * math.log10(255 * 255 / mse)


def mae(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a.astype(np.int64) - b).sum()) / a.size


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    windows = lambda p: np.lib.stride_tricks.sliding_window_view(p, (8, 8))[::4, ::4]
    u, v = windows(luma(a)), windows(luma(b))
    mu, mv = u.mean((2, 3)), v.mean((2, 3))
    su, sv, cov = (u * u).mean((2, 3)) - mu * mu, (v * v).mean((2, 3)) - mv * mv, (u * v).mean((2, 3)) - mu * mv
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * mu * mv + c1) * (2 * cov + c2) / ((mu * mu + mv * mv + c1) * (su + sv + c2))).mean())
