"""Scalar rules around capturing: sizes, budgets, labels, choices. SQL expressions as in ``color``.

All rules give a value for odd input: missing or non-finite numbers fall back as stated.
"""

from __future__ import annotations

from prismgrid.functions.color import num, quotient, whole

#: Sizes in pixels and bytes of the burst planner. Fixed values.
MAX_PIXELS, MIN_PIXELS, FALLBACK_MB, MERGE_BYTES = 12_500_000, 2_000_000, 192, 32


def finite(x: str) -> str:
    return f"abs(CAST({x} AS DOUBLE)) < 1e300"


def sample_size(w: str, h: str, most: int = MAX_PIXELS) -> str:
    """Smallest power of two by which an image fits ``most`` pixels; 1 for empty sizes."""
    fits = "".join(f" WHEN floor({w} / {float(s)}e0) * floor({h} / {float(s)}e0) <= {most} THEN {s}" for s in (2**k for k in range(16)))
    return f"CASE WHEN {w} <= 0 OR {h} <= 0 THEN 1{fits} ELSE 65536 END"


def preview_size(w: str, h: str, want_w: int, want_h: int) -> str:
    """Largest power of two that keeps both sides at least as large as wanted."""
    step = lambda s: f"floor(floor({h} / 2e0) / {s}e0) >= {want_h} AND floor(floor({w} / 2e0) / {s}e0) >= {want_w}"
    cases = "".join(f" WHEN NOT ({step(float(s))}) THEN {s}" for s in (2**k for k in range(16)))
    return f"CASE{cases} ELSE 65536 END"


def burst_pixels(class_mb: str, frames: str) -> str:
    """Pixels a frame may have so that a burst fits half the memory class."""
    mb = f"(CASE WHEN {class_mb} > 0 THEN {class_mb} ELSE {FALLBACK_MB} END)"
    budget = f"floor({mb} * 524288e0 / (4e0 * greatest({frames}, 1) + {float(MERGE_BYTES)}e0))"
    return f"CAST(least(greatest({budget}, {float(MIN_PIXELS)}e0), {float(MAX_PIXELS)}e0) AS INT)"


def swaps_sides(degrees: str) -> str:
    return f"(({degrees} % 360) + 360) % 360 IN (90, 270)"


def zoom_ratio(current: str, factor: str, low: str, high: str) -> str:
    """Zoom after a gesture, within bounds, safe against non-finite numbers."""
    lo = f"(CASE WHEN {finite(low)} THEN {low} ELSE 1e0 END)"
    hi = f"(CASE WHEN {finite(high)} AND {high} >= {lo} THEN {high} ELSE {lo} END)"
    cur = f"(CASE WHEN {finite(current)} THEN least(greatest({current}, {lo}), {hi}) ELSE {lo} END)"
    by = f"(CASE WHEN {finite(factor)} AND {factor} > 0 THEN {factor} ELSE 1e0 END)"
    return f"least(greatest({cur} * {by}, {lo}), {hi})"


def tenths(x: str) -> str:
    """A non-negative number with one decimal, halves up."""
    t = whole(f"({x}) * 10e0")
    return f"CAST({quotient(t, 10)} AS VARCHAR(20)) || '.' || CAST({t} % 10 AS VARCHAR(1))"


def zoom_label(x: str) -> str:
    return f"{tenths(f'CASE WHEN {finite(x)} THEN {x} ELSE 1e0 END')} || 'x'"


def two_digits(n: str) -> str:
    return f"CASE WHEN {n} < 10 THEN '0' ELSE '' END || CAST({n} AS VARCHAR(20))"


def clock(millis: str) -> str:
    """mm:ss of milliseconds."""
    seconds = quotient(millis, 1000)
    return f"{two_digits(quotient(seconds, 60))} || ':' || {two_digits(f'({seconds} % 60)')}"


def duration(millis: str) -> str:
    """Milliseconds, or seconds with one decimal from one second on."""
    return f"CASE WHEN {millis} >= 1000 THEN {tenths(f'{millis} / 1000e0')} || 's' ELSE CAST({millis} AS VARCHAR(20)) || 'ms' END"


def breakdown(parts: dict[str, str]) -> str:
    return " || ' - ' || ".join(f"'{label} ' || {duration(ms)}" for label, ms in parts.items())


def exposure_index(target: str, numerator: str, denominator: str, low: str, high: str) -> str:
    """Exposure step nearest to a target value, within the device's range; 0 without steps."""
    raw = whole(f"{target} / ({numerator} / CAST({denominator} AS DOUBLE))")
    return f"CASE WHEN {numerator} = 0 THEN 0 ELSE least(greatest({raw}, {low}), {high}) END"


def exposure_reachable(target: str, index: str, numerator: str, denominator: str) -> str:
    step = f"(CASE WHEN {numerator} = 0 THEN 0e0 ELSE {numerator} / CAST({denominator} AS DOUBLE) END)"
    return f"abs({index} * {step} - {target}) <= {step} / 2e0 + 1e-6"


def reticle(v: str, extent: str, half: float) -> str:
    """A marker's place kept inside a side; the middle where it does not fit."""
    return f"CASE WHEN {extent} <= {num(2 * half)} THEN {extent} / 2e0 ELSE least(greatest({v}, {num(half)}), {extent} - {num(half)}) END"


def overlay(fps24: str, stable: str, range_label: str) -> str:
    base = f"(CASE WHEN {fps24} THEN '24 fps' ELSE 'auto fps' END || CASE WHEN {stable} THEN ' stabilized' ELSE '' END)"
    return f"CASE WHEN {range_label} IS NOT NULL THEN {base} || ' ' || {range_label} ELSE {base} END"


def both_labels(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} || ' ' || {b} ELSE coalesce({a}, {b}) END"


def queue_chip(stage: str, n: str) -> str:
    return f"{stage} || CASE WHEN {n} > 1 THEN ' (' || CAST({n} AS VARCHAR(20)) || ')' ELSE '' END"


def may_capture(capturing: str, n: str, most: int = 2) -> str:
    return f"(NOT {capturing} AND {n} < {most})"


def mime(known: str, video: str) -> str:
    return f"coalesce({known}, CASE WHEN {video} THEN 'video/*' ELSE 'image/*' END)"


def frame_count(n: str) -> str:
    """A stored burst size, or the default where it is none of 3, 6, 9."""
    return f"CASE WHEN {n} IN (3, 6, 9) THEN {n} ELSE 6 END"


def one_of(value: str, allowed: tuple[str, ...], default: str) -> str:
    return f"CASE WHEN {value} IN ({', '.join(repr(a) for a in allowed)}) THEN {value} ELSE '{default}' END"


def shutter(key: str, repeats: str, on_camera: str, granted: str) -> str:
    """Whether a volume key takes a picture: volume keys are 24 and 25."""
    return f"({key} IN (24, 25) AND {repeats} <= 0 AND {on_camera} AND {granted})"


def working_set(pixels: str) -> str:
    """Bytes of 19 double and 2 integer planes."""
    return f"({pixels} * 160)"


def tiled_peak(w: str, h: str, factor: str, tile: int = 512) -> str:
    """Bytes at the peak of tiled finishing."""
    radius = f"least(greatest({whole(f'24e0 * {w} / 1542e0')}, 24), 96)"
    halo = f"(64 + {radius} + {quotient(radius, 2)})"
    side = f"CAST({tile} + 2 * {halo} AS BIGINT)"
    small = f"CAST(floor({w} / CAST({factor} AS DOUBLE)) * floor({h} / CAST({factor} AS DOUBLE)) AS BIGINT)"
    return f"(8 * CAST({w} AS BIGINT) * {h} + greatest({working_set(f'{side} * {side}')}, {working_set(small)}))"


def whole_peak(w: str, h: str) -> str:
    return f"(CAST({w} AS BIGINT) * {h} * 164)"


def rescue_peak(pixels: str, base_pixels: str) -> str:
    return f"(8 * {pixels} + 88 * {base_pixels})"
