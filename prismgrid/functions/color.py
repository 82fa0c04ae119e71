"""Per-pixel maps as SQL expressions.

Every function returns the text of one scalar expression, so a map stays inside whole-stage
code generation; use it with ``F.expr``. Arguments are expressions too (column names by default).
The text keeps to what ANSI engines share: doubles are written with an exponent, integer division as
``floor`` of a double quotient.

Rounding to a code is ``floor(x + 0.5)`` clamped to 0..255 and happens after each stage of the
finishing chain, because stages are defined on 8-bit input. Nulls give nulls.
"""

from __future__ import annotations

import math


def num(x: float) -> str:
    """A double literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def clamp(e: str, lo: float, hi: float) -> str:
    return f"least(greatest({e}, {num(lo)}), {num(hi)})"


def code(e: str) -> str:
    """Nearest 8-bit code; halves go up. A hair of rounding first keeps engines together at halves."""
    return f"CAST({clamp(f'floor(round(CAST({e} AS DOUBLE), 9) + 0.5e0)', 0, 255)} AS INT)"


def whole(e: str) -> str:
    """Nearest integer; halves go up."""
    return f"CAST(floor(round(CAST({e} AS DOUBLE), 9) + 0.5e0) AS INT)"


def quotient(a: str, b: float) -> str:
    """Integer division of non-negative integers."""
    return f"CAST(floor(({a}) / {num(b)}) AS INT)"


def smoothstep(lo: float, hi: float, e: str) -> str:
    """0 below lo, 1 above hi, a cubic between."""
    if hi <= lo:
        return f"CASE WHEN {e} >= {num(hi)} THEN 1e0 ELSE 0e0 END"
    t = clamp(f"(({e}) - {num(lo)}) / {num(hi - lo)}", 0, 1)
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


# --- luma and chroma -------------------------------------------------------------------------

#: Rec. 601 luma weights of red, green, blue. Fixed values.
WEIGHTS = (0.299, 0.587, 0.114)


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Double luma."""
    wr, wg, wb = map(num, WEIGHTS)
    return f"({wr} * {r} + {wg} * {g} + {wb} * {b})"


def luma_int(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Integer luma, rounded."""
    return quotient(f"299 * {r} + 587 * {g} + 114 * {b} + 500", 1000)


def luma_milli(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Luma in thousandths of a code, exact."""
    return f"(299 * {r} + 587 * {g} + 114 * {b})"


def green_of(y: str, cr: str, cb: str) -> str:
    """Green from luma and the red and blue differences."""
    return f"({y} - (0.299e0 * ({cr}) + 0.114e0 * ({cb})) / 0.587e0)"


# --- tone, saturation, contrast, gain ----------------------------------------------------------


def tone_table(lift: float, rolloff: float) -> list[int]:
    """The 256 codes of a tone curve: shadows lifted by a power, highlights eased by a bump that
    peaks at three quarters."""
    lift, rolloff = min(max(lift, 0.0), 1.0), min(max(rolloff, 0.0), 1.0)
    out = []
    for i in range(256):
        x = (i / 255.0) ** (1 / (1 + 0.5 * lift))
        eased = x - 0.25 * rolloff * x**3 * (1 - x) / (0.75**3 * 0.25)
        out.append(min(max(int(eased * 255 + 0.5), 0), 255))
    return out


def tone(v: str, lift: float, rolloff: float) -> str:
    """Tone curve of one channel in closed form."""
    gamma = 1 / (1 + 0.5 * min(max(lift, 0.0), 1.0))
    x = f"pow({v} / 255e0, {num(gamma)})"
    bump = num(0.25 * min(max(rolloff, 0.0), 1.0) / (0.75**3 * 0.25))
    return code(f"255e0 * ({x} - {bump} * {x} * {x} * {x} * (1e0 - {x}))")


def lerp_to(v: str, to: str, amount: str | None) -> str:
    """``v`` moved toward ``to`` by an optional modulation."""
    return to if amount is None else f"({v} + ({amount}) * (({to}) - {v}))"


def saturate(v: str, factor: float, modulation: str | None = None, rgb=("r", "g", "b")) -> str:
    """Away from integer luma by a factor."""
    y = luma_int(*rgb)
    return code(lerp_to(v, f"({y} + {num(factor)} * ({v} - {y}))", modulation))


def contrast(v: str, factor: float) -> str:
    return code(f"128e0 + {num(factor)} * ({v} - 128)")


def gain(v: str, by: str) -> str:
    return code(f"{v} * ({by})")


# --- region likelihoods -----------------------------------------------------------------------


def skin_chroma(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Likelihood of skin from an ellipse in chroma (centre 107, 152; radii 14, 13)."""
    cb = f"(128e0 - 0.168736e0 * {r} - 0.331264e0 * {g} + 0.5e0 * {b} - 107e0) / 14e0"
    cr = f"(128e0 + 0.5e0 * {r} - 0.418688e0 * {g} - 0.081312e0 * {b} - 152e0) / 13e0"
    rho = f"sqrt(({cb}) * ({cb}) + ({cr}) * ({cr}))"
    return f"(1e0 - {smoothstep(1.0, 2.2, rho)})"


def skin(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Skin likelihood with the gate against black."""
    return f"({skin_chroma(r, g, b)} * {smoothstep(6, 14, luma(r, g, b))})"


def sky_position(f: str) -> str:
    """Prior of the sky by height in the image: 1 at the top, .3 at .6, 0 from .75."""
    return (
        f"CASE WHEN {f} <= 0e0 THEN 1e0 WHEN {f} < 0.6e0 THEN 1e0 - 0.7e0 * (({f}) / 0.6e0) "
        f"WHEN {f} < 0.75e0 THEN 0.3e0 * (1e0 - (({f}) - 0.6e0) / {num(0.75 - 0.60)}) ELSE 0e0 END"
    )


def sky_chroma(r: str = "r", g: str = "g", b: str = "b") -> str:
    y = luma(r, g, b)
    return f"({smoothstep(8, 30, f'{b} - {y}')} * (1e0 - {smoothstep(6, 26, f'{r} - {y}')}))"


def sky_luma(y: str) -> str:
    return f"(0.4e0 + 0.6e0 * {smoothstep(90, 150, y)})"


def sky(height_fraction: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """Clear-sky likelihood of a pixel."""
    return f"({sky_chroma(r, g, b)} * {sky_luma(luma(r, g, b))} * ({sky_position(height_fraction)}))"


def foliage(r: str = "r", g: str = "g", b: str = "b") -> str:
    """Foliage likelihood: green, neither warm nor blue, in a band of luma."""
    y = luma(r, g, b)
    chroma = f"{smoothstep(8, 24, f'{g} - {y}')} * (1e0 - {smoothstep(6, 26, f'{r} - {y}')}) * (1e0 - {smoothstep(2, 22, f'{b} - {y}')})"
    return f"({chroma} * {smoothstep(18, 46, y)} * (1e0 - {smoothstep(205, 236, y)}))"


def overcast_texture(energy: str) -> str:
    return f"(1e0 - {smoothstep(12, 36, energy)})"


def overcast_bright(y: str) -> str:
    return smoothstep(140, 180, y)


def overcast_neutral(r: str = "r", g: str = "g", b: str = "b") -> str:
    y = luma(r, g, b)
    return f"(1e0 - {smoothstep(6, 12, f'sqrt(({r} - {y}) * ({r} - {y}) + ({b} - {y}) * ({b} - {y}))')})"


def overcast(energy: str, height_fraction: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """Overcast-sky likelihood: smooth, bright, neutral, high in the image."""
    return (
        f"({overcast_texture(energy)} * {overcast_bright(luma(r, g, b))} * {overcast_neutral(r, g, b)} "
        f"* ({sky_position(height_fraction)}))"
    )


# --- weights --------------------------------------------------------------------------------


def ghost_weight(diff: str, sigma: str, lo: float = 3.0, hi: float = 8.0) -> str:
    """1 up to lo sigmas, 0 from hi sigmas, linear between; sigma is at least 1."""
    s = f"greatest({sigma}, 1e0)"
    a = f"abs({diff})"
    return (
        f"CASE WHEN {a} <= {num(lo)} * {s} THEN 1e0 WHEN {a} >= {num(hi)} * {s} THEN 0e0 "
        f"ELSE ({num(hi)} * {s} - {a}) / ({num(hi)} * {s} - {num(lo)} * {s}) END"
    )


def motion_weight(excess: str, sigma: str, k: float = 1.0) -> str:
    return f"(1e0 / (1e0 + {num(k)} * (({excess}) / greatest({sigma}, 1e0))))"


def exposure_weight(ev: str, r: str = "r", g: str = "g", b: str = "b") -> str:
    """How well a pixel is exposed; clipped pixels of the longer or shorter frames weigh nothing."""
    z = f"({luma(r, g, b)} / 255e0 - 0.5e0)"
    return (
        f"CASE WHEN {ev} > 0 AND greatest({r}, {g}, {b}) >= 250 THEN 0e0 "
        f"WHEN {ev} < 0 AND least({r}, {g}, {b}) <= 5 THEN 0e0 "
        f"ELSE exp(-({z} * {z}) / {num(2 * 0.2 * 0.2)}) END"
    )


def bloom_gain(threshold: float, boost: float, background: str, rgb=("r", "g", "b")) -> str:
    """Gain of near-clipped background pixels."""
    if boost <= 1:
        return "1e0"
    ramp = smoothstep(threshold, 255, f"CAST(greatest({', '.join(rgb)}) AS DOUBLE)")
    return f"(1e0 + {num(boost - 1)} * {ramp} * ({background}))"


def chroma_shoulder(m: str, knee: str, soft: float) -> str:
    """Chroma magnitude eased above a knee."""
    return f"CASE WHEN {m} <= {knee} THEN {m} ELSE {knee} + ({m} - {knee}) / (1e0 + ({m} - {knee}) / {num(soft)}) END"


def rescue_shoulder(v: str) -> str:
    """Values above 210 eased exponentially toward 255."""
    return (
        f"CASE WHEN {v} <= 210e0 THEN greatest({v}, 0e0) "
        f"ELSE least(210e0 + 45e0 * (1e0 - exp(-(({v}) - 210e0) / 45e0)), 255e0) END"
    )


def shadow_gain(base: str, target: float = 150.0, alpha: float = 0.9, most: float = 7.5) -> str:
    return f"least(pow({num(target + 8)} / ({base} + 8e0), {num(alpha)}), {num(most)})"


def rescue_gain(base: str, target: float = 150.0) -> str:
    """Shadow gain below the target, protected in the highlights."""
    protect = smoothstep(150, 220, base)
    lifted = f"(CASE WHEN {base} < {num(target)} THEN {shadow_gain(base, target)} ELSE 1e0 END)"
    return f"({lifted} * (1e0 - {protect}) + {protect})"


def coring(d: str, knee: str) -> str:
    """Detail kept where it exceeds the knee, faded below."""
    return f"CASE WHEN {d} = 0e0 THEN 0e0 ELSE {d} * {d} * {d} / ({d} * {d} + ({knee}) * ({knee})) END"


def parabola(before: str, at: str, after: str) -> str:
    """Place of the minimum of three samples, within half a step; 0 if flat."""
    bend = f"({before} + {after} - 2e0 * {at})"
    return f"CASE WHEN {bend} <= 1e-12 THEN 0e0 ELSE {clamp(f'0.5e0 * ({before} - {after}) / {bend}', -0.5, 0.5)} END"


def gamut_scale(y: str, cr: str, cb: str) -> str:
    """Largest factor on chroma that keeps all channels in 0..255."""
    a = clamp(y, 0, 255)
    cg = f"(-(0.299e0 * ({cr}) + 0.114e0 * ({cb})) / 0.587e0)"
    limit = lambda c: (
        f"CASE WHEN {c} > 1e-9 THEN (255e0 - {a}) / ({c}) WHEN {c} < -1e-9 THEN -{a} / ({c}) ELSE 1e300 END"
    )
    return f"least({limit(cr)}, {limit(cb)}, {limit(cg)})"


# --- looks --------------------------------------------------------------------------------------


def _s_curve(y: str) -> str:
    return f"({y} + 0.35e0 * ({smoothstep(0, 1, y)} - {y}))"


def look(channel: str, protect_skin: bool = False, rgb=("r", "g", "b")) -> str:
    """One channel of the cinematic look on values in 0..1: an S-curve on luma, warm highlights and
    cool shadows, less saturation; skin keeps 85 % of the tone-only colour where asked."""
    r, g, b = rgb
    y = luma(r, g, b)
    s = _s_curve(y)
    hi = clamp(s, 0, 1)
    tint = {
        "r": f"0.06e0 * {hi} - 0.06e0 * (1e0 - {hi})",
        "g": f"0.03e0 * {hi}",
        "b": f"-0.06e0 * {hi} + 0.06e0 * (1e0 - {hi})",
    }
    lifted = {c: f"({v} + {s} - {y} + {tint[c]})" for c, v in zip("rgb", rgb, strict=True)}
    mean = luma(*(lifted[c] for c in "rgb"))
    graded = clamp(f"{mean} + 0.9e0 * ({lifted[channel]} - {mean})", 0, 1)
    if not protect_skin:
        return graded
    own = dict(zip("rgb", rgb, strict=True))[channel]
    toned = clamp(f"{own} + {s} - {y}", 0, 1)
    kept = f"(0.85e0 * {skin_chroma(*(f'(255e0 * {v})' for v in rgb))})"
    return f"({graded} + {kept} * ({toned} - {graded}))"


def vogel(i: str, n: int) -> tuple[str, str]:
    """Offsets of tap ``i`` of ``n`` in the unit disc."""
    angle = num(math.pi * (3 - math.sqrt(5)))
    radius = f"sqrt(({i} + 0.5e0) / {num(n)})"
    return f"({radius} * cos({i} * {angle}))", f"({radius} * sin({i} * {angle}))"


def yuv_to_rgb(y: str, u: str, v: str) -> dict[str, str]:
    """Codes of red, green, blue from full-range YUV."""
    return {
        "r": code(f"{y} + 1.402e0 * ({v} - 128)"),
        "g": code(f"{y} - 0.344136e0 * ({u} - 128) - 0.714136e0 * ({v} - 128)"),
        "b": code(f"{y} + 1.772e0 * ({u} - 128)"),
    }


# --- predicates -----------------------------------------------------------------------------


def saturation_of(r: str = "r", g: str = "g", b: str = "b") -> str:
    top = f"greatest({r}, {g}, {b})"
    return f"CASE WHEN {top} = 0 THEN 0e0 ELSE ({top} - least({r}, {g}, {b})) / CAST({top} AS DOUBLE) END"


def mid_luma(most_saturated: float, r: str = "r", g: str = "g", b: str = "b") -> str:
    """Admission of the gray-world (0.6) and neutral-probe (0.1) cues."""
    y = luma(r, g, b)
    return f"({y} >= {num(0.12 * 255)} AND {y} <= {num(0.92 * 255)} AND {saturation_of(r, g, b)} <= {num(most_saturated)})"


def unclipped(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"greatest({r}, {g}, {b}) < 250"
