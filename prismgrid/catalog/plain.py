"""Hand-written SQL of the per-pixel maps and predicates.

Written from the definitions and with its own constants, not from the expressions that the plans run, so that a
wrong formula or constant on either side shows as a difference.
"""

from __future__ import annotations

from prismgrid.catalog import sql


def ramp(a: float, b: float, x: str) -> str:
    """Cubic from 0 at a to 1 at b."""
    t = f"(CASE WHEN {x} <= {a}e0 THEN 0e0 WHEN {x} >= {b}e0 THEN 1e0 ELSE (({x}) - {a}e0) / ({b}e0 - {a}e0) END)"
    return f"(3e0 * {t} * {t} - 2e0 * {t} * {t} * {t})"


def byte(x: str) -> str:
    return f"CAST(greatest(0e0, least(255e0, floor(round({x}, 9) + 0.5e0))) AS INT)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


#: Double luma, differences from it, and integer luma of every pixel.
PIXELS = f"""p AS (SELECT *, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS l, CAST(floor((299 * r + 587 * g + 114 * b + 500) / 1000e0) AS INT) AS li,
 CAST(greatest(r, g, b) AS DOUBLE) AS top, CAST(least(r, g, b) AS DOUBLE) AS low FROM ({sql.EVENTS}))"""


def over_pixels(columns: str, source: str = "p", ctes: str = "", where: str = "TRUE") -> str:
    return f"WITH {PIXELS}{ctes} SELECT y, x, {columns} FROM {source} WHERE {where}"


def each(make) -> str:
    return ", ".join(f"{make(c)} AS {c}" for c in "rgb")


_SKIN = f"""(1e0 - {ramp(1.0, 2.2, "sqrt(power((128e0 - 0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b - 107e0) / 14e0, 2) + power((128e0 + 0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b - 152e0) / 13e0, 2))")})"""
_POSITION = lambda f: f"(CASE WHEN {f} <= 0 THEN 1e0 WHEN {f} <= 0.6e0 THEN 1e0 - {f} * 7e0 / 6e0 WHEN {f} < 0.75e0 THEN (0.75e0 - {f}) * 2e0 ELSE 0e0 END)"
_SKY = f"({ramp(8, 30, 'b - l')} * (1e0 - {ramp(6, 26, 'r - l')}))"
_NEUTRAL = f"(1e0 - {ramp(6, 12, 'sqrt(power(r - l, 2) + power(b - l, 2))')})"
_GHOST = lambda d, s, lo, hi: f"(CASE WHEN abs({d}) <= {lo}e0 * {s} THEN 1e0 WHEN abs({d}) >= {hi}e0 * {s} THEN 0e0 ELSE ({hi}e0 - abs({d}) / {s}) / {hi - lo}e0 END)"
_BAND = "l >= 30.6e0 AND l <= 234.6e0 AND (top = 0 OR (top - low) / top <= {}e0)"

SQL: dict[str, str] = {
    "m01_luma_int": over_pixels("li AS luma"),
    "m02_luma_double": over_pixels(f"{r6('l')} AS luma, 299 * r + 587 * g + 114 * b AS milli"),
    "m03_gain": over_pixels(each(lambda c: byte(f"1.37e0 * {c}"))),
    "m04_white_balance_gains": over_pixels(f"{byte('1.16e0 * r')} AS r, g, {byte('0.88e0 * b')} AS b"),
    "m06_saturation": over_pixels(each(lambda c: byte(f"li + 1.08e0 * ({c} - li)"))),
    "m06_saturation_modulated": over_pixels(
        each(lambda c: byte(f"{c} + m * (li + 1.15e0 * ({c} - li) - {c})")), "q", f", q AS (SELECT *, 1e0 - 0.7e0 * {_SKIN} * {ramp(6, 14, 'l')} AS m FROM p)"
    ),
    "m07_contrast": over_pixels(each(lambda c: byte(f"1.05e0 * {c} - 6.4e0"))),
    "m09_mirror": over_pixels("99 - x AS mirrored_x, r, g, b"),
    "m10_skin_likelihood": over_pixels(f"{r6(_SKIN)} AS chroma, {r6(f'{_SKIN} * {ramp(6, 14, "l")}')} AS skin"),
    "m11_sky_likelihood": over_pixels(
        f"{r6(_SKY)} AS chroma, {r6(f'0.4e0 + 0.6e0 * {ramp(90, 150, "l")}')} AS prior, "
        f"{r6(f'{_SKY} * (0.4e0 + 0.6e0 * {ramp(90, 150, "l")}) * {_POSITION("(y / 1000e0)")}')} AS sky"
    ),
    "m12_position_prior": over_pixels(f"{r6(_POSITION('((x - 10) / 80e0)'))} AS prior"),
    "m13_foliage_likelihood": over_pixels(
        f"{r6(f'{ramp(8, 24, "g - l")} * (1e0 - {ramp(6, 26, "r - l")}) * (1e0 - {ramp(2, 22, "b - l")}) * {ramp(18, 46, "l")} * (1e0 - {ramp(205, 236, "l")})')} AS foliage"
    ),
    "m14_overcast_priors": over_pixels(
        f"{r6(f'1e0 - {ramp(12, 36, "(r / 4e0)")}')} AS texture, {r6(ramp(140, 180, 'l'))} AS bright, {r6(_NEUTRAL)} AS neutral, "
        f"{r6(f'(1e0 - {ramp(12, 36, "(r / 8e0)")}) * {ramp(140, 180, "l")} * {_NEUTRAL} * {_POSITION("(y / 1000e0)")}')} AS overcast"
    ),
    "m15_ghost_weight": over_pixels(f"{r6(_GHOST('(r - g)', 's', 3, 8))} AS plain, {r6(_GHOST('(r - g)', 's', 4, 12))} AS night", "q", ", q AS (SELECT *, greatest(1e0, b / 16e0) AS s FROM p)"),
    "m16_motion_weight": over_pixels(f"{r6('greatest(1e0, b / 32e0) / (greatest(1e0, b / 32e0) + r / 10e0)')} AS weight"),
    "m17_exposure_weight": over_pixels(
        f"{r6('CASE WHEN (x % 3 = 2 AND top >= 250) OR (x % 3 = 0 AND low <= 5) THEN 0e0 ELSE exp(-12.5e0 * power(l / 255e0 - 0.5e0, 2)) END')} AS weight"
    ),
    "m18_highlight_bloom": over_pixels(each(lambda c: r6(f"{c} + {c} * 2e0 * {ramp(180, 255, 'top')} * b0 / 255e0")), "q", ", q AS (SELECT *, b AS b0 FROM p)"),
    "m19_shoulders": over_pixels(
        f"{r6('CASE WHEN r > 30 THEN 30e0 + 18e0 * (r - 30) / (r - 12) ELSE r END')} AS chroma, "
        f"{r6('CASE WHEN r > 105 THEN least(255e0, 255e0 - 45e0 * exp((105 - r) * 2e0 / 45e0)) ELSE 2e0 * r END')} AS rescue"
    ),
    "m20_shadow_gain": over_pixels(
        f"{r6('least(7.5e0, exp(0.9e0 * ln(158e0 / (r + 9e0))))')} AS gain, "
        f"{r6(f'(CASE WHEN r + 1 < 150 THEN least(7.5e0, exp(0.9e0 * ln(158e0 / (r + 9e0)))) ELSE 1e0 END) * (1e0 - {ramp(150, 220, "(r + 1)")}) + {ramp(150, 220, "(r + 1)")}')} AS protected"
    ),
    "m21_coring": over_pixels(f"{r6('CASE WHEN r = g THEN 0e0 ELSE d / (1e0 + power(b / 32e0 / d, 2)) END')} AS cored", "q", ", q AS (SELECT *, (r - g) / 8e0 AS d FROM p)"),
    "m22_parabola": over_pixels(
        f"{r6('CASE WHEN k <= 1e-12 THEN 0e0 ELSE greatest(-0.5e0, least(0.5e0, (r - b) / (2e0 * k))) END')} AS vertex", "q", ", q AS (SELECT *, r + b - g / 2e0 AS k FROM p)"
    ),
    "m24_gamut_scale": over_pixels(
        f"{r6('least(1000e0, ' + ', '.join(f"CASE WHEN {c} - l > 1e-9 THEN (255e0 - l) / ({c} - l) WHEN {c} - l < -1e-9 THEN l / (l - {c}) ELSE 1e300 END" for c in 'rgb') + ')')} AS scale"
    ),
    "s06_yuv_to_rgb": over_pixels(f"{byte('r + 1.402e0 * b - 179.456e0')} AS r, {byte('r - 0.344136e0 * g - 0.714136e0 * b + 135.458816e0')} AS g, {byte('r + 1.772e0 * g - 226.816e0')} AS b"),
    "f02_neutral_probe": over_pixels(f"{r6('l')} AS luma", where=_BAND.format("0.1")),
    "f09_region_of_interest": over_pixels("r", where="x BETWEEN 28 AND 99 AND y BETWEEN 4 AND 8"),
    "f01_gray_world_admission": f"""WITH p AS (SELECT 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS l, CAST(greatest(r, g, b) AS DOUBLE) AS top, CAST(least(r, g, b) AS DOUBLE) AS low FROM ({sql.LINES}))
SELECT {_BAND.format('0.6')} AS admitted, count(*) AS n FROM p GROUP BY 1""",
    # Curves: the same power and bump as a table of 256 codes, looked up.
    "m05_tone_curve": f"""WITH {PIXELS}, t AS (SELECT i, CAST(floor(greatest(0e0, least(255e0, 255e0 * (z - 0.12e0 / 0.421875e0 * z * z * z * (1e0 - z)))) + 0.5e0) AS INT) AS o
 FROM (SELECT i, power(i / 255e0, 1e0 / 1.06e0) AS z FROM range(256) v(i)))
SELECT y, x, a.o AS r, c.o AS g, d.o AS b FROM p JOIN t a ON a.i = p.r JOIN t c ON c.i = p.g JOIN t d ON d.i = p.b""",
    "m25_vogel_spiral": """SELECT i AS tap, round(rad * cos(i * 2.399963229728653e0), 6) AS dx, round(rad * sin(i * 2.399963229728653e0), 6) AS dy
FROM (SELECT i, sqrt((2 * i + 1) / 48e0) AS rad FROM range(24) v(i))""",
}

# The look: an S-curve on luma, warm lights and cool shadows, 90 % of the saturation; with ``safe`` 85 % of the skin
# likelihood draws back to the curve alone.
_LOOK = f"""WITH {PIXELS}, u AS (SELECT *, r / 255e0 AS ur, g / 255e0 AS ug, b / 255e0 AS ub, l / 255e0 AS ul FROM p),
s AS (SELECT *, 0.65e0 * ul + 0.35e0 * (3e0 * ul * ul - 2e0 * ul * ul * ul) AS sl FROM u),
t AS (SELECT *, ur + sl - ul + 0.12e0 * sl - 0.06e0 AS tr, ug + sl - ul + 0.03e0 * sl AS tg, ub + sl - ul + 0.06e0 - 0.12e0 * sl AS tb FROM s),
m AS (SELECT *, 0.299e0 * tr + 0.587e0 * tg + 0.114e0 * tb AS tl FROM t),
f AS (SELECT y, x, r, g, b, {', '.join(f'greatest(0e0, least(1e0, 0.1e0 * tl + 0.9e0 * t{c})) AS f{c}, greatest(0e0, least(1e0, u{c} + sl - ul)) AS k{c}' for c in 'rgb')} FROM m)"""
SQL["m23_cinematic_look"] = f"{_LOOK} SELECT y, x, {', '.join(f'{r6(f"f{c}")} AS {c}' for c in 'rgb')} FROM f"
SQL["m23_skin_safe_look"] = f"{_LOOK}, h AS (SELECT *, 0.85e0 * {_SKIN} AS w FROM f) SELECT y, x, {', '.join(f'{r6(f"f{c} + w * (k{c} - f{c})")} AS {c}' for c in 'rgb')} FROM h"
