"""The finishing chain over pixel rows.

Stages take and return ``frame_id, y, x, r, g, b`` and requantise to codes; masks are columns that
later stages reuse. A stage of strength 0 adds nothing to the plan. Statistics (gains, knee,
engagement) are one-row-per-frame DataFrames joined in.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.functions import color
from prismgrid.operators import neighborhood as N
from prismgrid.operators import stats
from prismgrid.sources.shared import barrier

PX = ["frame_id", "y", "x", "r", "g", "b"]


@dataclass(frozen=True)
class Params:
    """Strengths of the stages."""

    shadows_lift: float = 0.12
    highlight_rolloff: float = 0.12
    saturation: float = 1.08
    contrast: float = 1.05
    local_contrast: float = 0.03
    chroma_denoise: float = 0.6
    detail: float = 0.08
    white_balance: float = 0.8
    skin_protection: float = 0.7
    backlit_rescue: float = 0.0
    chroma_rolloff: float = 0.0
    semantic: float = 0.0
    rescue_gated: bool = True


DEFAULT = Params()
RENDITION = replace(DEFAULT, local_contrast=0.35, detail=0.5, backlit_rescue=1.0, chroma_rolloff=1.0, semantic=1.0)
REFERENCE = replace(RENDITION, saturation=1.15, chroma_denoise=1.0, shadows_lift=0.18, skin_protection=0.85)
NIGHT = replace(DEFAULT, shadows_lift=0.18, chroma_denoise=0.8, detail=0.03)
#: Presets a user can choose.
PRESETS = {
    "Natural": REFERENCE,
    "Vivid": replace(RENDITION, saturation=1.16, contrast=1.09, local_contrast=0.45),
    "Detail": replace(RENDITION, detail=0.8, local_contrast=0.40, saturation=1.04),
}

#: Squares of 3 % and 10 % of the range: how much variance counts as an edge.
EPS_FINE, EPS_DETAIL = (0.03 * 255) ** 2, (0.10 * 255) ** 2
#: Pixels from which statistics come from a block-mean frame, and the frame goes by tiles.
ANALYSIS_PIXELS, TILED_PIXELS = 1_000_000, 9_000_000


def _codes(px: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """Replace the three channels at once (each expression sees the old ones)."""
    new = px.withColumns({"_r": F.expr(r), "_g": F.expr(g), "_b": F.expr(b)})
    return new.drop("r", "g", "b").withColumnsRenamed({"_r": "r", "_g": "g", "_b": "b"})


def balance(px: DataFrame, gains: DataFrame, strength: float) -> DataFrame:
    """Apply white-balance gains ``frame_id, gain_r, gain_b`` blended by a strength."""
    by = lambda c: f"(1e0 + {color.num(strength)} * (gain_{c} - 1e0))"
    px = px.join(F.broadcast(gains), "frame_id")
    return _codes(px, color.gain("r", by("r")), "g", color.gain("b", by("b"))).drop("gain_r", "gain_b")


def denoise_chroma(px: DataFrame, strength: float, radius: int = 4, eps: float = EPS_FINE) -> DataFrame:
    """Smooth colour differences along the edges of luma."""
    y = color.luma()
    px = px.withColumns({"_y": F.expr(y), "_cb": F.expr(f"b - {y}"), "_cr": F.expr(f"r - {y}")})
    px = N.guided(px, {"_fb": "_cb", "_fr": "_cr"}, "_y", radius, eps)
    s = color.num(strength)
    cb, cr = f"(_cb + {s} * (_fb - _cb))", f"(_cr + {s} * (_fr - _cr))"
    px = _codes(px, color.code(f"_y + {cr}"), color.code(color.green_of("_y", cr, cb)), color.code(f"_y + {cb}"))
    return px.drop("_y", "_cb", "_cr", "_fb", "_fr")


def _unit(name: str) -> Column:
    return F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0))


def skin_mask(px: DataFrame, to: str = "skin", radius: int = 8) -> DataFrame:
    return N.box_mean(px, {to: F.expr(color.skin())}, radius).withColumn(to, _unit(to))


def scene_masks(px: DataFrame, height: str = "h", row_offset: int = 0) -> DataFrame:
    """Adds ``sky``, ``overcast`` and ``foliage``; ``height`` names a column with the image's height."""
    at = f"((y + {row_offset}) / CAST({height} AS DOUBLE))"
    px = N.local_variance(px.withColumn("_y", F.expr(color.luma())), "_y", "_energy", 12)
    raw = {"sky": color.sky(at), "overcast": color.overcast("_energy", at), "foliage": color.foliage()}
    px = N.box_mean(px, {n: F.expr(e) for n, e in raw.items()}, 12)
    return px.withColumns({n: _unit(n) for n in raw}).drop("_y", "_energy")


def _scaled(px: DataFrame, ratio: str, modulation: str | None) -> DataFrame:
    """Channels times a ratio of lumas, moved there by an optional modulation."""
    px = px.withColumn("_ratio", F.expr(color.clamp(ratio, 0.25, 4.0)))
    return _codes(px, *(color.code(color.lerp_to(c, f"({c} * _ratio)", modulation)) for c in "rgb")).drop("_ratio")


def local_tone(px: DataFrame, strength: float, modulation: str | None = None, radius: int = 16) -> DataFrame:
    """Compress the smooth part of luma about the middle and lift its detail."""
    s = min(max(strength, 0.0), 1.0)
    px = N.guided(px.withColumn("_y", F.expr(color.luma())), {"_base": "_y"}, "_y", radius, EPS_FINE)
    new = f"(128e0 + (_base - 128e0) * {color.num(1 - 0.15 * s)} + {color.num(1 + 0.15 * s)} * (_y - _base))"
    return _scaled(px, f"(({new} + 1e0) / (_y + 1e0))", modulation).drop("_y", "_base")


def detail_planes(px: DataFrame) -> DataFrame:
    """Adds luma ``_y`` and its fine detail ``_d``."""
    px = N.guided(px.withColumn("_y", F.expr(color.luma())), {"_base": "_y"}, "_y", 3, EPS_DETAIL)
    return px.withColumn("_d", F.col("_y") - F.col("_base")).drop("_base")


def detail_knee(px: DataFrame, factor: float = 2.0) -> DataFrame:
    """``frame_id, knee``: detail below it is taken for noise."""
    sigma = stats.robust_sigma(detail_planes(px).select("frame_id", "_d"), "_d", "sigma", least=0.0)
    return sigma.select("frame_id", (F.lit(factor) * F.col("sigma")).alias("knee"))


def enhance_detail(px: DataFrame, strength: float, modulation: str | None = None, knee: DataFrame | None = None) -> DataFrame:
    """Add cored detail to luma, kept near the range of the eight neighbours."""
    planes = detail_planes(px)
    knee = detail_knee(px) if knee is None else knee
    px = N.extreme(N.extreme(planes, {"_lo": "_y"}, 1, largest=False), {"_hi": "_y"}, 1).join(F.broadcast(knee), "frame_id")
    sharp = f"(_y + {color.num(0.6 * min(max(strength, 0.0), 1.0))} * ({color.coring('_d', 'knee')}))"
    held = f"least(greatest({sharp}, _lo - 5e0), _hi + 5e0)"
    return _scaled(px, f"(({held} + 1e0) / (_y + 1e0))", modulation).drop("_y", "_d", "_lo", "_hi", "knee")


def tone_curve(px: DataFrame, lift: float, rolloff: float) -> DataFrame:
    """Channels through the 256-code table."""
    table = F.array(*[F.lit(v) for v in color.tone_table(lift, rolloff)])
    return px.withColumns({c: F.element_at(table, F.col(c) + 1) for c in "rgb"})


def saturate(px: DataFrame, factor: float, modulation: str | None = None) -> DataFrame:
    return _codes(px, *(color.saturate(c, factor, modulation) for c in "rgb"))


def contrast(px: DataFrame, factor: float) -> DataFrame:
    return _codes(px, *(color.contrast(c, factor) for c in "rgb"))


def rolloff_radius(width: int) -> int:
    """Neighbourhood of the chroma roll-off, by image width."""
    return min(max(int(24 * width / 1542 + 0.5), 24), 96)


def roll_off_chroma(px: DataFrame, strength: float, radius: int = 24, knee: float = 30.0, soft: float = 18.0) -> DataFrame:
    """Ease chroma that stands out of its neighbourhood."""
    y = color.luma()
    px = px.withColumn("_m", F.expr(f"sqrt((r - {y}) * (r - {y}) + (b - {y}) * (b - {y}))"))
    px = N.extreme(N.box_mean(px, {"_near": "_m"}, radius), {"_ref": "_near"}, radius // 2)
    px = px.withColumn("_knee", F.expr(f"greatest({color.num(knee)}, 1.5e0 * _ref)"))
    full = f"(({color.chroma_shoulder('_m', '_knee', soft)}) / _m)"
    px = px.withColumn("_s", F.expr(f"CASE WHEN _m > _knee THEN 1e0 + {color.num(strength)} * ({full} - 1e0) ELSE 1e0 END"))
    return _codes(px, *(color.code(f"{y} + ({c} - {y}) * _s") for c in "rgb")).drop("_m", "_near", "_ref", "_knee", "_s")


def render_regions(px: DataFrame, strength: float) -> DataFrame:
    """Smooth sky chroma, deepen sky and foliage within bounds; needs the scene masks."""
    y = color.luma()
    px = px.withColumns({"_y": F.expr(y), "_cb": F.expr(f"b - {y}"), "_cr": F.expr(f"r - {y}")})
    px = N.guided(px, {"_fb": "_cb", "_fr": "_cr"}, "_y", 8, EPS_FINE)
    s = color.num(strength)
    smooth = f"({s} * 0.7e0 * greatest(sky, overcast))"
    px = px.withColumns({"_hb": F.expr(f"_cb + {smooth} * (_fb - _cb)"), "_hr": F.expr(f"_cr + {smooth} * (_fr - _cr)")})
    px = px.withColumns({"_ay": F.expr(f"_y + {s} * 4e0 * foliage"), "_mag": F.expr("sqrt(_hr * _hr + _hb * _hb)")})
    extra, cap = f"({s} * (0.14e0 * sky + 0.16e0 * foliage))", f"({s} * (12e0 * sky + 8e0 * foliage))"
    scale = (
        f"CASE WHEN _mag > 1e-6 AND {extra} > 0e0 THEN least(least(_mag * (1e0 + {extra}), _mag + {cap}) / _mag, "
        f"greatest(1e0, {color.gamut_scale('_ay', '_hr', '_hb')})) ELSE 1e0 END"
    )
    px = px.withColumn("_s", F.expr(scale)).withColumns({"_hb": F.expr("_hb * _s"), "_hr": F.expr("_hr * _s")})
    px = _codes(px, color.code("_ay + _hr"), color.code(color.green_of("_ay", "_hr", "_hb")), color.code("_ay + _hb"))
    return px.drop("_y", "_cb", "_cr", "_fb", "_fr", "_hb", "_hr", "_ay", "_mag", "_s")


def rescue_channels(gain: str, engagement: str) -> tuple[str, str, str]:
    """Codes after a rescue gain, warmed by how much is lifted."""
    eff = f"(1e0 + least({engagement}, 1e0) * ({gain} - 1e0))"
    lift = color.clamp(f"({eff} - 1e0) / 6.5e0", 0, 1)
    warm = {"r": f"(1e0 + 0.05e0 * {lift})", "g": "1e0", "b": f"(1e0 - {color.num(0.05 * 0.7)} * {lift})"}
    return tuple(color.code(color.rescue_shoulder(f"({c} * {eff} * {warm[c]})")) for c in "rgb")


def rescue_backlit(px: DataFrame, engagement: DataFrame, radius: int = 32) -> DataFrame:
    """Lift what lies in shadow against a bright background. ``engagement``: ``frame_id, engagement``."""
    px = N.guided(px.withColumn("_y", F.expr(color.luma())), {"_base": "_y"}, "_y", radius, (0.035 * 255) ** 2)
    px = px.join(F.broadcast(engagement), "frame_id").withColumn("_base", F.greatest("_base", F.lit(1.0)))
    px = px.withColumns({"_gain": F.expr(f"CASE WHEN _base < 150e0 THEN {color.shadow_gain('_base')} ELSE 1e0 END"), "_t": F.expr(color.clamp("(_base - 150e0) / 70e0", 0, 1))})
    px = px.withColumn("_protect", F.expr("_t * _t * (3e0 - 2e0 * _t)"))
    px = px.withColumn("_eff", F.expr("1e0 + least(engagement, 1e0) * (_gain * (1e0 - _protect) + _protect - 1e0)"))
    px = px.withColumn("_lift", F.expr(color.clamp("(_eff - 1e0) / 6.5e0", 0, 1)))
    warm = {"r": "(1e0 + 0.05e0 * _lift)", "g": "1e0", "b": f"(1e0 - {color.num(0.05 * 0.7)} * _lift)"}
    px = px.withColumns({f"_v{c}": F.expr(f"{c} * _eff * {w}") for c, w in warm.items()})
    out = _codes(px, *(f"CASE WHEN engagement > 0e0 THEN {color.code(color.rescue_shoulder(f'_v{c}'))} ELSE {c} END" for c in "rgb"))
    return out.drop("_y", "_base", "_gain", "_t", "_protect", "_eff", "_lift", "_vr", "_vg", "_vb", "engagement")


def engagement(px: DataFrame, params: Params) -> DataFrame:
    strength = F.col("strength") if params.rescue_gated else F.lit(1.0)
    return stats.backlit(px).select("frame_id", (F.lit(params.backlit_rescue) * strength).alias("engagement"))


def analysis(px: DataFrame, width: int, height: int) -> DataFrame:
    """The frame that statistics come from: block means down to a million pixels."""
    factor = 1
    while (width // factor) * (height // factor) > ANALYSIS_PIXELS:
        factor += 1
    if factor == 1:
        return px
    small = N.block_mean(px, ["r", "g", "b"], factor)
    return _codes(small, *(color.code(c) for c in "rgb"))


def finish(px: DataFrame, params: Params = DEFAULT, width: int = 100, height: int | None = None) -> DataFrame:
    """The whole chain on frames of one width (and height, where it exceeds the analysis size).

    Two statistics barriers are written on the way: after the rescue and before the detail stage.
    """
    px = px.select(*PX)
    if params.backlit_rescue > 0:
        px = barrier(rescue_backlit(px, engagement(px, params)))
    if params.white_balance > 0:
        source = analysis(px, width, height) if height else px
        px = balance(px, stats.white_balance_gains(source), params.white_balance)
    if params.chroma_denoise > 0:
        px = denoise_chroma(px, params.chroma_denoise)
    modulation = None
    if params.skin_protection > 0:
        px = skin_mask(px, "_skin")
        px = px.withColumn("_keep", F.expr(f"CAST(CAST(1e0 - {color.num(params.skin_protection)} * _skin AS FLOAT) AS DOUBLE)")).drop("_skin")
        modulation = "_keep"
    if params.semantic > 0:
        size = px.groupBy("frame_id").agg((F.max("y") + 1).alias("h"))
        px = scene_masks(px.join(F.broadcast(size), "frame_id")).drop("h")
    if params.local_contrast > 0:
        px = local_tone(px, params.local_contrast, modulation)
    if params.detail > 0:
        px = barrier(px)  # the knee and the pixels both come from here
        px = enhance_detail(px, params.detail, modulation)
    px = tone_curve(px, params.shadows_lift, params.highlight_rolloff)
    px = contrast(saturate(px, params.saturation, modulation), params.contrast)
    if params.chroma_rolloff > 0:
        px = roll_off_chroma(px, params.chroma_rolloff, rolloff_radius(width))
    if params.semantic > 0:
        px = render_regions(px, params.semantic)
    return px.select(*PX)
