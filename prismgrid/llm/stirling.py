"""Numbers of tables of one dish under a Pitman-Yor process: generalised Stirling numbers.

S(c, t) counts the seatings of c customers at t tables with their weights. Up to a few thousand
customers the recurrence S(c, t) = S(c-1, t-1) + (c - 1 - d t) S(c-1, t) gives all of them. Beyond,

    S(c, t) = c! / (t! d^t) P(X_1 + ... + X_t = c),  X of the generating function 1 - (1 - z)^d,

and the probability is an integral: around the cut of the function from 1 on, or, where that would
cancel, through the saddle point on a circle. Both cost the same whatever c.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

NODES = 160


@lru_cache(maxsize=4)
def leave_ratio(discount: float, top: int) -> np.ndarray:
    """``r[c, t]``: probability that a customer leaving a dish with c customers at t tables sat alone."""
    log, ratio = np.full(top + 1, -np.inf), np.zeros((top + 1, top + 1), np.float32)
    log[0] = 0.0
    for c in range(1, top + 1):
        t = np.arange(1, c + 1)
        alone = log[t - 1]
        now = np.logaddexp(alone, np.log(np.maximum(c - 1 - discount * t, 1e-300)) + log[t])
        ratio[c, t] = np.exp(alone - now)
        log[0], log[t] = -np.inf, now
    return ratio


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive x (Stirling's series after a shift to 10 and more)."""
    x = np.asarray(x, np.float64)
    shift = np.maximum(np.ceil(10 - x), 0)
    low, y = np.zeros_like(x), x + shift
    for k in range(10):
        low += np.where(k < shift, np.log(np.where(k < shift, x + k, 1.0)), 0.0)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


def _cut(c: int, t: np.ndarray, d: float) -> np.ndarray:
    v = np.linspace(-28 / d, np.log(400.0), NODES)
    u = np.exp(v) / c
    inner = np.log1p(-(u**d) * np.exp(-1j * np.pi * d))
    whole = np.exp(t[:, None] * inner[None, :] - (c + 1) * np.log1p(u)[None, :]).imag * u[None, :]
    return np.log(np.maximum(whole.sum(axis=1) * (v[1] - v[0]) / np.pi, 1e-300))


def _saddle(c: int, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.full(len(t), -80.0), np.full(len(t), -1e-12)
    slope = lambda s: d * np.exp(s + (d - 1) * np.log1p(-np.exp(s))) / -np.expm1(d * np.log1p(-np.exp(s)))
    for _ in range(70):
        mid = (low + high) / 2
        below = t * slope(mid) < c
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    s, h = (low + high) / 2, 1e-4
    h = np.minimum(h, -s / 4)
    spread = np.sqrt(np.maximum(t * (slope(s + h) - slope(s - h)) / (2 * h), 1e-6))
    angle = np.minimum(9 / spread, np.pi)[:, None] * np.linspace(-1, 1, NODES)[None, :]
    z = np.exp(s)[:, None] * np.exp(1j * angle)
    log_f = np.log(-np.expm1(d * np.log1p(-z)))
    at_saddle = t * log_f.real.max(axis=1) - c * s
    body = np.exp(t[:, None] * log_f - c * (s[:, None] + 1j * angle) - at_saddle[:, None]).real
    body[:, [0, -1]] /= 2
    return at_saddle + np.log(np.maximum(body.sum(axis=1) * (angle[:, 1] - angle[:, 0]) / (2 * np.pi), 1e-300))


def log_sum_is(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """log P(X_1 + ... + X_t = c) for each t from 1 to c."""
    t = np.asarray(t, np.float64)
    x = t / float(c) ** d
    power = 1 / (1 - d)
    lost = (1 - d) * d ** (d * power) * x**power  # exponent of the result, and of what cancels
    turn = max(-np.cos(np.pi * d), 0.0)
    lost = lost + ((d * turn * x) ** power * (1 / d - 1) if turn else 0.0)
    out, far = np.empty(len(t)), lost > 6
    if (~far).any():
        out[~far] = _cut(c, t[~far], d)
    if far.any():
        out[far] = _saddle(c, t[far], d)
    out[t == c] = c * np.log(d)
    return out


def log_weight(c: int, t: np.ndarray, rest: float, parent: float, d: float, strength: float) -> np.ndarray:
    """log of the conditional probability of t tables, but for a constant: of a dish with c customers and
    probability ``parent`` above, in a restaurant with ``rest`` tables of other dishes."""
    return log_sum_is(c, t, d) - _log_gamma(t + 1) + _log_gamma(strength / d + rest + t) + t * np.log(parent)


def resample(c: int, rest: float, parent: float, d: float, strength: float, rng, points: int = 256) -> int:
    """A draw of t from its conditional distribution, on a lattice of at most ``points`` values around the mode
    (every value where the distribution is that narrow)."""
    low, high = 1, c
    while True:
        grid = np.unique(np.round(np.geomspace(low, high, 40) if high > 4 * low else np.linspace(low, high, 40)).astype(np.int64))
        weight = log_weight(c, grid.astype(np.float64), rest, parent, d, strength)
        near = np.flatnonzero(weight > weight.max() - 25)
        a, b = max(near[0] - 1, 0), min(near[-1] + 1, len(grid) - 1)
        if (grid[a], grid[b]) == (low, high) or grid[b] - grid[a] < points:
            low, high = int(grid[a]), int(grid[b])
            break
        low, high = int(grid[a]), int(grid[b])
    grid = np.unique(np.linspace(low, high, min(points, high - low + 1)).round().astype(np.int64))
    weight = log_weight(c, grid.astype(np.float64), rest, parent, d, strength)
    p = np.exp(weight - weight.max()) * np.gradient(grid.astype(np.float64)) if len(grid) > 1 else np.ones(1)
    return int(rng.choice(grid, p=p / p.sum()))
