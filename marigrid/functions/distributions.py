"""Normal, Student t and skew-normal distributions in numpy, and likelihood fits. Parameters: shapes, loc, scale."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Parameter names by family.
PARAMETERS = {"skewnorm": ("a", "loc", "scale"), "t": ("df", "loc", "scale"), "norm": ("loc", "scale")}
#: Limits of shapes.
LIMITS = {("skewnorm", "a"): (-50.0, 50.0), ("t", "df"): (2.1, 200.0)}
#: erf at the middles of steps of 1 / 128; Taylor's terms go on from there.
_STEP = 128
_AT = np.arange(6 * _STEP + 1) / _STEP
_ERF_AT = np.array([math.erf(a) for a in _AT])
_X, _W = np.polynomial.legendre.leggauss(32)
#: Values of a long sample that are worked on at once, so that what is held beside it doesn't grow with it.
BLOCK = 1 << 14


def _in_blocks(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """An element-wise function of the values, a block at a time."""
    x = np.asarray(x, float)
    if x.size <= BLOCK:
        return f(x)
    flat, out = x.reshape(-1), np.empty(x.size)
    for i in range(0, x.size, BLOCK):
        out[i : i + BLOCK] = f(flat[i : i + BLOCK])
    return out.reshape(x.shape)


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to some units in the last place."""
    x = np.asarray(x, float)
    size = np.minimum(np.abs(x), 6.0)
    i = np.rint(size * _STEP).astype(int)
    a = _AT[i]
    d = size - a
    slope = 2 / math.sqrt(math.pi) * np.exp(-a * a)
    series = d * (1 - d * (a - d * ((2 * a * a - 1) / 3 - d * (a * (2 * a * a - 3) / 6 - d * ((4 * a**4 - 12 * a * a + 3) / 30)))))
    return np.sign(x) * (_ERF_AT[i] + slope * series)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series from 10 on."""
    x = np.asarray(x, float)
    steps = np.maximum(np.ceil(10 - x), 0)
    product = np.ones_like(x)
    for i in range(10):
        product = np.where(i < steps, product * (x + i), product)
    y = x + steps
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def norm_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(z, float) / math.sqrt(2)))


def norm_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(z)) / math.sqrt(2 * math.pi)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + top * d) < tiny, tiny, 1 + top * d)
            c = np.where(np.abs(1 + top / c) < tiny, tiny, 1 + top / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


def betainc(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, element by element."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, front * _beta_fraction(a, b, np.where(low, inside, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - inside)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _owen(h: np.ndarray, a: float) -> np.ndarray:
    """Owen's T by Gauss-Legendre; slopes over 1 go through their reciprocal."""
    h = np.abs(np.asarray(h, float))
    if abs(a) > 1:
        p, q = norm_cdf(h), norm_cdf(abs(a) * h)
        return np.sign(a) * (0.5 * (p + q) - p * q - _owen(abs(a) * h, 1 / abs(a)))
    t = 0.5 * a * (_X + 1)
    return (0.5 * a * _W * np.exp(-0.5 * np.square(h)[..., None] * (1 + t * t)) / (1 + t * t)).sum(-1) / (2 * math.pi)


def cdf(family: str, x: np.ndarray, *params: float) -> np.ndarray:
    return _in_blocks(lambda part: _cdf(family, part, *params), x)


def _cdf(family: str, x: np.ndarray, *params: float) -> np.ndarray:
    *shape, loc, scale = params
    z = (x - loc) / scale
    if family == "norm":
        return norm_cdf(z)
    if family == "t":
        tail = 0.5 * betainc(shape[0] / 2, 0.5, shape[0] / (shape[0] + z * z))
        return np.where(z > 0, 1 - tail, tail)
    return np.clip(norm_cdf(z) - 2 * _owen(z, shape[0]), 0, 1)


def logpdf(family: str, x: np.ndarray, *params: float) -> np.ndarray:
    return _in_blocks(lambda part: _logpdf(family, part, *params), x)


def _logpdf(family: str, x: np.ndarray, *params: float) -> np.ndarray:
    *shape, loc, scale = params
    z = (x - loc) / scale
    if family == "t":
        v = shape[0]
        return math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(scale) - (v + 1) / 2 * np.log1p(z * z / v)
    out = -0.5 * z * z - 0.5 * math.log(2 * math.pi) - math.log(scale)
    return out + np.log(2 * np.maximum(norm_cdf(shape[0] * z), 1e-300)) if family == "skewnorm" else out


def ppf(family: str, u: np.ndarray, *params: float) -> np.ndarray:
    """Quantiles, by interpolation on a fine table of the distribution function that one Newton step refines."""
    *shape, loc, scale = params
    u = np.clip(np.asarray(u, float), 1e-12, 1 - 1e-12)
    reach = 60.0 if family == "t" else 8.5
    grid = np.sinh(np.linspace(-math.asinh(reach * 40), math.asinh(reach * 40), 4001)) / 40
    table = np.maximum.accumulate(cdf(family, grid, *shape, 0.0, 1.0))
    keep = np.concatenate([[True], np.diff(table) > 0])
    z = np.interp(u, table[keep], grid[keep])
    slope = np.exp(logpdf(family, z, *shape, 0.0, 1.0))
    step = np.where(slope > 1e-9, (cdf(family, z, *shape, 0.0, 1.0) - u) / np.maximum(slope, 1e-9), 0)
    return loc + scale * (z - np.clip(step, -0.5, 0.5))


def moments(family: str, *params: float) -> tuple[float, float]:
    """Mean and variance."""
    *shape, loc, scale = params
    if family == "t":
        return loc, scale**2 * shape[0] / (shape[0] - 2)
    d = shape[0] / math.sqrt(1 + shape[0] ** 2) if shape else 0.0
    return loc + scale * d * math.sqrt(2 / math.pi), scale**2 * (1 - 2 * d * d / math.pi)


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper tail of the F distribution, element by element."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0.0)))


def fit(family: str, x: np.ndarray) -> dict[str, float]:
    """Likelihood fit with goodness of fit; see ``ks_p`` and ``cvm_p``."""
    from marigrid.functions.optimize import nelder_mead

    x = np.sort(np.asarray(x, float))
    mean, std = x.mean(), max(x.std(), 1e-9)
    if family == "t":
        start, unpack = [math.log(8.0), 0.0, 0.0], lambda p: (2.1 + math.exp(min(p[0], 5.3)), mean + std * p[1], std * math.exp(p[2]))
    else:
        skew = float(np.clip(((x - mean) ** 3).mean() / std**3, -0.95, 0.95))
        start, unpack = [3 * skew, -0.5 * np.sign(skew), 0.1], lambda p: (float(np.clip(p[0], -50, 50)), mean + std * p[1], std * math.exp(p[2]))
    best = unpack(nelder_mead(lambda p: -logpdf(family, x, *unpack(p)).sum() / len(x), start, 400))
    fitted, n = cdf(family, x, *best), len(x)
    observed = np.searchsorted(x, x, "left") + 1
    stat = 1 / (12 * n) + np.square((2 * np.arange(1, n + 1) - 1) / (2 * n) - fitted).sum()
    return dict(zip(PARAMETERS[family], best, strict=True)) | {"ks_pval": ks_p(fitted, observed / (n + 1)), "cvm_pval": cvm_p(float(stat)), "record_length": float(n)}


#: The longer sample's size up to which the two-sample test is exact.
EXACT = 10_000


def ks_outside(n: int, m: int, h: int) -> float:
    """Chance that two samples of one continuous law differ by at least h / lcm(n, m): lattice paths that leave the band.

    Paths of n steps right and m up stand for orders of the joint sample. For equal sizes those that reach the lines are
    counted by reflection; else a column at a time, as the share of all paths up to a point that have stayed inside.
    """
    if h <= 0:
        return 1.0
    if n == m:
        # sum of (-1)^(k - 1) * 2 * C(2n, n - kh) / C(2n, n), in logarithms
        k = np.arange(1, n // h + 1)
        if not len(k):
            return 0.0
        terms = 2 * lgamma(np.array(n + 1.0)) - lgamma(n - k * h + 1.0) - lgamma(n + k * h + 1.0)
        return float(np.clip(2 * (np.where(k % 2, 1, -1) * np.exp(terms)).sum(), 0, 1))
    n, m = max(n, m), min(n, m)
    lcm = math.lcm(n, m)
    up, right = lcm // m, lcm // n
    # inside[j]: chance that a path, drawn evenly among those through (i, j), has stayed inside
    j = np.arange(m + 1)
    inside = (j * up < h).astype(float)
    for i in range(1, n + 1):
        stays = np.abs(i * right - j * up) < h
        # from the left with chance i / (i + j), from below with j / (i + j)
        left, below = inside * (i / (i + j)), j / (i + j)
        row, last = np.zeros(m + 1), 0.0
        for q in np.flatnonzero(stays):
            last = left[q] + below[q] * (last if q and stays[q - 1] else 0.0)
            row[q] = last
        inside = row
    return float(np.clip(1 - inside[m], 0, 1))


def ks_p(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sample Kolmogorov-Smirnov p-value: exact up to ``EXACT`` values in the longer sample, the limit law beyond."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    lcm = math.lcm(len(a), len(b))
    gap = int(np.abs(np.searchsorted(a, both, "right") * (lcm // len(a)) - np.searchsorted(b, both, "right") * (lcm // len(b))).max())
    if max(len(a), len(b)) <= EXACT:
        return ks_outside(len(a), len(b), gap)
    d = gap / lcm
    s = math.sqrt(len(a) * len(b) / (len(a) + len(b))) * d
    if s < 0.2:
        return 1.0
    return float(np.clip(2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * s) ** 2) for k in range(1, 101)), 0, 1))


def cvm_p(stat: float) -> float:
    """Upper tail of the Cramer-von Mises limit distribution, by its weighted sum of squares of normals."""
    if stat > 12:
        return 0.0  # under 1e-25, where the steps below are too wide for the oscillation
    # Imhof's inversion of sum z_k^2 / (k pi)^2
    u = (np.arange(4000) + 0.5) * 0.25
    k = np.arange(1, 41)
    weights = 1 / (k * math.pi) ** 2
    theta = 0.5 * np.arctan(weights[:, None] * u).sum(0) - 0.5 * stat * u + 0.5 * u * (1 / 6 - weights.sum())
    rho = np.exp(0.25 * np.log1p((weights[:, None] * u) ** 2).sum(0))
    return float(np.clip(0.5 + (np.sin(theta) / (u * rho)).sum() * 0.25 / math.pi, 0, 1))
