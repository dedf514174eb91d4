"""Cubic spline (not-a-knot) and monotone piecewise cubic interpolation."""

from __future__ import annotations

import numpy as np


def _hermite(x: np.ndarray, y: np.ndarray, slope: np.ndarray, at: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + slope[i] * h * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + slope[i + 1] * h * t * t * (t - 1)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Needs four points; fewer give the polynomial through them."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, rhs = np.zeros((3, n)), np.zeros(n)  # bands of the system for the slopes
    a[0, 2:], a[1, 1:-1], a[2, :-2] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
    a[1, 0], a[0, 1] = h[1], h[0] + h[1]
    rhs[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[1, -1], a[2, -2] = h[-2], h[-1] + h[-2]
    rhs[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    for i in range(1, n):  # tridiagonal elimination
        w = a[2, i - 1] / a[1, i - 1]
        a[1, i] -= w * a[0, i]
        rhs[i] -= w * rhs[i - 1]
    s = np.zeros(n)
    s[-1] = rhs[-1] / a[1, -1]
    for i in range(n - 2, -1, -1):
        s[i] = (rhs[i] - a[0, i + 1] * s[i + 1]) / a[1, i]
    return _hermite(x, y, s, at)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slopes are weighted harmonic means, zero at turns."""
    if len(x) < 3:
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    s = np.zeros(len(x))
    turn = d[:-1] * d[1:] <= 0
    with np.errstate(divide="ignore", invalid="ignore"):
        s[1:-1] = np.where(turn, 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]))
    for k, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        s[k] = 0 if e * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(e) > 3 * abs(d0) else e
    return _hermite(x, y, s, at)
