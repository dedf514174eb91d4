"""Small minimisers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], steps: int = 400, low: float | None = None, tolerance: float = 1e-6) -> np.ndarray:
    """The best point of a simplex search; coordinates stay at or above ``low``."""
    fix = (lambda p: np.maximum(p, low)) if low is not None else (lambda p: p)
    points = [fix(np.array(start, float))]
    for i in range(len(start)):
        p = points[0].copy()
        p[i] = p[i] * 1.05 if p[i] else 0.25
        points.append(fix(p))
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(points[-1] - points[0]).max(), abs(values[-1] - values[0])) < tolerance:
            break
        middle = np.mean(points[:-1], axis=0)
        tried = fix(2 * middle - points[-1])
        value = f(tried)
        if value < values[0]:
            further = fix(3 * middle - 2 * points[-1])
            points[-1], values[-1] = min(((tried, value), (further, f(further))), key=lambda p: p[1])
        elif value < values[-2]:
            points[-1], values[-1] = tried, value
        else:
            inner = fix((middle + (tried if value < values[-1] else points[-1])) / 2)
            if (v := f(inner)) < min(value, values[-1]):
                points[-1], values[-1] = inner, v
            else:
                points = [points[0]] + [fix((p + points[0]) / 2) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]
