"""Nelder and Mead's downhill simplex (1965) for a handful of parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimize(f: Callable[[np.ndarray], float], start: list[float], xatol: float = 1e-8, fatol: float = 1e-10, most: int = 5000) -> tuple[np.ndarray, float, bool]:
    """(point, value, converged)."""
    n = len(start)
    points = [np.array(start, float)]
    for k in range(n):
        p = points[0].copy()
        p[k] = p[k] * 1.05 if p[k] else 0.00025
        points.append(p)
    values = [f(p) for p in points]
    used = n + 1
    while True:
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) <= xatol and max(abs(v - values[0]) for v in values[1:]) <= fatol:
            return points[0], values[0], True
        if used >= most:
            return points[0], values[0], False
        centre = np.mean(points[:-1], axis=0)
        ahead = centre + (centre - points[-1])
        v = f(ahead)
        used += 1
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            u = f(far)
            used += 1
            points[-1], values[-1] = (far, u) if u < v else (ahead, v)
            continue
        if v < values[-2]:
            points[-1], values[-1] = ahead, v
            continue
        near = centre + 0.5 * ((ahead if v < values[-1] else points[-1]) - centre)
        u = f(near)
        used += 1
        if u < min(v, values[-1]):
            points[-1], values[-1] = near, u
            continue
        points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
        values = [values[0], *(f(p) for p in points[1:])]
        used += n
