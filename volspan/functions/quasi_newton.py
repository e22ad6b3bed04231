"""Broyden, Fletcher, Goldfarb and Shanno's quasi-Newton method (1970) on many small problems at once: each lane has its own point, matrix and step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Of points (lanes x parameters) and the lanes' numbers: their values and gradients.
Objective = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def minimize_lanes(f: Objective, start: np.ndarray, tolerance: float = 1e-5, most: int = 400, gain: float = 1e-11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, values, greatest absolute gradients) of all lanes. A lane ends at a gradient within the tolerance, or where the steps left promise less than ``gain``."""
    n, k = start.shape
    x, eye = start.copy(), np.eye(k)
    value, slope = f(x, np.arange(n))
    inverse = np.broadcast_to(eye, (n, k, k)).copy()
    fresh = np.ones(n, bool)  # the matrix is the identity
    way = -slope
    step = np.minimum(1.0, 1.0 / np.maximum(np.abs(slope).sum(axis=1), 1e-12))
    live = np.flatnonzero(np.abs(slope).max(axis=1) > tolerance)
    for _ in range(most):
        if not len(live):
            break
        to = x[live] + step[live, None] * way[live]
        v, g = f(to, live)
        down = np.einsum("ij,ij->i", slope[live], way[live])
        good = np.isfinite(v) & np.isfinite(g).all(axis=1) & (v <= value[live] + 1e-4 * step[live] * down)
        won, lost = live[good], live[~good]
        if len(won):
            s, y = to[good] - x[won], g[good] - slope[won]
            sy = np.einsum("ij,ij->i", s, y)
            x[won], value[won], slope[won] = to[good], v[good], g[good]
            curved = sy > 1e-10 * np.sqrt(np.einsum("ij,ij->i", s, s) * np.einsum("ij,ij->i", y, y))
            h, s, y, rho = inverse[won[curved]], s[curved], y[curved], 1.0 / sy[curved]
            scale = np.where(fresh[won[curved]], sy[curved] / np.maximum(np.einsum("ij,ij->i", y, y), 1e-300), 1.0)
            left = eye - rho[:, None, None] * s[:, :, None] * y[:, None, :]
            inverse[won[curved]] = left @ (h * scale[:, None, None]) @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
            fresh[won[curved]] = False
            way[won] = -np.einsum("ijk,ik->ij", inverse[won], slope[won])
            step[won] = np.where(curved, 1.0, np.minimum(step[won] * 2.5, 1e6))  # longer where the slope doesn't rise
        step[lost] *= 0.3
        # Uphill, or nothing to win by a step: start again along the steepest descent, once.
        flat = live[np.einsum("ij,ij->i", slope[live], way[live]) * step[live] > -gain]
        ended = flat[fresh[flat]]
        again = flat[~fresh[flat]]
        inverse[again], fresh[again], way[again] = eye, True, -slope[again]
        step[again] = np.minimum(1.0, 1.0 / np.maximum(np.abs(slope[again]).sum(axis=1), 1e-12))
        live = live[(np.abs(slope[live]).max(axis=1) > tolerance) & ~np.isin(live, ended)]
    return x, value, np.abs(slope).max(axis=1)
