"""B-spline bases on uniform clamped knots in [0, 1]: knots, spans, values and derivatives (NumPy)."""

from __future__ import annotations

import numpy as np


def clamped_knots(n: int, p: int) -> np.ndarray:
    """Knots of n control points of degree p: p + 1 zeros, even steps, p + 1 ones."""
    return np.concatenate((np.zeros(p), np.linspace(0, 1, n - p + 1), np.ones(p)))


def spans_of(u: np.ndarray, knots: np.ndarray, p: int) -> np.ndarray:
    """The knot span of each parameter, in [p, n - 1]."""
    return np.clip(np.searchsorted(knots, u, side="right") - 1, p, len(knots) - p - 2)


def basis(u: np.ndarray, knots: np.ndarray, p: int, derivative: int = 0, spans: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(spans, values): values[:, k] is the derivative of basis function spans - p + k at u.

    Cox-de Boor; derivatives by the difference of bases of one degree less.
    """
    u = np.asarray(u, float)
    s = spans_of(u, knots, p) if spans is None else spans
    if derivative:
        _, low = basis(u, knots, p - 1, derivative - 1, s) if p else (s, np.zeros((len(u), 1)))
        out = np.zeros((len(u), p + 1))
        for k in range(p + 1):
            i = s - p + k
            if k > 0:
                width = knots[i + p] - knots[i]
                out[:, k] += np.where(width > 0, p / np.where(width > 0, width, 1), 0) * low[:, k - 1]
            if k < p:
                width = knots[i + p + 1] - knots[i + 1]
                out[:, k] -= np.where(width > 0, p / np.where(width > 0, width, 1), 0) * low[:, k]
        return s, out
    out = np.ones((len(u), 1))
    for d in range(1, p + 1):
        new = np.zeros((len(u), d + 1))
        for k in range(d):
            a, b = knots[s + k + 1], knots[s + k + 1 - d]
            share = out[:, k] / np.where(a > b, a - b, 1)
            new[:, k] += (a - u) * share
            new[:, k + 1] += (u - b) * share
        out = new
    return s, out


def design(u: np.ndarray, n: int, p: int, derivative: int = 0, knots: np.ndarray | None = None) -> np.ndarray:
    """The dense matrix of basis values, len(u) x n."""
    knots = clamped_knots(n, p) if knots is None else knots
    s, values = basis(u, knots, p, derivative)
    out = np.zeros((len(u), n))
    np.put_along_axis(out, s[:, None] - p + np.arange(p + 1), values, axis=1)
    return out


def normal_matrix(u: np.ndarray, n: int, p: int, smooth: float = 0.0, orders: tuple[int, ...] = (2,), knots: np.ndarray | None = None) -> np.ndarray:
    """N'N, plus smooth times the squared derivatives of the given orders at the sample parameters."""
    m = design(u, n, p, 0, knots)
    out = m.T @ m
    for k in orders if smooth else ():
        d = design(u, n, p, k, knots)
        out += smooth * d.T @ d
    return out


def greville(knots: np.ndarray, p: int) -> np.ndarray:
    """Averages of p consecutive inner knots: the abscissa of each control point."""
    return np.array([knots[i + 1 : i + p + 1].mean() for i in range(len(knots) - p - 1)]) if p else (knots[1:] + knots[:-1]) / 2


def derivative_coordinates(knots: np.ndarray, p: int) -> np.ndarray:
    """Coordinates of the derivative's control points, of one degree less on the inner knots."""
    return greville(knots[1:-1], p - 1)
