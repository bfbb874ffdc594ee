"""Deconvolution of one trace by pools, and what its parameters are chosen by."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def oasis(y: np.ndarray, gamma: float, lam: float, weight_rule: str = "undamped") -> tuple[np.ndarray, np.ndarray]:
    """Non-negative decaying fit c and spikes s of an AR(1) trace.

    Samples become pools of one; a pool that starts below what the one before
    has decayed to is joined with it. The joint weight adds the later pool's
    weight undamped (``undamped``) or damped by gamma ** (2 * length) as in
    the published rule (``published``).
    """
    x = np.asarray(y, float) - lam * (1 - gamma)
    if len(x):
        x[-1] = y[-1] - lam
    value, weight, length = [], [], []
    for v in x.tolist():
        w, n = 1.0, 1
        while value and v < gamma ** length[-1] * value[-1]:
            v0, w0, n0 = value.pop(), weight.pop(), length.pop()
            damp = gamma**n0
            v = (w0 * v0 + damp * w * v) / (w0 + damp * damp * w)
            w = w0 + damp * damp + w if weight_rule == "undamped" else w0 + damp * damp * w
            n += n0
        value.append(v)
        weight.append(w)
        length.append(n)
    sizes = np.array(length, int)
    starts = np.cumsum(sizes) - sizes
    age = np.arange(len(x)) - np.repeat(starts, sizes)
    c = np.repeat(np.maximum(np.array(value), 0.0), sizes) * gamma**age
    s = np.zeros(len(x))
    at = starts[starts > 0]
    s[at] = c[at] - gamma * c[at - 1]
    return c, s


def negentropy(x: np.ndarray) -> float:
    """Squared skewness / 12 + squared excess kurtosis / 48; zero for a constant."""
    d = x - x.mean() if len(x) else x
    var = (d * d).mean() if len(x) else 0.0
    if var <= 0:
        return 0.0
    return float((d**3).mean() ** 2 / var**3 / 12 + ((d**4).mean() / var**2 - 3) ** 2 / 48)


def nelder_mead(loss: Callable[[np.ndarray], float], start: np.ndarray, iterations: int) -> np.ndarray:
    """Best point of a downhill simplex after a number of steps, with coefficients that adapt to the dimension."""
    n = len(start)
    expand, contract, shrink = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
    points = [np.array(start, float)]
    for k in range(n):
        p = np.array(start, float)
        p[k] = p[k] * 1.5 + 0.025
        points.append(p)
    values = [loss(p) for p in points]
    for _ in range(iterations):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        centre = np.mean(points[:-1], axis=0)
        away = centre - points[-1]
        tried = centre + away
        value = loss(tried)
        if value < values[0]:
            further = centre + expand * away
            beyond = loss(further)
            points[-1], values[-1] = (further, beyond) if beyond < value else (tried, value)
        elif value < values[-2]:
            points[-1], values[-1] = tried, value
        else:
            nearer = centre + (contract if value < values[-1] else -contract) * away
            inner = loss(nearer)
            if inner < min(value, values[-1]):
                points[-1], values[-1] = nearer, inner
            else:
                points = [points[0], *(points[0] + shrink * (p - points[0]) for p in points[1:])]
                values = [values[0], *(loss(p) for p in points[1:])]
    return points[int(np.argmin(values))]


def fitted(y: np.ndarray, gamma: float, lam: float, iterations: int = 10, weight_rule: str = "undamped") -> tuple[np.ndarray, np.ndarray, float, float]:
    """(c, s, gamma, lambda) with the parameters that leave the least negentropy in c - y, clamped after the search."""
    y = np.asarray(y, float)

    def loss(p: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            c, _ = oasis(y, p[0], p[1], weight_rule)
            out = negentropy(c - y)
        return out if np.isfinite(out) else np.inf

    gamma, lam = nelder_mead(loss, np.array([gamma, lam]), iterations)
    gamma, lam = min(max(float(gamma), 0.3), 0.9999), max(float(lam), 0.0)
    return (*oasis(y, gamma, lam, weight_rule), gamma, lam)


def noise_sigma(y: np.ndarray) -> float:
    """Noise deviation from the upper half of the averaged periodogram (eighths of the trace, half overlapping, no taper)."""
    n = max(2, len(y) // 8)
    step = n - n // 2
    parts = [y[a : a + n] for a in range(0, len(y) - n + 1, step)]
    if not parts:
        return float("nan")
    power = np.mean([np.abs(np.fft.rfft(p)) ** 2 / n for p in parts], axis=0)
    power[1 : (n + 1) // 2] *= 2  # one-sided
    above = np.fft.rfftfreq(n) > 0.25
    return float(np.sqrt(power[above].mean() / 2))
