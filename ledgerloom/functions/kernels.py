"""Numerical kernels from their published definitions; numpy only."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gammaln(x) -> np.ndarray:
    return _lgamma(np.asarray(x, float))


#: Coefficients B_2k / (2k) of the asymptotic series of the digamma function. Fixed values.
_DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)


def digamma(x) -> np.ndarray:
    """Derivative of log-gamma for positive x: moved up to 10 and beyond by its recurrence, then by its asymptotic series."""
    x = np.asarray(x, float)
    small = np.where(x < 10, x, 10.0)
    step = sum(np.where(x < 10, 1 / (small + k), 0.0) for k in range(10))
    y = np.where(x < 10, x + 10, x)
    return np.log(y) - 1 / (2 * y) - sum(c * y ** (-2 * k) for k, c in enumerate(_DIGAMMA, 1)) - step


def trigamma(x) -> np.ndarray:
    """Second derivative of log-gamma for positive x, in the same way."""
    x = np.asarray(x, float)
    small = np.where(x < 10, x, 10.0)
    step = sum(np.where(x < 10, 1 / (small + k) ** 2, 0.0) for k in range(10))
    y = np.where(x < 10, x + 10, x)
    return 1 / y + 1 / (2 * y * y) + sum(2 * k * c * y ** (-2 * k - 1) for k, c in enumerate(_DIGAMMA, 1)) + step


def log_rise(z, q) -> np.ndarray:
    """log(gamma(z + q) / gamma(z)) for positive z and q, without the loss of digits that a difference of two large numbers has."""
    z, q = np.broadcast_arrays(np.asarray(z, float), np.asarray(q, float))
    far = np.where(z < 1e3, 1e3, z)
    tail = lambda y: 1 / (12 * y) - 1 / (360 * y**3)
    series = (far - 0.5) * np.log1p(q / far) + q * np.log(far + q) - q + tail(far + q) - tail(far)
    return np.where(z < 1e3, gammaln(np.minimum(z, 1e3) + q) - gammaln(np.minimum(z, 1e3)), series)


def log_beta(z, q) -> np.ndarray:
    """Log of the beta function of positive z and q, of any size."""
    z, q = np.broadcast_arrays(np.asarray(z, float), np.asarray(q, float))
    less, more = np.minimum(z, q), np.maximum(z, q)
    return gammaln(less) - log_rise(more, less)


def newton(f, start, bound: float, tol: float = 1e-9, most: int = 100):
    """Minimise ``f`` within ``bound`` of 0 in each coordinate: (point, value, converged, evaluations).

    ``f`` returns value, gradient and Hessian. Steps are Newton's where the
    Hessian is positive, along its eigenvectors by the size of their curvature
    where it is not, and no longer than a radius that grows and shrinks with how
    well the quadratic model predicts. A step ends at the first bound it meets; a
    coordinate that the gradient holds at its bound is then left out. The search
    ends where the gradient vanishes or the model promises less than the digits of
    ``f`` can show. ``converged`` is True only for a point inside all bounds.
    """
    x = np.clip(np.asarray(start, float), -bound, bound)
    value, g, h = f(x)
    radius, done = 1.0, 1
    while True:
        free = np.flatnonzero(~(((x >= bound) & (g < 0)) | ((x <= -bound) & (g > 0))))
        inside = bool((np.abs(x) < bound).all())
        if not len(free) or np.abs(g[free]).max() <= tol:
            return x, value, inside, done
        w, v = np.linalg.eigh(h[np.ix_(free, free)])
        w = np.maximum(np.abs(w), 1e-12 * max(1.0, np.abs(w).max()))
        step = np.zeros_like(x)
        step[free] = -v @ ((v.T @ g[free]) / w)
        long = np.abs(step).max()
        step *= min(1.0, radius / long)
        room = np.where(step > 0, bound - x, np.where(step < 0, x + bound, np.inf)) / np.where(step == 0, 1.0, np.abs(step))
        to = x + step * min(1.0, room.min())
        to = np.where(room <= min(1.0, room.min()), np.sign(step) * bound, to)
        step = to - x
        said = -(g @ step + 0.5 * step @ h @ step)
        if done >= most or 0 <= said < 1e-14 * (1 + abs(value)) or np.abs(step).max() < 1e-12:
            return x, value, inside and done < most, done
        at, g2, h2 = f(to)
        done += 1
        if np.isfinite(at) and at <= value + 1e-14 * (1 + abs(value)):
            if value - at > 0.5 * said and np.abs(step).max() > 0.9 * min(radius, long):
                radius = min(radius * 2, 8.0)
            x, value, g, h = to, at, g2, h2
        else:
            radius = 0.25 * np.abs(step).max()


def log_hyp2f1(a, b, c, z, terms: int = 20_000) -> np.ndarray:
    """Log of Gauss's series for positive a, b, c and 0 <= z < 1, summed with a running scale."""
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, c, z)))
    term, total, scale = np.ones(z.shape), np.ones(z.shape), np.zeros(z.shape)
    for k in range(terms):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        big = total > 1e200
        if big.any():
            scale = np.where(big, scale + math.log(1e200), scale)
            term, total = np.where(big, term / 1e200, term), np.where(big, total / 1e200, total)
        if (np.abs(term) <= 1e-17 * np.abs(total)).all():
            break
    return np.log(total) + scale


# ---- forecasting ---------------------------------------------------------

SEASON = 52
YEAR_WEEKS = 365.25 / 7


def naive(y, h):
    return np.full(h, y[-1], float)


def seasonal_naive(y, h, m: int = SEASON):
    return np.asarray(y[len(y) - m :], float)[np.arange(h) % m] if len(y) >= m else naive(y, h)


def moving_average(y, h, k: int = 4):
    return np.full(h, float(np.mean(y[-k:])))


def holt_winters(y, h, m: int = SEASON, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.1):
    """Additive Holt-Winters in error-correction form; the last value where less than a season and four weeks are known.

    The state is the level, the slope and a ring of seasonal offsets; each value's
    one-step error corrects all three.
    """
    y = np.asarray(y, float)
    if y.size < m + 4:
        return naive(y, h)
    years = y[: 2 * m]
    base = years[:m].mean()
    drift = (years[m:].mean() - base) / m if years.size == 2 * m else np.polyfit(np.arange(m), years[:m], 1)[0]
    state, ring = np.array([base, drift]), deque(years[:m] - base)
    gain = np.array([alpha, alpha * beta])
    for value in y:
        offset = ring.popleft()
        error = value - state.sum() - offset
        state = np.array([state.sum(), state[1]]) + gain * error
        ring.append(offset + gamma * (1 - alpha) * error)
    ahead = np.arange(1, h + 1)
    return state[0] + ahead * state[1] + np.array(ring)[(ahead - 1) % m]


#: The grid of smoothing weights.
GRID = tuple((a, b, g) for a in (0.1, 0.3, 0.5) for b in (0.01, 0.1) for g in (0.05, 0.2))


def holt_winters_tuned(y, h, m: int = SEASON):
    """Smoothing weights of the grid that do best on the last weeks of the training series; the default ones where none can be judged."""
    y = np.asarray(y, float)
    hold = min(h, 8)
    known = y.size - hold

    def loss(weights):
        got = np.abs(y[known:] - holt_winters(y[:known], hold, m, *weights)).mean()
        return got if np.isfinite(got) else np.inf

    if known < m + 4:
        return holt_winters(y, h, m)
    best = min(GRID, key=loss)
    return holt_winters(y, h, m, *best) if loss(best) < np.inf else holt_winters(y, h, m)


def lag_linear(y, h, lags=(1, 2, 3, 4)):
    """Least squares on trend, a yearly wave and lags, fed with its own forecasts."""
    y = np.asarray(y, float)
    n, deep = len(y), max(lags)
    if n < deep + 8:
        return naive(y, h)
    t = np.arange(deep, n)
    wave = 2 * np.pi * t / YEAR_WEEKS
    x = np.column_stack([np.ones(len(t)), t / n, np.sin(wave), np.cos(wave), *[y[deep - k : n - k] for k in lags]])
    w = np.linalg.lstsq(x, y[deep:], rcond=None)[0]
    seen = y.tolist()
    for i in range(n, n + h):
        a = 2 * np.pi * i / YEAR_WEEKS
        seen.append(float(np.dot(w, [1.0, i / n, math.sin(a), math.cos(a), *[seen[i - k] for k in lags]])))
    return np.array(seen[n:])


def mae(actual, forecast) -> float:
    return float(np.mean(np.abs(np.asarray(actual, float) - np.asarray(forecast, float))))


def mase(actual, forecast, train, m: int = SEASON) -> float:
    """MAE over that of the m-step walk inside the training series; NaN where that is 0."""
    train = np.asarray(train, float)
    m = m if len(train) > m else 1
    scale = float(np.mean(np.abs(train[m:] - train[:-m]))) if len(train) > m else float("nan")
    return mae(actual, forecast) / scale if scale and np.isfinite(scale) else float("nan")
