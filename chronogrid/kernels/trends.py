"""Trend tests that allow for autocorrelation and seasons, and smoothing."""

from __future__ import annotations

import math

import numpy as np

from .distributions import normal_cdf, t_two_sided


def _scores(v: np.ndarray) -> tuple[float, float, float]:
    """S, its variance with ties, and Sen's slope over the index."""
    n = len(v)
    i, j = np.triu_indices(n, 1)
    d = v[j] - v[i]
    _, t = np.unique(v, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - np.sum(t * (t - 1) * (2 * t + 5))) / 18
    return float(np.sign(d).sum()), float(var), float(np.median(d / (j - i)))


def _autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    x = x - x.mean()
    c0 = float(x @ x)
    return np.array([float(x[: len(x) - k] @ x[k:]) / c0 if c0 > 0 else 0.0 for k in range(1, lags + 1)])


def _result(s: float, var: float, slope: float, v: np.ndarray, alpha: float, n: int) -> dict:
    z = 0.0 if s == 0 or var <= 0 else (s - math.copysign(1, s)) / math.sqrt(var)
    p = 2 * (1 - normal_cdf(abs(z)))
    trend = int(math.copysign(1, z)) if p < alpha and z else 0
    pairs = n * (n - 1) / 2
    return {"z": z, "p": p, "tau": s / pairs if pairs else None, "slope": slope, "intercept": float(np.median(v)) - slope * (len(v) - 1) / 2, "trend": trend, "sig_slope": slope if trend else None}


def mann_kendall(method: str = "hamed_rao", alpha: float = 0.05, min_valid: int = 4, period: int = 12):
    """Variants: `hamed_rao` (1998) and `yue_wang` (2004) inflate the variance by the autocorrelation of ranks or of detrended values; `seasonal` (Hirsch 1982) sums S over seasons."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        n = len(v)
        if n < min_valid:
            return {}
        s, var, slope = _scores(v)
        if method == "seasonal":
            season = np.floor((years % 1) * period).astype(int)
            groups = [v[season == k] for k in range(period)]
            parts = [_scores(g) for g in groups if len(g) > 1]
            if not parts:
                return {}
            slopes = np.concatenate([(lambda d, y: d / y)(g[j] - g[i], yr[j] - yr[i]) for g, yr in ((v[season == k], years[season == k]) for k in range(period)) if len(g) > 1 for i, j in [np.triu_indices(len(g), 1)]])
            pairs = sum(len(g) * (len(g) - 1) / 2 for g in groups)
            out = _result(sum(p[0] for p in parts), sum(p[1] for p in parts), float(np.median(slopes)), v, alpha, n)
            return out | {"tau": sum(p[0] for p in parts) / pairs}
        rest = v - slope * np.arange(n)
        if method == "hamed_rao":
            ranks = np.argsort(np.argsort(rest, kind="stable"), kind="stable").astype(float)
            r = _autocorrelation(ranks, n - 1)
            r = np.where(np.abs(r) > 1.959963984540054 / math.sqrt(n), r, 0)
            k = np.arange(1, n)
            factor = 1 + 2 / (n * (n - 1) * (n - 2)) * np.sum((n - k) * (n - k - 1) * (n - k - 2) * r)
        else:
            r = _autocorrelation(rest, n - 1)
            k = np.arange(1, n)
            factor = 1 + 2 * np.sum((1 - k / n) * np.where(np.abs(r) > 1.959963984540054 / math.sqrt(n), r, 0))
        return _result(s, var * max(factor, 1e-6), slope, v, alpha, n)

    return kernel


MANN_KENDALL = "z double, p double, tau double, slope double, intercept double, trend int, sig_slope double"


def autoregressive_trend(alpha: float = 0.05, min_valid: int = 6):
    """Linear trend with AR(1) errors by restricted maximum likelihood (after Ives and others 2021): the autocorrelation is found by golden section."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        n = len(v)
        if n < min_valid or np.ptp(v) == 0:
            return {}
        x = np.column_stack([np.ones(n), np.arange(n) / max(1, n - 1)])

        def solve(rho: float):
            w = math.sqrt(1 - rho * rho)
            wx = np.vstack([w * x[0], x[1:] - rho * x[:-1]])
            wy = np.concatenate([[w * v[0]], v[1:] - rho * v[:-1]])
            xx = wx.T @ wx
            b = np.linalg.solve(xx, wx.T @ wy)
            e = wy - wx @ b
            s2 = float(e @ e) / (n - 2)
            loss = (n - 2) * math.log(max(s2, 1e-300)) - math.log(1 - rho * rho) + math.log(np.linalg.det(xx))
            return loss, b, s2, np.linalg.inv(xx)

        lo, hi, g = -0.95, 0.95, (math.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if solve(a)[0] < solve(b)[0] else (a, hi)
        rho = (lo + hi) / 2
        _, b, s2, cov = solve(rho)
        se = math.sqrt(s2 * cov[1, 1])
        t = b[1] / se if se > 0 else 0.0
        p = t_two_sided(t, n - 2)
        return {"slope": b[1], "intercept": b[0], "se": se, "t": t, "p": p, "rho": rho, "sd": math.sqrt(s2), "significant": int(p < alpha)}

    return kernel


AUTOREGRESSIVE = "slope double, intercept double, se double, t double, p double, rho double, sd double, significant int"


def whittaker(lmbda: float, order: int = 2):
    """Penalised least squares on the dates' own order: (I + lambda D'D) z = v, solved in banded form by Cholesky."""

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        n = len(v)
        if n <= order:
            return [{"year": t, "value": x} for t, x in zip(years, v, strict=True)]
        d = np.diff(np.eye(min(n, order + 1)), order, axis=0)[0][::-1]  # one row of the difference operator
        band = np.zeros((order + 1, n))  # band[k, i] = A[i, i + k]
        band[0] = 1.0
        for r in range(n - order):
            for a in range(order + 1):
                for b in range(a, order + 1):
                    band[b - a, r + a] += lmbda * d[a] * d[b]
        low = np.zeros_like(band)
        for i in range(n):
            for k in range(order + 1):
                j = i + k
                if j >= n:
                    break
                s = band[k, i]
                for m in range(max(0, j - order), i):
                    s -= low[i - m, m] * low[j - m, m]
                low[k, i] = math.sqrt(s) if k == 0 else s / low[0, i]
        y = v.astype(float).copy()
        for i in range(n):
            for m in range(max(0, i - order), i):
                y[i] -= low[i - m, m] * y[m]
            y[i] /= low[0, i]
        for i in range(n - 1, -1, -1):
            for m in range(i + 1, min(n, i + order + 1)):
                y[i] -= low[m - i, i] * y[m]
            y[i] /= low[0, i]
        return [{"year": t, "value": x} for t, x in zip(years, y, strict=True)]

    return kernel


def savitzky_golay(window: int, polyorder: int):
    """Value at each date of the polynomial through the `window` dates around it; edges use the first and last full windows."""

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        n, w = len(v), min(window | 1, len(v) if len(v) % 2 else len(v) - 1)
        if n == 0 or w <= polyorder:
            return [{"year": t, "value": x} for t, x in zip(years, v, strict=True)]
        half = w // 2
        out = np.empty(n)
        for i in range(n):
            a = min(max(0, i - half), n - w)
            x = np.arange(w) - (i - a)
            out[i] = np.polynomial.polynomial.polyfit(x, v[a : a + w], polyorder)[0]
        return [{"year": t, "value": x} for t, x in zip(years, out, strict=True)]

    return kernel


SMOOTHED = "year double, value double"


def harmonic_interpolation(step_days: int, modes: int, trend: bool = True):
    """Least squares of harmonics of the year (and a line) at regular dates."""

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        if len(v) < 2 * modes + 2:
            return []
        grid = np.arange(years[0], years[-1], step_days / 365.25)

        def design(t):
            return np.column_stack([np.ones(len(t))] + ([t - years[0]] if trend else []) + [f(2 * np.pi * k * t) for k in range(1, modes + 1) for f in (np.cos, np.sin)])

        b = np.linalg.lstsq(design(years), v, rcond=None)[0]
        return [{"year": t, "value": x} for t, x in zip(grid, design(grid) @ b, strict=True)]

    return kernel


def polar_metrics(start: float = 0.2, middle: float = 0.5, end: float = 0.8):
    """Seasons by polar coordinates (after Brooks and others 2017): the year turns about its mean vector, and dates at which shares of the year's sum are reached mark the season."""

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        if len(v) < 8:
            return []
        angle = 2 * np.pi * (years % 1)
        turn = math.atan2(float((v * np.sin(angle)).sum()), float((v * np.cos(angle)).sum()))
        offset = ((turn + np.pi) / (2 * np.pi)) % 1  # the season's year begins opposite to its mean direction
        season = np.floor(years - offset).astype(int)
        out = []
        for y in np.unique(season):
            here = season == y
            t, x = years[here], np.maximum(v[here], 0)
            if here.sum() < 4 or x.sum() <= 0:
                continue
            share = np.cumsum(x) / x.sum()
            at = [float(np.interp(q, share, t)) for q in (start, middle, end)]
            a = 2 * np.pi * (t % 1)
            r = math.hypot(float((x * np.cos(a)).sum()), float((x * np.sin(a)).sum())) / x.sum()
            out.append({"season": y, "start": at[0], "middle": at[1], "end": at[2], "length": (at[2] - at[0]) * 365.25, "mean": float(x.mean()), "std": float(x.std(ddof=1)), "seasonality": r, "peak": float(x.max())})
        return out

    return kernel


POLAR = "season int, start double, middle double, end double, length double, mean double, std double, seasonality double, peak double"
