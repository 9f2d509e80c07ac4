"""Breaks, segments and monitoring of one key's series, from the papers that name them."""

from __future__ import annotations

import math

import numpy as np

from .distributions import chi2_quantile, f_sf


def design(t: np.ndarray, harmonics: int, t0: float) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), t - t0] + [f(2 * np.pi * k * t) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, float(e @ e)


# -- LandTrendr (Kennedy, Yang and Cohen 2010) -------------------------------------------------------------------------


def _despiked(v: np.ndarray, threshold: float) -> np.ndarray:
    v = v.copy()
    for _ in range(len(v)):
        if len(v) < 3:
            break
        mid = (v[:-2] + v[2:]) / 2
        spike = np.abs(v[1:-1] - mid)
        span = np.maximum(np.abs(v[2:] - v[:-2]), 1e-12)
        share = np.where(spike > 0, 1 - span / np.maximum(spike, 1e-12), 0)
        k = int(np.argmax(share))
        if share[k] <= threshold:
            break
        v[k + 1] = mid[k]
    return v


def _vertices(t: np.ndarray, v: np.ndarray, n: int) -> list[int]:
    at = [0, len(v) - 1]
    while len(at) < n:
        best = (0.0, -1)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a < 2:
                continue
            _, _, rest = _line(t[a : b + 1], v[a : b + 1])
            k = int(np.argmax(np.abs(rest[1:-1]))) + 1
            if abs(rest[k]) > best[0]:
                best = (abs(rest[k]), a + k)
        if best[1] < 0:
            break
        at = sorted([*at, best[1]])
    return at


def _line(t, v):
    b = np.polynomial.polynomial.polyfit(t - t[0], v, 1)
    return b[0], b[1], v - b[0] - b[1] * (t - t[0])


def _joined(t: np.ndarray, v: np.ndarray, at: list[int]) -> np.ndarray:
    """Least squares of the vertices' heights for a line through them."""
    m = np.zeros((len(t), len(at)))
    for k in range(len(at)):
        unit = np.zeros(len(at))
        unit[k] = 1
        m[:, k] = np.interp(t, t[at], unit)
    return np.linalg.lstsq(m, v, rcond=None)[0]


def landtrendr(max_segments: int = 6, p_value: float = 0.05, recovery: float = 0.25, spike: float = 0.9, proportion: float = 0.75, overshoot: int = 3, min_observations: int = 6, loss: bool = True):
    """Segments between vertices; the event of greatest change: year, magnitude, duration, values around it, rate, and its ratio to the noise."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        y, first = np.unique(np.floor(years), return_index=True)
        v = np.array([v[np.floor(years) == k].mean() for k in y])
        n = len(v)
        if n < min_observations:
            return {}
        clean = _despiked(v, spike)
        at = _vertices(y, clean, min(max_segments + 1 + overshoot, n))
        while len(at) > max_segments + 1:  # the vertex with the least angle goes
            slope = np.diff(clean[at]) / np.diff(y[at])
            at.pop(int(np.argmin(np.abs(np.diff(slope)))) + 1)
        total = float(((clean - clean.mean()) ** 2).sum())
        models = []
        while True:
            h = _joined(y, clean, at)
            sse = float(((clean - np.interp(y, y[at], h)) ** 2).sum())
            seg = len(at) - 1
            rate = np.diff(h) / np.diff(y[at]) / max(np.ptp(clean), 1e-12)
            if not (rate > recovery).any() or not loss:
                d1, d2 = 2 * seg, n - 2 * seg - 1
                f = ((total - sse) / d1) / (sse / d2) if d2 > 0 and sse > 0 else (math.inf if sse == 0 and total > 0 else 0.0)
                models.append((f_sf(f, d1, d2) if np.isfinite(f) else 0.0, seg, list(at), h, sse))
            if len(at) == 2:
                break
            costs = []
            for k in range(1, len(at) - 1):
                less = at[:k] + at[k + 1 :]
                costs.append(float(((clean - np.interp(y, y[less], _joined(y, clean, less))) ** 2).sum()))
            at.pop(int(np.argmin(costs)) + 1)
        models = [m for m in models if m[0] <= p_value]
        if not models:
            return {"n_segments": 0}
        best = min(m[0] for m in models)
        _, seg, at, h, sse = max((m for m in models if proportion * m[0] <= best + 1e-300 or m[0] == best), key=lambda m: m[1])
        noise = math.sqrt(sse / n)
        step = -np.diff(h) if loss else np.diff(h)
        k = int(np.argmax(step))
        out = {"n_segments": seg, "rmse": noise}
        if step[k] > 0:
            a, b = at[k], at[k + 1]
            out |= {"yod": int(y[a]) + 1, "magnitude": step[k], "duration": y[b] - y[a], "pre_value": h[k], "post_value": h[k + 1], "rate": step[k] / (y[b] - y[a]), "dsnr": step[k] / noise if noise > 0 else None}
        return out

    return kernel


LANDTRENDR = "n_segments int, rmse double, yod int, magnitude double, duration double, pre_value double, post_value double, rate double, dsnr double"


def recovery(horizon: int = 5, pre_years: int = 2, target: float = 0.8):
    """After the greatest loss between years: years to recover, share recovered at the horizon, and the index of recovery."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        y = np.unique(np.floor(years))
        a = np.array([v[np.floor(years) == k].mean() for k in y])
        if len(a) < 3:
            return {}
        d = a[:-1] - a[1:]
        k = int(np.argmax(d))
        if d[k] <= 0:
            return {"magnitude": 0.0}
        pre = float(a[max(0, k + 1 - pre_years) : k + 1].mean())
        low, loss = float(a[k + 1]), pre - float(a[k + 1])
        after, at = a[k + 1 :], y[k + 1 :] - y[k + 1]
        hit = np.flatnonzero(after >= low + target * loss)
        within = after[at <= horizon]
        return {"yod": int(y[k + 1]), "magnitude": loss, "pre_value": pre, "y2r": float(at[hit[0]]) if len(hit) and loss > 0 else None, "r80p": float(within.max()) / (target * pre) if pre else None, "rri": float(within.max() - low) / loss if loss > 0 else None, "ari": float(within.max() - low)}

    return kernel


RECOVERY = "yod int, magnitude double, pre_value double, y2r double, r80p double, rri double, ari double"


# -- breaks of a harmonic regression (after Bai and Perron 2003, as in BFAST Lite) ---------------------------------------


def break_points(h: float = 0.15, max_breaks: int = 5, harmonics: int = 1):
    """Break dates of trend and season that minimise the residuals for each number of breaks; the number by BIC."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        n, p = len(v), 2 + 2 * harmonics
        least = max(int(math.ceil(h * n)), p + 1)
        if n < 2 * least:
            return {"n_breaks": 0} if n > p else {}
        x = design(years, harmonics, years[0])
        cost = np.full((n + 1, n + 1), np.inf)
        outer, cross = x[:, :, None] * x[:, None, :], x * v[:, None]
        for a in range(0, n - least + 1):  # residuals of all segments that begin at a, solved together
            xx = np.cumsum(outer[a:], axis=0)[least - 1 :] + np.eye(p) * 1e-9
            xy = np.cumsum(cross[a:], axis=0)[least - 1 :]
            yy = np.cumsum(v[a:] ** 2)[least - 1 :]
            cost[a, a + least :] = np.maximum(0.0, yy - (xy * np.linalg.solve(xx, xy[:, :, None])[:, :, 0]).sum(axis=1))
        best, back = [cost[0].copy()], [np.zeros(n + 1, int)]
        for _ in range(min(max_breaks, n // least - 1)):
            through = best[-1][:, None] + cost
            back.append(np.argmin(through, axis=0))
            best.append(through[back[-1], np.arange(n + 1)])
        scores = [n * math.log(max(b[n], 1e-12) / n) + (p * (m + 1) + m) * math.log(n) for m, b in enumerate(best)]
        m = int(np.argmin(scores))
        at, e = [], n
        for k in range(m, 0, -1):
            e = int(back[k][e])
            at.append(e)
        at = sorted(at)
        out = {"n_breaks": m, "bic": scores[m]}
        if at:
            edges = [0, *at, n]
            jumps = []
            for k, b in enumerate(at):
                left, _ = fit(x[edges[k] : b], v[edges[k] : b])
                right, _ = fit(x[b : edges[k + 2]], v[b : edges[k + 2]])
                jumps.append(float(x[b] @ right - x[b] @ left))
            k = int(np.argmax(np.abs(jumps)))
            out |= {"first_break": years[at[0]], "break_date": years[at[k]], "magnitude": jumps[k]}
        return out

    return kernel


BREAKS = "n_breaks int, bic double, first_break double, break_date double, magnitude double"


def monitor(start: float, harmonics: int = 1, h: float = 0.25, limit: float = 2.7):
    """BFAST Monitor (Verbesselt and others 2012): moving sums of the residuals that a fit to the history leaves; the first that passes the boundary."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        past = years < start
        n, p = int(past.sum()), 2 + 2 * harmonics
        if n <= p + 1 or n == len(v):
            return {}
        x = design(years, harmonics, years[0])
        b, sse = fit(x[past], v[past])
        sigma = math.sqrt(sse / (n - p))
        if sigma == 0:
            return {"has_break": 0}
        e, w = v - x @ b, max(1, int(h * n))
        sums = np.convolve(e, np.ones(w), "valid") / (sigma * math.sqrt(n))
        ends = np.arange(w - 1, len(v))
        ratio = (ends + 1) / n
        edge = limit * np.sqrt(2 * np.maximum(1.0, np.log(np.maximum(ratio, 1.0)))) * math.sqrt(h)
        hit = np.flatnonzero((ends >= n) & (np.abs(sums) > edge))
        out = {"has_break": int(len(hit) > 0), "sigma": sigma, "magnitude": float(np.median(e[~past]))}
        return out | ({"break_date": years[ends[hit[0]]]} if len(hit) else {})

    return kernel


MONITOR = "has_break int, sigma double, magnitude double, break_date double"


def ewmacd(train_end: float, lmbda: float = 0.3, harmonics: int = 2, xbar: float = 1.5, sigmas: float = 3.0, persistence: int = 5):
    """EWMACD (Brooks and others 2014): an exponentially weighted chart of the residuals of a harmonic fit to the training years."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        train = years < train_end
        p = 1 + 2 * harmonics
        if train.sum() <= p + 1:
            return {}
        x = np.delete(design(years, harmonics, years[0]), 1, axis=1)
        b, sse = fit(x[train], v[train])
        s = math.sqrt(sse / (train.sum() - p))
        if s == 0:
            return {"state": 0}
        e = v - x @ b
        keep = train & (np.abs(e) < xbar * s)  # outliers leave the training
        if keep.sum() > p + 1:
            b, sse = fit(x[keep], v[keep])
            s, e = math.sqrt(sse / (keep.sum() - p)) or s, v - x @ b
        z, flags = 0.0, []
        for i, r in enumerate(e):
            r = math.copysign(min(abs(r), 20 * s), r)
            z = (1 - lmbda) * z + lmbda * r
            edge = s * sigmas * math.sqrt(lmbda / (2 - lmbda) * (1 - (1 - lmbda) ** (2 * (i + 1))))
            flags.append(int(math.trunc(z / edge)))
        state, since, out, run = 0, 0, {}, 0
        for i, f in enumerate(flags):
            sign = (f > 0) - (f < 0)
            run = run + 1 if i and sign == since else 1
            since = sign
            if run >= persistence and sign != state:
                state = sign
                at = years[i - persistence + 1]
                if sign < 0 and "break_date" not in out:
                    out |= {"break_date": at, "severity": f}
                elif sign >= 0 and "break_date" in out and "recovery_date" not in out:
                    out["recovery_date"] = at
        return out | {"state": state, "last_flag": flags[-1], "sigma": s}

    return kernel


EWMACD = "break_date double, severity int, recovery_date double, state int, last_flag int, sigma double"


# -- continuous change detection (Zhu and Woodcock 2014) ------------------------------------------------------------------


def ccdc(consecutive: int = 6, probability: float = 0.99, least: int = 12, coefficients: int = 4):
    """Segments of harmonic models in all bands; a break where `consecutive` dates in a row are too far, by chi square over the bands."""

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        n, bands = v.shape
        limit = chi2_quantile(probability, bands)
        x = design(years, max(1, (coefficients - 2) // 2), years[0] if n else 0.0)[:, :coefficients]
        out, a = [], 0
        while n - a >= least:
            e = a + least

            def model(lo, hi):
                b = np.linalg.lstsq(x[lo:hi], v[lo:hi], rcond=None)[0]
                r = v[lo:hi] - x[lo:hi] @ b
                return b, np.maximum(np.sqrt((r * r).sum(axis=0) / max(1, hi - lo - coefficients)), 1e-9)

            b, rmse = model(a, e)
            run, broke = 0, False
            skip = np.zeros(n, bool)
            while e < n:
                far = float((((v[e] - x[e] @ b) / rmse) ** 2).sum()) > limit
                run = run + 1 if far else 0
                skip[e] = far
                e += 1
                if run >= consecutive:
                    broke = True
                    break
                if not far and (e - a) % max(1, least // 2) == 0:
                    rows = np.flatnonzero(~skip[a:e]) + a
                    b = np.linalg.lstsq(x[rows], v[rows], rcond=None)[0]
                    r = v[rows] - x[rows] @ b
                    rmse = np.maximum(np.sqrt((r * r).sum(axis=0) / max(1, len(rows) - coefficients)), 1e-9)
            stop = e - consecutive if broke else e
            change = np.median(v[stop:e] - x[stop:e] @ b, axis=0) if broke else None
            out.append({"segment": len(out), "start": years[a], "end": years[stop - 1], "n": stop - a, "break_date": years[stop] if broke else None, "magnitude": float(np.sqrt((change**2).sum())) if broke else None, "rmse": float(rmse.mean()), "slope": float(b[1].mean())})
            a = stop if broke else n
        return out

    return kernel


CCDC = "segment int, start double, end double, n int, break_date double, magnitude double, rmse double, slope double"


def kalman_state(harmonics: int = 1, consecutive: int = 4, probability: float = 0.99, noise: float = 0.01):
    """A running harmonic state (Kalman filter) that is near real time: breaks where innovations stay too far; the last state."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        p = 2 + 2 * harmonics
        if len(v) < 2 * p:
            return {}
        x = design(years, harmonics, years[0])
        b, sse = fit(x[: 2 * p], v[: 2 * p])
        r = max(sse / p, 1e-9)
        cov, run, n_breaks, last = np.eye(p) * r, 0, 0, None
        limit = chi2_quantile(probability, 1)
        for i in range(2 * p, len(v)):
            cov = cov + np.eye(p) * r * noise
            innovation = v[i] - x[i] @ b
            s = float(x[i] @ cov @ x[i]) + r
            if innovation * innovation / s > limit:
                run += 1
                if run >= consecutive:
                    n_breaks, last, run = n_breaks + 1, years[i - consecutive + 1], 0
                    cov = np.eye(p) * r * 10
                continue
            run = 0
            gain = cov @ x[i] / s
            b = b + gain * innovation
            cov = cov - np.outer(gain, x[i] @ cov)
        return {"n_breaks": n_breaks, "last_break": last, "level": float(b[0] + b[1] * (years[-1] - years[0])), "run": run}

    return kernel


KALMAN = "n_breaks int, last_break double, level double, run int"


def robust_outliers(harmonics: int = 1, limit: float = 3.0):
    """Tmask (Zhu and Woodcock 2014): dates far from a robust harmonic fit by iteratively reweighted least squares."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        n, p = len(v), 2 + 2 * harmonics
        if n <= p:
            return {}
        x, w = design(years, harmonics, years[0]), np.ones(n)
        for _ in range(20):
            s = np.sqrt(w)[:, None]
            b = np.linalg.lstsq(x * s, v * s[:, 0], rcond=None)[0]
            e = v - x @ b
            mad = float(np.median(np.abs(e))) / 0.6745
            if mad == 0:
                return {"n_flagged": 0, "share": 0.0}
            u = np.clip(np.abs(e) / (4.685 * mad), 0, 1)
            w = np.maximum((1 - u * u) ** 2, 1e-9)
        flagged = int((np.abs(e) > limit * mad).sum())
        return {"n_flagged": flagged, "share": flagged / n, "scale": mad}

    return kernel


OUTLIERS = "n_flagged int, share double, scale double"


def phenology(share: float = 0.5, min_amplitude: float = 0.0, lmbda: float = 10.0):
    """Start, peak and end of each year's season where the smoothed series crosses a share of the amplitude."""
    from .trends import whittaker

    smooth = whittaker(lmbda)

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        if len(v) < 6:
            return []
        z = np.array([r["value"] for r in smooth(years, v)])
        out = []
        for y in np.unique(np.floor(years)):
            here = np.flatnonzero(np.floor(years) == y)
            if len(here) < 6:
                continue
            t, s = years[here], z[here]
            k = int(np.argmax(s))
            left, right = float(s[: k + 1].min()), float(s[k:].min())
            height = float(s[k]) - (left + right) / 2
            if height <= min_amplitude:
                continue
            up, down = left + share * (s[k] - left), right + share * (s[k] - right)
            a = next((i for i in range(k, 0, -1) if s[i - 1] < up <= s[i]), None)
            b = next((i for i in range(k, len(s) - 1) if s[i] >= down > s[i + 1]), None)
            start = t[a - 1] + (t[a] - t[a - 1]) * (up - s[a - 1]) / (s[a] - s[a - 1]) if a is not None else None
            end = t[b] + (t[b + 1] - t[b]) * (s[b] - down) / (s[b] - s[b + 1]) if b is not None else None
            doy = lambda x: None if x is None else (x - y) * 365.25 + 1  # noqa: B023, E731
            out.append({"year": int(y), "start_doy": doy(start), "peak_doy": doy(t[k]), "end_doy": doy(end), "length": (end - start) * 365.25 if start is not None and end is not None else None, "peak": float(s[k]), "amplitude": height})
        return out

    return kernel


PHENOLOGY = "year int, start_doy double, peak_doy double, end_doy double, length double, peak double, amplitude double"


def twdtw(patterns: dict[str, tuple[list[float], list[float]]], steepness: float = 0.1, midpoint: float = 50.0, max_distance: float | None = None):
    """Time-weighted dynamic time warping (Maus and others 2016) to named patterns (days of the year, values): the nearest class, its distance, and its margin."""
    known = {k: (np.asarray(d, float), np.asarray(x, float)) for k, (d, x) in patterns.items()}

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        if not len(v):
            return {}
        day, found = (years % 1) * 365.25, {}
        for name, (d, x) in known.items():
            gap = np.abs(day[None, :] - d[:, None])
            gap = np.minimum(gap, 365.25 - gap)
            cost = np.abs(x[:, None] - v[None, :]) + 1 / (1 + np.exp(-steepness * (gap - midpoint)))
            acc = np.full(cost.shape, np.inf)
            acc[0] = cost[0]  # a match may begin and end anywhere in the series
            for i in range(1, len(d)):
                acc[i, 0] = acc[i - 1, 0] + cost[i, 0]
                for j in range(1, len(v)):
                    acc[i, j] = cost[i, j] + min(acc[i - 1, j], acc[i, j - 1], acc[i - 1, j - 1])
            found[name] = float(acc[-1].min())
        order = sorted(found, key=lambda k: (found[k], k))
        best = order[0]
        if max_distance is not None and found[best] > max_distance:
            return {"distance": found[best]}
        return {"class": best, "distance": found[best], "margin": found[order[1]] - found[best] if len(order) > 1 else None}

    return kernel


TWDTW = "class string, distance double, margin double"


def omnibus(looks: float, alpha: float = 0.01):
    """Omnibus test of equal backscatter (Conradsen and others 2016) and, date by date, the first and last change of its sequence."""
    from .distributions import chi2_cdf

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        ok = v > 0
        x, t = v[ok], years[ok]
        k = len(x)
        if k < 2:
            return {}

        def p_of(y: np.ndarray) -> float:
            m = len(y)
            q = looks * (m * math.log(m) + float(np.log(y).sum()) - m * math.log(float(y.sum())))
            rho = 1 - (m / looks - 1 / (looks * m)) / (6 * (m - 1))
            return 1 - chi2_cdf(-2 * rho * q, m - 1)

        whole, changes, a = p_of(x), [], 0
        if whole < alpha:
            while a < k - 1:
                j = next((j for j in range(a + 2, k + 1) if p_of(x[a:j]) < alpha), None)
                if j is None:
                    break
                changes.append((j - 1, x[j - 1] - x[a : j - 1].mean()))
                a = j - 1
        out = {"p_change": whole, "n_changes": len(changes), "n_dates": k}
        if changes:
            big = max(changes, key=lambda c: abs(c[1]))
            out |= {"first_change": t[changes[0][0]], "last_change": t[changes[-1][0]], "greatest_change": t[big[0]], "direction": int(math.copysign(1, big[1]))}
        return out

    return kernel


OMNIBUS = "p_change double, n_changes int, n_dates int, first_change double, last_change double, greatest_change double, direction int"


def unmix(endmembers: dict[str, list[float]], sum_to_one: bool = True):
    """Fractions of endmembers in each date's bands: not negative, and of sum one (fully constrained least squares)."""
    names, solve = list(endmembers), unmixed(endmembers, sum_to_one)

    def kernel(years: np.ndarray, v: np.ndarray) -> list[dict]:
        f, rmse = solve(v)
        return [{"year": t, "rmse": float(e), **{f"f_{k}": float(x) for k, x in zip(names, row, strict=True)}} for t, e, row in zip(years, rmse, f, strict=True)]

    return kernel


#: Endmembers up to which all their subsets are solved; with more, each row takes active sets.
SUBSETS = 6


def unmixed(endmembers: dict[str, list[float]], sum_to_one: bool = True):
    """Fractions and error of many rows of bands at once.

    The least error without negative fractions is that of plain least squares over some subset of the endmembers; each
    subset is one matrix product, and every row takes the best of those that give it no negative fraction.
    """
    e = np.array(list(endmembers.values()), dtype=float).T
    n = e.shape[1]
    weight = 1e3 * max(1.0, float(np.abs(e).max()))
    a = np.vstack([e, np.full(n, weight)]) if sum_to_one else e
    subsets = [[k for k in range(n) if bits >> k & 1] for bits in range(1, 1 << n)] if n <= SUBSETS else []
    inverses = [np.linalg.pinv(a[:, k]) for k in subsets]

    def solve(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.column_stack([v, np.full(len(v), weight)]) if sum_to_one else v
        if subsets:
            f, least = np.zeros((len(v), n)), (y**2).sum(axis=1)
            for k, inverse in zip(subsets, inverses, strict=True):
                x = y @ inverse.T
                error = ((y - x @ a[:, k].T) ** 2).sum(axis=1)
                better = (x >= 0).all(axis=1) & (error < least)
                least[better] = error[better]
                f[better] = 0
                f[np.ix_(better, k)] = x[better]
        else:
            f = np.array([nonnegative(a, row) for row in y]).reshape(len(y), n)
        return f, np.sqrt(((v - f @ e.T) ** 2).mean(axis=1))

    return solve


def nonnegative(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares without negative coefficients, by active sets (Lawson and Hanson 1974)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(30 * n):
        w = a.T @ (y - a @ x)
        w[free] = -np.inf
        k = int(np.argmax(w))
        if free.all() or w[k] <= 1e-9 * max(1.0, float(np.abs(y).max())):
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def coded(train_years: float = 3.0, consecutive: int = 3, threshold: float = 3.0, harmonics: int = 1):
    """Change in an index after a training span (after Bullock and others 2020): dates below the fit for a number in a row; the model starts anew after each event."""

    def kernel(years: np.ndarray, v: np.ndarray) -> dict:
        events, a = [], 0
        while True:
            train = (np.arange(len(v)) >= a) & (years < (years[a] if a < len(v) else 0) + train_years)
            p = 2 + 2 * harmonics
            if a >= len(v) or train.sum() <= p:
                break
            x = design(years, harmonics, years[a])
            b, sse = fit(x[train], v[train])
            s = math.sqrt(sse / (train.sum() - p))
            e = (v - x @ b) / max(s, 1e-9)
            run, hit = 0, None
            for i in np.flatnonzero((years >= years[a] + train_years)):
                run = run + 1 if e[i] < -threshold else 0
                if run >= consecutive:
                    hit = i - consecutive + 1
                    break
            if hit is None:
                break
            events.append((years[hit], float(np.mean((v - x @ b)[hit : hit + consecutive]))))
            a = hit + consecutive
        out = {"n_events": len(events), "mean": float(v.mean()) if len(v) else None}
        return out | ({"first_change": events[0][0], "first_magnitude": events[0][1], "last_change": events[-1][0]} if events else {})

    return kernel


CODED = "n_events int, mean double, first_change double, first_magnitude double, last_change double"
