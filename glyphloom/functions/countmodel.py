"""Numerics of count models on small tables, vectorised over genes: dispersion fits, kernel smoothing, bandwidths, densities.

Matrices are genes x cells. Everything here works on a bounded sample or on one row per gene; the plans that call it are in operators.sct.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
LN10 = math.log(10.0)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln gamma for x > 0: recurrence up to 16, then the asymptotic series."""
    x = np.asarray(x, np.float64).copy()
    out = np.zeros_like(x)
    while (low := x < 16).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64).copy()
    out = np.zeros_like(x)
    while (low := x < 16).any():
        out[low] += 1 / (x[low] * x[low])
        x[low] += 1
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def theta_ml(y: np.ndarray, mu: np.ndarray, steps: int = 9, eps: float = 2.0**-13) -> np.ndarray:
    """Dispersion of each row by maximum likelihood: Newton steps from the moment estimate, as long as a row moves by more than eps."""
    with np.errstate(all="ignore"):
        theta = y.shape[1] / ((y / mu - 1) ** 2).sum(1)
        live = np.ones(len(y), bool)
        for _ in range(steps):
            at = np.flatnonzero(live)
            if not len(at):
                break
            t, a, m = np.abs(theta[at])[:, None], y[at], mu[at]
            score = (digamma(t + a) - digamma(t) + np.log(t) + 1 - np.log(t + m) - (t + a) / (t + m)).sum(1)
            info = (trigamma(t) - trigamma(t + a) - 1 / t + 2 / (t + m) - (t + a) / (t + m) ** 2).sum(1)
            step = score / info
            theta[at] = t[:, 0] + step
            live[at] = np.abs(step) > eps
    return np.maximum(theta, 0.0)


def poisson_fits(design: np.ndarray, y: np.ndarray, tol: float = 1e-9, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and fitted means of log-linear Poisson regressions, one for each row of y; rows that fail are NaN."""
    n, p = design.shape
    with np.errstate(all="ignore"):
        beta = np.zeros((len(y), p))
        constant = next((j for j in range(p) if np.ptp(design[:, j]) == 0), None)
        if constant is not None:
            beta[:, constant] = np.log(y.mean(1)) / design[0, constant]
        else:  # indicator columns, as of batches
            for j in range(p):
                if set(np.unique(design[:, j])) <= {0.0, 1.0}:
                    beta[:, j] = np.log(np.maximum(1e-9, y @ design[:, j] / design[:, j].sum()))
        live = np.ones(len(y), bool)
        for _ in range(steps):
            at = np.flatnonzero(live)
            if not len(at):
                break
            m = np.exp(np.clip(beta[at] @ design.T, -708, 709))
            gradient = (y[at] - m) @ design
            hessian = np.einsum("gc,ci,cj->gij", m, design, design)
            flat = ~np.isfinite(hessian).all((1, 2)) | ~np.isfinite(gradient).all(1)
            hessian[flat], gradient[flat] = np.eye(p), np.nan
            step = np.einsum("gij,gj->gi", np.linalg.pinv(hessian, hermitian=True), gradient)
            beta[at] += step
            live[at] = np.abs(step).sum(1) > tol
        return beta, np.exp(np.clip(beta @ design.T, -708, 709))


def offset_fits(offset: np.ndarray, y: np.ndarray, alpha: float = 1.0, tol: float = 1e-10, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and means of negative-binomial regressions (variance mu + alpha mu^2) on an offset, one for each row."""
    with np.errstate(all="ignore"):
        b = np.log(y.mean(1) / np.exp(offset).mean())
        for _ in range(steps):
            m = np.exp(b[:, None] + offset)
            step = ((y - m) / (1 + alpha * m)).sum(1) / (m / (1 + alpha * m)).sum(1)
            b = b + step
            if not (np.abs(step[np.isfinite(step)]) > tol).any():
                break
        return b, np.exp(b[:, None] + offset)


def negative_binomial_fit(design: np.ndarray, y: np.ndarray, theta: float, offset: np.ndarray | float = 0.0, tol: float = 1e-8, steps: int = 100) -> np.ndarray:
    """Coefficients of one regression with log link and known theta; NaN where it fails. theta may be infinite (Poisson)."""
    beta = np.zeros(design.shape[1])
    with np.errstate(all="ignore"):
        if np.isscalar(offset):
            beta = np.linalg.lstsq(design, np.log(y + 0.5), rcond=None)[0]
        for _ in range(steps):
            eta = np.clip(design @ beta + offset, -700, 700)
            m = np.exp(eta)
            w = m / (1 + m / theta)
            z = design @ beta + (y - m) / m
            a = design.T @ (design * w[:, None])
            if not np.isfinite(a).all():
                return np.full(design.shape[1], np.nan)
            new = np.linalg.pinv(a, hermitian=True) @ (design.T @ (w * z))
            done = np.abs(new - beta).sum() < tol
            beta = new
            if done:
                break
    return beta


def theta_of_fit(design: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Coefficients and theta of one negative-binomial regression, by turns."""
    theta, beta = math.inf, np.full(design.shape[1], np.nan)
    for _ in range(rounds):
        beta = negative_binomial_fit(design, y, theta)
        if not np.isfinite(beta).all():
            break
        mu = np.exp(design @ beta)
        new = float(theta_ml(y[None], mu[None])[0])
        new = new if math.isfinite(new) and 0 < new < 1e7 else math.inf
        if new == theta or abs(new - theta) < 1e-6 * max(1.0, abs(theta)):
            return beta, new
        theta = new
    return beta, theta


# Bandwidths and densities


def quartile_spread(x: np.ndarray) -> float:
    low, high = np.percentile(x, [25, 75])
    return float(high - low)


def bandwidth_nrd(x: np.ndarray) -> float:
    """The normal reference rule with factor 1.06."""
    spread = min(float(np.std(x, ddof=1)), quartile_spread(x) / 1.34)
    return 1.06 * (spread or float(np.std(x, ddof=1)) or abs(float(x[0])) or 1.0) * len(x) ** -0.2


def pair_distances(x: np.ndarray, bins: int = 1000) -> tuple[float, np.ndarray]:
    """Width of a bin, and for each distance in bins how many pairs are that far apart. A sign change makes a bin of its own, as bins count from zero."""
    width = max((x.max() - x.min()) * 1.01 / bins, EPS)
    cell = np.trunc(x / width).astype(np.int64)
    count = np.bincount(cell - cell.min(), minlength=bins)[: max(bins, int(np.ptp(cell)) + 1)].astype(np.float64)
    size = 1 << (2 * len(count) - 1).bit_length()
    spectrum = np.fft.rfft(count, size)
    pairs = np.rint(np.fft.irfft(spectrum * np.conj(spectrum), size)[: len(count)])
    pairs[0] = (count * (count - 1)).sum() / 2
    return width, pairs


def _functional(order: int, n: int, width: float, pairs: np.ndarray, h: float) -> float:
    """Estimates of the integrals of density derivatives that the Sheather-Jones rule needs (order 4 or 6)."""
    d = (np.arange(len(pairs)) * width / h) ** 2
    d, p = d[d < 1000], pairs[: (d < 1000).sum()]
    if order == 4:
        total = 2 * (np.exp(-d / 2) * (d * d - 6 * d + 3) * p).sum() + 3 * n
    else:
        total = 2 * (np.exp(-d / 2) * (d**3 - 15 * d * d + 45 * d - 15) * p).sum() - 15 * n
    return total / (n * (n - 1) * h ** (order + 1) * math.sqrt(2 * math.pi))


def bandwidth_sj(x: np.ndarray, bins: int = 1000) -> float:
    """The Sheather-Jones plug-in bandwidth (solve the equation); Silverman's rule where it has no root, 0.5 without spread."""
    x = np.asarray(x, np.float64)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 3 or np.ptp(x) <= 1e-8 * abs(x[0]):
        return 0.5
    width, pairs = pair_distances(x, bins)
    sd = float(np.std(x, ddof=1))
    scale = min(sd, quartile_spread(x) / 1.349)
    scale = scale if scale > 0 else max(sd, 1e-6)
    silverman = 0.9 * scale * n**-0.2
    rough, curve = -_functional(6, n, width, pairs, 1.23 * scale * n ** (-1 / 9)), _functional(4, n, width, pairs, 1.24 * scale * n ** (-1 / 7))
    if not (math.isfinite(rough) and rough > 0 and math.isfinite(curve) and curve > 0):
        return silverman
    factor, c1 = 1.357 * (curve / rough) ** (1 / 7), 1 / (2 * math.sqrt(math.pi) * n)

    def gap(h: float) -> float:
        inner = c1 / _functional(4, n, width, pairs, factor * h ** (5 / 7))
        return math.copysign(abs(inner) ** 0.2, inner) - h

    high = 1.144 * scale * n**-0.2
    low = 0.1 * high
    tol = 0.1 * low
    for turn in range(1, 99):
        if gap(low) * gap(high) <= 0:
            break
        low, high = (low, high * 1.2) if turn % 2 else (low / 1.2, high)
    else:
        return silverman
    up = gap(low)
    while high - low > tol / 64:
        middle = (low + high) / 2
        low, high = (middle, high) if gap(middle) * up > 0 else (low, middle)
    return (low + high) / 2


def density(x: np.ndarray, at: np.ndarray, bw: float | None = None, grid: int = 512, cut: float = 3.0, margin: float = 4.0) -> np.ndarray:
    """Gaussian kernel density at the points `at`: linear binning on twice the grid, convolution by FFT, linear interpolation, ends held."""
    bw = bw or bandwidth_nrd(x)
    grid = 1 << (max(512, grid) - 1).bit_length()
    low, high = x.min() - (cut + margin) * bw, x.max() + (cut + margin) * bw
    step = (high - low) / (grid - 1)
    place = (x - low) / step
    left = np.floor(place).astype(np.int64)
    share = place - left
    mass = np.bincount(left, (1 - share) / len(x), 2 * grid) + np.bincount(left + 1, share / len(x), 2 * grid)
    distance = np.arange(2 * grid)
    distance = np.minimum(distance, 2 * grid - distance) * step
    kernel = np.exp(-0.5 * (distance / bw) ** 2) / (bw * math.sqrt(2 * math.pi))
    smooth = np.maximum(np.fft.irfft(np.fft.rfft(mass) * np.fft.rfft(kernel), 2 * grid)[:grid], 0)
    points = np.linspace(x.min() - cut * bw, x.max() + cut * bw, grid)
    return np.interp(at, points, np.interp(points, low + step * np.arange(grid), smooth))


def smoothed(x: np.ndarray, y: np.ndarray, at: np.ndarray, bw: float, kernel: str = "normal") -> np.ndarray:
    """Kernel regression at the points `at`, in their order: a box of width bw, or a normal whose quartiles are at bw / 4, cut at 4 deviations; 0 where nothing is near."""
    keep = np.isfinite(x) & np.isfinite(y)
    order = np.argsort(x[keep], kind="stable")
    x, y = x[keep][order], y[keep][order]
    scale, reach = (bw * 0.3706506, 4 * bw * 0.3706506) if kernel == "normal" else (bw / 2, bw / 2)
    out = np.zeros(len(at))
    first, last = np.searchsorted(x, at - reach, "left"), np.searchsorted(x, at + reach, "right")
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if b > a:
            w = np.exp(-0.5 * ((x[a:b] - at[i]) / scale) ** 2) if kernel == "normal" else np.ones(b - a)
            total = w.sum()
            out[i] = (w @ y[a:b]) / total if total > 0 else 0.0
    return out


# Outliers


def mad(x: np.ndarray) -> float:
    return 1.4826 * float(np.median(np.abs(x - np.median(x))))


def robust_scale(x: np.ndarray) -> np.ndarray:
    return (x - np.median(x)) / (mad(x) + EPS)


def robust_scale_binned(y: np.ndarray, x: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """robust_scale within bins that are closed on the right; 0 outside of them."""
    cell = np.searchsorted(breaks, x, "left")
    out = np.zeros(len(y))
    for c in np.unique(cell[(cell > 0) & (cell < len(breaks))]):
        at = cell == c
        out[at] = robust_scale(y[at])
    return out


def outliers(y: np.ndarray, x: np.ndarray, limit: float = 10.0) -> np.ndarray:
    """Rows further than limit from their bin's median, in units of its spread, in both of two binnings that are half a bin apart."""
    none = np.zeros(len(y), bool)
    spread = float(np.ptp(x)) if len(x) else 0.0
    if (np.isfinite(x) & np.isfinite(y)).sum() < 3 or not math.isfinite(spread) or spread <= 10 * EPS:
        return none
    width = spread * bandwidth_sj(x) / 2
    first = x.min() - 10 * EPS
    scores = [np.abs(robust_scale_binned(y, x, np.arange(start, x.max() + width, width))) for start in (first, first - width / 2)]
    return np.minimum(*scores) > limit
