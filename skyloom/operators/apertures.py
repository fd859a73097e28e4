"""Exact circle-pixel overlaps, radial profiles and the FWHM of a point-spread function (numpy)."""

from __future__ import annotations

import math

import numpy as np


def overlap(dx: np.ndarray, dy: np.ndarray, radius: float | np.ndarray) -> np.ndarray:
    """Area of the unit pixels centred at (dx, dy) inside circles around the origin.

    The overlap's height over x is integrated in closed form between the places where
    the circle meets the pixel's upper and lower edge. Arguments broadcast.
    """
    dx, dy, radius = np.broadcast_arrays(np.asarray(dx, float), np.asarray(dy, float), np.asarray(radius, float))
    out = np.zeros(dx.shape)
    far, near = np.hypot(np.abs(dx) + 0.5, np.abs(dy) + 0.5), np.hypot(np.maximum(np.abs(dx) - 0.5, 0), np.maximum(np.abs(dy) - 0.5, 0))
    out[far <= radius] = 1.0
    edge = (far > radius) & (near < radius) & (radius > 0)
    r, x0, x1, y0, y1 = radius[edge], dx[edge] - 0.5, dx[edge] + 0.5, dy[edge] - 0.5, dy[edge] + 0.5
    if not len(x0):
        return out
    r2 = r * r
    cuts = [x0, x1, -r, r]
    for y in (y0, y1):
        c = np.sqrt(np.maximum(r2 - y * y, 0))
        cuts += [-c, c]
    at = np.sort(np.clip(np.stack(cuts), x0, x1), axis=0)

    def half_circle(x):
        x = np.clip(x, -r, r)
        return (x * np.sqrt(np.maximum(r2 - x * x, 0)) + r2 * np.arcsin(np.clip(x / r, -1, 1))) / 2

    total = np.zeros_like(x0)
    for a, b in zip(at[:-1], at[1:]):
        m = (a + b) / 2
        s = np.sqrt(np.maximum(r2 - m * m, 0))
        arc = half_circle(b) - half_circle(a)
        top = np.where(y1 < s, y1 * (b - a), arc)
        bottom = np.where(y0 > -s, y0 * (b - a), -arc)
        some = (np.abs(m) < r) & (np.minimum(y1, s) > np.maximum(y0, -s))
        total += np.where(some, top - bottom, 0.0)
    out[edge] = total
    return out


def aperture_sum(image: np.ndarray, variance: np.ndarray, x: float, y: float, radius: float) -> tuple[float, float]:
    """Σ w·image and √Σ w·variance with exact weights; NaN inside the circle carries over."""
    ny, nx = image.shape
    y0, y1 = max(0, math.floor(y - radius - 1)), min(ny, math.ceil(y + radius + 2))
    x0, x1 = max(0, math.floor(x - radius - 1)), min(nx, math.ceil(x + radius + 2))
    yy, xx = np.mgrid[y0:y1, x0:x1]
    w = overlap(xx - x, yy - y, radius)
    on = w > 0
    return float((w[on] * image[y0:y1, x0:x1][on]).sum()), float(np.sqrt((w[on] * variance[y0:y1, x0:x1][on]).sum()))


def radial_profile(psf: np.ndarray, edges: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Mid radii and mean values of rings around the largest pixel."""
    h, w = psf.shape
    py, px = np.unravel_index(int(np.argmax(psf)), psf.shape)
    yy, xx = np.mgrid[0:h, 0:w]
    dx, dy, v = (xx - px).ravel().astype(float), (yy - py).ravel().astype(float), psf.ravel()
    r = np.linspace(0, min(h, w) / 2, edges)
    far, near = np.hypot(np.abs(dx) + 0.5, np.abs(dy) + 0.5), np.hypot(np.maximum(np.abs(dx) - 0.5, 0), np.maximum(np.abs(dy) - 0.5, 0))
    # Pixels wholly inside a circle are sums along the order of their far corners ...
    order = np.argsort(far)
    whole = np.searchsorted(far[order], r, "right")
    sums, areas = np.r_[0.0, np.cumsum(v[order])][whole], whole.astype(float)
    # ... and each of the others meets a run of neighbouring circles.
    lo, hi = np.searchsorted(r, near, "right"), np.searchsorted(r, far, "left")
    n = np.maximum(hi - lo, 0)
    pixel = np.repeat(np.arange(len(v)), n)
    circle = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    o = overlap(dx[pixel], dy[pixel], r[circle])
    sums, areas = sums + np.bincount(circle, o * v[pixel], edges), areas + np.bincount(circle, o, edges)
    area = np.diff(areas)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (r[1:] + r[:-1]) / 2, np.where(area > 0, np.diff(sums) / area, np.nan)


def fwhm(psf: np.ndarray) -> float:
    """Full width at half maximum in PSF pixels; NaN if the profile never falls to half.

    Quadratic interpolation through the three profile points around the first crossing,
    linear where that has no root between them. Tolerance: a tenth of the ring width.
    """
    r, p = radial_profile(psf)
    ok = np.isfinite(p)
    r, p = r[ok], p[ok]
    if not len(p):
        return math.nan
    top = int(np.argmax(p))
    half = p[top] / 2
    below = np.flatnonzero(p[top:] <= half)
    if not len(below) or below[0] == 0:
        return math.nan
    k = top + int(below[0])
    a, b = r[k - 1], r[k]
    root = a + (p[k - 1] - half) * (b - a) / (p[k - 1] - p[k])
    if k + 1 < len(p):
        c = np.polyfit(r[k - 1 : k + 2] - a, p[k - 1 : k + 2] - half, 2)
        for z in np.roots(c):
            if abs(z.imag) < 1e-12 and 0 <= z.real <= b - a:
                root = a + z.real
    return 2 * float(root)
