"""World coordinates of images, from the public FITS papers: TAN with SIP, and -TAB tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def _sip(h: dict, which: str) -> list[tuple[int, int, float]]:
    n = int(h.get(f"{which}_ORDER", 0) or 0)
    return [(p, q, float(h[f"{which}_{p}_{q}"])) for p in range(n + 1) for q in range(n + 1 - p) if f"{which}_{p}_{q}" in h]


def _poly(terms, u, v):
    out = np.zeros(np.broadcast(u, v).shape)
    for p, q, c in terms:
        out = out + c * u**p * v**q
    return out


@dataclass
class Celestial:
    """Gnomonic projection (TAN) with optional SIP distortion; pixels count from 0."""

    crpix: np.ndarray
    crval: np.ndarray
    cd: np.ndarray
    a: list
    b: list

    @classmethod
    def of(cls, h: dict) -> Celestial:
        if "CD1_1" in h or "CD1_2" in h:
            cd = np.array([[float(h.get(f"CD{i}_{j}", 0)) for j in (1, 2)] for i in (1, 2)])
        else:
            pc = np.array([[float(h.get(f"PC{i}_{j}", i == j)) for j in (1, 2)] for i in (1, 2)])
            cd = np.diag([float(h.get("CDELT1", 1)), float(h.get("CDELT2", 1))]) @ pc
        get = lambda k, d=0.0: float(h.get(k, d))
        return cls(np.array([get("CRPIX1"), get("CRPIX2")]), np.array([get("CRVAL1"), get("CRVAL2")]), cd, _sip(h, "A"), _sip(h, "B"))

    def to_world(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.asarray(x, float) + 1 - self.crpix[0], np.asarray(y, float) + 1 - self.crpix[1]
        u, v = u + _poly(self.a, u, v), v + _poly(self.b, u, v)
        xi, eta = np.radians(self.cd[0, 0] * u + self.cd[0, 1] * v), np.radians(self.cd[1, 0] * u + self.cd[1, 1] * v)
        a0, d0 = np.radians(self.crval)
        den = math.cos(d0) - eta * math.sin(d0)
        ra = a0 + np.arctan2(xi, den)
        dec = np.arctan2(math.sin(d0) + eta * math.cos(d0), np.hypot(xi, den))
        return np.degrees(ra) % 360, np.degrees(dec)

    def to_pixel(self, ra, dec) -> tuple[np.ndarray, np.ndarray]:
        """Pixel of a position; NaN on the far half of the sphere. SIP is inverted by iteration."""
        a, d = np.radians(np.asarray(ra, float)), np.radians(np.asarray(dec, float))
        a0, d0 = np.radians(self.crval)
        cos = np.sin(d) * math.sin(d0) + np.cos(d) * math.cos(d0) * np.cos(a - a0)
        with np.errstate(all="ignore"):
            xi = np.degrees(np.cos(d) * np.sin(a - a0) / cos)
            eta = np.degrees((np.sin(d) * math.cos(d0) - np.cos(d) * math.sin(d0) * np.cos(a - a0)) / cos)
        xi, eta = np.where(cos > 0, xi, np.nan), np.where(cos > 0, eta, np.nan)
        inv = np.linalg.inv(self.cd)
        f, g = inv[0, 0] * xi + inv[0, 1] * eta, inv[1, 0] * xi + inv[1, 1] * eta
        u, v = f, g
        if self.a or self.b:
            for _ in range(50):
                un, vn = f - _poly(self.a, u, v), g - _poly(self.b, u, v)
                done = np.max(np.nan_to_num(np.hypot(un - u, vn - v)), initial=0.0) < 1e-10
                u, v = un, vn
                if done:
                    break
        return u + self.crpix[0] - 1, v + self.crpix[1] - 1

    def pixel_scale(self) -> float:
        """Arc seconds per pixel: root of the product of the two axes' scales."""
        return math.sqrt(float(np.prod(np.sqrt((self.cd**2).sum(axis=0))))) * 3600


@dataclass
class Spectral:
    """Wavelength and bandwidth over the detector, from a look-up table (-TAB)."""

    x: np.ndarray
    y: np.ndarray
    values: np.ndarray  # (y, x, 2)
    scale: tuple[float, float, float, float, float, float]

    @classmethod
    def of(cls, h: dict, tables: dict[str, dict], alt: str = "W") -> Spectral | None:
        name = str(h.get(f"PS1_0{alt}", "")).strip().upper()
        t = tables.get(name)
        if t is None:
            return None
        col = lambda k: np.asarray(t[str(h[k]).strip()])[0]
        x = col(f"PS1_2{alt}").astype(float).ravel()
        y = col(f"PS2_2{alt}").astype(float).ravel()
        values = np.asarray(col(f"PS1_1{alt}"), float).reshape(len(y), len(x), 2)
        get = lambda k, d: float(h.get(k, d))
        return cls(x, y, values, (get(f"CRPIX1{alt}", 0), get(f"CDELT1{alt}", 1), get(f"CRVAL1{alt}", 0), get(f"CRPIX2{alt}", 0), get(f"CDELT2{alt}", 1), get(f"CRVAL2{alt}", 0)))

    def at(self, x: float, y: float) -> tuple[float, float]:
        """Bilinear in the table; NaN outside (half a pixel beyond its ends still counts)."""
        p1, d1, v1, p2, d2, v2 = self.scale
        px, py = v1 + d1 * (x + 1 - p1), v2 + d2 * (y + 1 - p2)
        if not (self.x[0] - 0.5 <= px <= self.x[-1] + 0.5 and self.y[0] - 0.5 <= py <= self.y[-1] + 0.5):
            return math.nan, math.nan
        i, j = (int(np.clip(np.searchsorted(a, p) - 1, 0, len(a) - 2)) for a, p in ((self.x, px), (self.y, py)))
        fx, fy = (px - self.x[i]) / (self.x[i + 1] - self.x[i]), (py - self.y[j]) / (self.y[j + 1] - self.y[j])
        v = self.values
        top = v[j, i] * (1 - fx) + v[j, i + 1] * fx
        low = v[j + 1, i] * (1 - fx) + v[j + 1, i + 1] * fx
        w, b = top * (1 - fy) + low * fy
        return float(w), float(b)
