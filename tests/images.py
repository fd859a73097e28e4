"""Synthetic image files with a source of known flux."""

import numpy as np

from skyloom.sources import fits

SCALE = 6.2 / 3600


def psf_cube(zones=4, side=41, sigma=6.0):
    yy, xx = np.mgrid[0:side, 0:side] - side // 2
    g = np.exp(-(xx**2 + yy**2) / (2 * sigma**2))
    return np.repeat((g / g.sum())[None], zones, axis=0).astype("f4")


def mef(flux=100.0, sky=0.5, zodi=0.2, n=60, at=(30.0, 29.0), sigma=0.6, obs="2026A_1", detector=3, broken_variance=False, noise=0.0, seed=0):
    """An image in MJy/sr; ``flux`` is the star's sum over pixels."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:n, 0:n].astype(float)
    star = np.exp(-((xx - at[0]) ** 2 + (yy - at[1]) ** 2) / (2 * sigma**2))
    model = zodi * (1 + 0.01 * yy)
    image = sky + flux * star / star.sum() + model + noise * rng.standard_normal((n, n))
    flags = np.zeros((n, n), "i4")
    flags[int(at[1]), int(at[0])] = 1 << 21
    flags[5, 5] = 1 << 10
    variance = np.full((n, n), 0.01)
    variance[5, 5] = np.nan
    if broken_variance:
        variance[8, 8] = np.nan
    x, y = np.array([1.0, n]), np.array([1.0, n])
    table = np.zeros((1, 2, 2, 2))
    table[0, :, :, 0] = [[1.0, 2.0], [3.0, 4.0]]
    table[0, :, :, 1] = 0.05
    head = {
        "EXTNAME": "IMAGE", "BUNIT": "MJy/sr", "OBSID": obs, "DETECTOR": detector, "MJD-BEG": 61000.0, "MJD-END": 61000.5,
        "CTYPE1": "RA---TAN-SIP", "CTYPE2": "DEC--TAN-SIP", "CRPIX1": n / 2, "CRPIX2": n / 2, "CRVAL1": 150.0, "CRVAL2": 20.0, "CD1_1": -SCALE, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": SCALE,
        "A_ORDER": 2, "A_2_0": 1e-5, "B_ORDER": 2, "B_0_2": -1e-5,
        "PS1_0W": "WCS-WAVE", "PS1_1W": "VALUES", "PS1_2W": "X", "PS2_0W": "WCS-WAVE", "PS2_1W": "VALUES", "PS2_2W": "Y",
    }
    zones = {f"{a}CTR_{i + 1}": float(v) for i, (cx, cy) in enumerate(((10, 10), (50, 10), (10, 50), (50, 50))) for a, v in (("X", cx), ("Y", cy))}
    return fits.write(
        [
            fits.Hdu(),
            fits.Hdu(head, image.astype("f4")),
            fits.Hdu({"EXTNAME": "FLAGS"}, flags),
            fits.Hdu({"EXTNAME": "VARIANCE"}, variance.astype("f4")),
            fits.Hdu({"EXTNAME": "ZODI"}, model.astype("f4")),
            fits.Hdu({"EXTNAME": "PSF", "OVERSAMP": 10} | zones, psf_cube()),
            fits.Hdu({"EXTNAME": "WCS-WAVE"}, {"X": x[None], "Y": y[None], "VALUES": table}),
        ]
    )
