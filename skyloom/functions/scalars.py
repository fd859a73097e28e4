"""Scalar functions of the photometry domain as Column expressions.

Comparisons follow IEEE rules: NaN is neither greater nor smaller than anything
(Spark on its own takes NaN as the greatest value).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the pixel flag map, and those that make a measurement bad.
FLAG_BITS = {
    "TRANSIENT": 0,
    "OVERFLOW": 1,
    "SUR_ERROR": 2,
    "NONFUNC": 6,
    "DICHROIC": 7,
    "MISSING_DATA": 9,
    "HOT": 10,
    "COLD": 11,
    "FULLSAMPLE": 12,
    "PHANMISS": 14,
    "NONLINEAR": 15,
    "PERSIST": 17,
    "OUTLIER": 19,
    "SOURCE": 21,
}
BAD_FLAGS = (0, 1, 2, 6, 7, 9, 10, 11, 14, 15, 17, 19)
BANDS = ("D1", "D2", "D3", "D4", "D5", "D6")
# The archive's address and the prefix of its bandpass names.
ARCHIVE = "https://irsa.ipac.caltech.edu/"
BANDPASS = "SPHEREx-"
FULL_IMAGE_MB, LEAST_IMAGE_MB, IMAGE_SIDE, PIXEL_ARCSEC = 71.6, 5.0, 2040, 6.2
# MJy/sr to microjansky per square arcsecond.
UJY_ARCSEC2 = 1e12 / (180 * 3600 / math.pi) ** 2
UNIT_FACTORS = {"MJy/sr": 1.0, "uJy/arcsec2": UJY_ARCSEC2, "Jy/arcsec2": UJY_ARCSEC2 / 1e6, "MJy/arcsec2": UJY_ARCSEC2 / 1e12}


def greater(a: Column, b: Column) -> Column:
    """a > b, false where a is NaN (b NaN is never below anything)."""
    return (a > b) & ~F.isnan(a)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


# -- text ------------------------------------------------------------------
def archive_url(uri: Column, base: str = ARCHIVE) -> Column:
    return F.concat(F.lit(base), uri)


def obs_id_of(publisher_id: Column) -> Column:
    """What stands between ``?`` and the next slash; null without it."""
    return F.nullif(F.regexp_extract(publisher_id, r"\?([^/]+)", 1), F.lit(""))


def band_of(bandpass: Column) -> Column:
    """Text after the last hyphen, all of it without one."""
    return F.element_at(F.split(bandpass, "-"), -1)


def output_path(directory: Column | str, band: Column, obs_id: Column) -> Column:
    d = F.lit(directory) if isinstance(directory, str) else directory
    return F.concat(d, F.lit("/"), band, F.lit("/"), obs_id, F.lit(".fits"))


def source_label(ra: Column, dec: Column, name: Column | None = None, style: str = "file") -> Column:
    """The name, or one made of the position (``file`` and ``title`` style differ)."""
    made = F.format_string("source_%.4f_%.4f" if style == "file" else "RA%.4f_Dec%.4f", ra, dec)
    return made if name is None else F.coalesce(F.nullif(name, F.lit("")), made)


def human_size(n: Column) -> Column:
    """Bytes as ``1.5 MB``: divided by 1024 until below 1024, up to PB."""
    out = None
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB", "PB")))):
        text = F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / F.lit(1024.0**k), 1))
        out = text if out is None else F.when(n.cast("double") / F.lit(1024.0**k) < 1024, text).otherwise(out)
    return out


def detector_band(detector: Column) -> Column:
    return F.when(detector.between(1, 6), F.concat(F.lit("D"), detector.cast("string"))).otherwise("Unknown")


# -- cutouts ---------------------------------------------------------------
_SIZE = r"^\d+\.?\d*(,\d+\.?\d*)?(px|pix|pixels|arcsec|arcmin|deg|rad)?$"
_CENTER = r"^-?\d+\.?\d*,-?\d+\.?\d*(px|pix|pixels|arcsec|arcmin|deg|rad)?$"
_NUMBER = r"-?\d+\.?\d*"


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))


def valid_cutout_size(size: Column) -> Column:
    """One or two positive numbers with an optional unit; null is not valid."""
    s = F.trim(size)
    return F.coalesce(s.rlike(_SIZE) & F.forall(_numbers(s), lambda x: x > 0), F.lit(False))


def valid_cutout_center(center: Column) -> Column:
    """Two signed numbers with an optional unit; unless in pixels the second lies in ±90."""
    s = F.trim(center)
    ok = s.rlike(_CENTER)
    second = F.try_element_at(_numbers(s), F.lit(2))
    return F.coalesce(ok & (s.contains("px") | s.contains("pix") | second.between(-90, 90)), F.lit(False))


def cutout_parameters(size: Column, center: Column, ra: Column, dec: Column) -> Column:
    """URL parameters of a server-side cutout, empty without a size; the center
    defaults to the source's position."""
    at = F.coalesce(F.nullif(center, F.lit("")), F.concat(ra.cast("string"), F.lit(","), dec.cast("string")))
    return F.when(size.isNull() | (size == ""), F.lit("")).otherwise(F.concat(F.lit("?center="), at, F.lit("&size="), size))


def cutout_megabytes(size: Column) -> Column:
    """Expected file size of a cutout; the full image's where there is no valid size."""
    s = F.trim(F.lower(size))
    per = (
        F.when(s.contains("arcsec"), 1 / F.lit(PIXEL_ARCSEC))
        .when(s.contains("arcmin"), 60 / F.lit(PIXEL_ARCSEC))
        .when(s.contains("deg"), 3600 / F.lit(PIXEL_ARCSEC))
        .when(s.contains("rad"), 206265 / F.lit(PIXEL_ARCSEC))
        .when(s.contains("px") | s.contains("pix"), F.lit(1.0))
        .otherwise(3600 / F.lit(PIXEL_ARCSEC))
    )
    n = _numbers(s)
    a = F.try_element_at(n, F.lit(1)) * per
    b = F.coalesce(F.try_element_at(n, F.lit(2)) * per, a)
    return F.when(valid_cutout_size(s), F.greatest(F.lit(FULL_IMAGE_MB) * (a * b / F.lit(float(IMAGE_SIDE**2))), F.lit(LEAST_IMAGE_MB))).otherwise(F.lit(FULL_IMAGE_MB))


# -- flux and magnitude ----------------------------------------------------
def snr(flux: Column, error: Column) -> Column:
    """flux / error where the error is positive, else 0."""
    return F.when(greater(error, F.lit(0.0)), F.try_divide(flux, error)).otherwise(F.when(flux.isNotNull(), F.lit(0.0)))


def is_upper_limit(flux: Column, error: Column) -> Column:
    return greater(error, flux)


def ab_magnitude(flux: Column) -> Column:
    """AB magnitude of microjanskys; null unless the flux is positive and finite."""
    return F.when(finite(flux) & (flux > 0), 23.9 - 2.5 * F.log10(flux))


def ab_magnitude_error(flux: Column, error: Column) -> Column:
    return F.when(finite(flux) & (flux > 0) & finite(error), F.lit(2.5 / math.log(10)) * error / flux)


def magnitude_to_jansky(mag: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(-0.4) * (mag + F.lit(48.6))) * F.lit(1e23)


def magnitude_to_jansky_error(mag: Column, error: Column) -> Column:
    return F.lit(0.4 * math.log(10)) * magnitude_to_jansky(mag) * error


def unit_factor(unit: Column) -> Column:
    """Factor from MJy/sr to a surface-brightness unit, of which case and blanks don't
    count; null for others. Variances scale with its square."""
    u = F.lower(F.regexp_replace(unit, r"\s+", ""))
    out = F.lit(None).cast("double")
    for name, f in UNIT_FACTORS.items():
        out = F.when(u == name.lower(), F.lit(f)).otherwise(out)
    return out


def pixel_area_flux(total: Column, scale_arcsec: Column) -> Column:
    """Microjanskys of a sum over pixels in microjanskys per square arcsecond."""
    return total * scale_arcsec * scale_arcsec


# -- flags -----------------------------------------------------------------
def flag_mask(bits: tuple[int, ...] = BAD_FLAGS) -> int:
    out = 0
    for b in bits:
        out |= 1 << b
    return out


def has_flag(flag: Column, mask: int) -> Column:
    return flag.cast("long").bitwiseAND(F.lit(mask).cast("long")) != 0


def flag_binary(flag: Column, width: int = 22) -> Column:
    """Binary digits, zero-padded to ``width`` and never cut; the sign of negatives first."""
    b = F.bin(F.abs(flag.cast("long")))
    digits = F.when(flag < 0, width - 1).otherwise(width)
    pad = F.when(F.length(b) >= digits, b).otherwise(F.concat(F.repeat(F.lit("0"), (digits - F.length(b)).cast("int")), b))
    return F.concat(F.when(flag < 0, "-").otherwise(""), pad)


def decoded_flags(flag: Column) -> dict[str, Column]:
    return {name: has_flag(flag, 1 << b) for name, b in FLAG_BITS.items()}


def set_bits(flag: Column) -> Column:
    """The bits of 0 to 31 that are set, as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftright", flag.cast("long"), b).bitwiseAND(F.lit(1).cast("long")) == 1)


# -- geometry --------------------------------------------------------------
def annulus_radii(aperture: Column, pixels: int = 10, most: float = 5.0, offset: float = 1.414) -> tuple[Column, Column]:
    inner = aperture + F.lit(offset)
    return inner, F.least(F.sqrt(F.lit(pixels / math.pi) + inner * inner), F.lit(most))


def aperture_radius(fwhm: Column, scale: Column, multiplier: float = 2.5, diameter: float = 3.0) -> Column:
    """Half of ``multiplier`` times the FWHM in pixels; half the fixed diameter without one."""
    return F.coalesce(F.when(finite(fwhm) & (fwhm > 0) & (scale > 0), F.try_divide(fwhm, scale) * (multiplier / 2)), F.lit(diameter / 2))


def inside_margin(x: Column, y: Column, nx: Column, ny: Column, aperture: Column, most: float = 5.0) -> Column:
    m = F.greatest(aperture, F.lit(most))
    return (x >= m) & (x < nx - m) & (y >= m) & (y < ny - m)


def mjd_to_timestamp(mjd: Column) -> Column:
    return F.timestamp_micros(((mjd - 40587) * 86_400_000_000).cast("long"))


def tangent_pixel(ra: Column, dec: Column, ra0: float, dec0: float, scale_arcsec: float, crpix: tuple[float, float]) -> tuple[Column, Column]:
    """0-based pixel of a position in a plain gnomonic frame (x against right ascension);
    null on the far half of the sphere."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), math.radians(dec0)
    cos = F.sin(d) * math.sin(d0) + F.cos(d) * math.cos(d0) * F.cos(a)
    xi = F.when(cos > 0, F.degrees(F.cos(d) * F.sin(a) / cos))
    eta = F.when(cos > 0, F.degrees((F.sin(d) * math.cos(d0) - F.cos(d) * math.sin(d0) * F.cos(a)) / cos))
    step = scale_arcsec / 3600
    return xi / F.lit(-step) + (crpix[0] - 1), eta / F.lit(step) + (crpix[1] - 1)
