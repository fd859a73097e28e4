"""Multi-extension survey images: decoding, and photometry of many sources on many files.

One task reads one file at a time and measures all sources that were paired with it;
what leaves the task is a row per measurement.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import scalars as S
from skyloom.operators import apertures
from skyloom.operators.pixels import RELAXED, STRICT, annulus_plan
from skyloom.plans.config import PhotometryConfig
from skyloom.sources import fits
from skyloom.session import checkpointed
from skyloom.sources.wcs import Celestial, Spectral

PLANES = ("IMAGE", "FLAGS", "VARIANCE", "ZODI", "PSF")

MEASUREMENT = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("obs_id", T.StringType()),
        T.StructField("mjd", T.DoubleType()),
        T.StructField("flux", T.DoubleType(), metadata={"unit": "uJy"}),
        T.StructField("flux_error", T.DoubleType(), metadata={"unit": "uJy"}),
        T.StructField("wavelength", T.DoubleType(), metadata={"unit": "um"}),
        T.StructField("bandwidth", T.DoubleType(), metadata={"unit": "um"}),
        T.StructField("flag", T.LongType()),
        T.StructField("pix_x", T.DoubleType()),
        T.StructField("pix_y", T.DoubleType()),
        T.StructField("band", T.StringType()),
        T.StructField("mag_ab", T.DoubleType()),
        T.StructField("mag_ab_error", T.DoubleType()),
        T.StructField("problem", T.StringType()),
    ]
)


@lru_cache(maxsize=1024)
def _fwhm(psf: bytes, shape: tuple[int, int]) -> float:
    """FWHM by content: files of one detector have the same PSF cube."""
    return apertures.fwhm(np.frombuffer(psf, np.float64).reshape(shape))


@dataclass
class Mef:
    """A decoded file; planes in microjanskys per square arcsecond once converted."""

    image: np.ndarray
    flags: np.ndarray
    variance: np.ndarray
    zodi: np.ndarray
    psf: np.ndarray
    header: dict
    psf_header: dict
    celestial: Celestial
    spectral: Spectral | None
    obs_id: str
    detector: int
    mjd: float

    def calibrated(self, cfg: PhotometryConfig) -> tuple[np.ndarray, np.ndarray]:
        """Image without zodiacal light and repaired variance, computed once for all sources."""
        how = (cfg.subtract_zodi, cfg.zodi_scale_min, cfg.zodi_scale_max)
        if getattr(self, "_ready", (None,))[0] != how:
            variance, image = repaired_variance(self.variance, self.flags), self.image
            if cfg.subtract_zodi:
                image = image - zodi_scale(image, self.zodi, self.flags, variance, cfg.zodi_scale_min, cfg.zodi_scale_max) * self.zodi
            self._ready = how, image, variance
        return self._ready[1:]

    def psf_zones(self) -> dict[int, tuple[float, float]]:
        """zone -> centre (1-based) from the PSF header, in its order; incomplete pairs left out."""
        h = self.psf_header
        return {int(k[5:]): (float(v), float(h[f"YCTR_{k[5:]}"])) for k, v in h.items() if k.startswith("XCTR_") and k[5:].isdigit() and f"YCTR_{k[5:]}" in h}

    def zone_at(self, x: float, y: float) -> int | None:
        """The nearest zone; the first in the header of equally near ones."""
        h = self.header
        if "CRPIX1A" in h and "CRPIX2A" in h:  # a cutout: back to detector pixels
            x, y = x + 1 - float(h["CRPIX1A"]), y + 1 - float(h["CRPIX2A"])
        else:
            x, y = x + 1, y + 1
        best, least = None, math.inf
        for zone, (cx, cy) in self.psf_zones().items():
            d = math.hypot(cx - x, cy - y)
            if d < least:
                best, least = zone, d
        return best

    def fwhm_arcsec(self, x: float, y: float) -> float:
        zone = self.zone_at(x, y)
        if zone is None or not 1 <= zone <= len(self.psf):
            return math.nan
        psf = np.ascontiguousarray(self.psf[zone - 1], np.float64)
        return _fwhm(psf.tobytes(), psf.shape) * self.celestial.pixel_scale() / float(self.psf_header.get("OVERSAMP", 10))


def decode(raw: bytes, path: str = "", unit: str | None = "uJy/arcsec2") -> Mef:
    """A file's planes, headers and coordinates. ValueError unless it has 7 units and all planes."""
    hdus = fits.read(raw)
    if len(hdus) < 7:
        raise ValueError(f"{len(hdus)} header-data units, at least 7 expected")
    by = {h.name: h for h in hdus}
    missing = [p for p in PLANES if p not in by or by[p].data is None]
    if missing:
        raise ValueError("missing: " + ", ".join(missing))
    h = by["IMAGE"].header | {k: v for k, v in hdus[0].header.items() if k in ("OBSID", "DETECTOR", "MJD-BEG", "MJD-END") and k not in by["IMAGE"].header}
    factor = 1.0
    if unit is not None:
        units = {k.lower(): f for k, f in S.UNIT_FACTORS.items()}
        factor = units[unit.lower()] / units.get(str(h.get("BUNIT", "MJy/sr")).replace(" ", "").lower(), 1.0)
    tables = {x.name: x.data for x in hdus if isinstance(x.data, dict)}
    f8 = lambda p: np.asarray(by[p].data, float)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return Mef(
        f8("IMAGE") * factor,
        np.asarray(by["FLAGS"].data).astype(np.int64),
        f8("VARIANCE") * factor * factor,
        f8("ZODI") * factor,
        np.asarray(by["PSF"].data),
        h,
        by["PSF"].header,
        Celestial.of(h),
        Spectral.of(h, tables),
        str(h.get("OBSID") or stem),
        int(h.get("DETECTOR") or 0),
        (float(h.get("MJD-BEG", math.nan)) + float(h.get("MJD-END", math.nan))) / 2,
    )


def repaired_variance(variance: np.ndarray, flags: np.ndarray) -> np.ndarray:
    nan = np.isnan(variance)
    if not nan.any():
        return variance
    if (nan & (flags == 0)).any():
        raise ValueError("variance is NaN where no flag is set")
    valid = ~nan & (variance > 0)
    if not valid.any():
        raise ValueError("no valid variance")
    return np.where(nan, np.median(variance[valid]), variance)


def zodi_scale(image, zodi, flags, variance, least=0.0, most=10.0, good=0.5) -> float:
    ok = (flags & STRICT) == 0
    if ok.mean() < good:
        return 1.0
    ok &= zodi != 0
    i, z, v = image[ok], zodi[ok], variance[ok]
    w = v > 0
    if w.any():
        i, z, w = i[w], z[w], 1 / v[w]
    else:
        w = np.ones_like(i)
    den = float((w * z * z).sum())
    s = float((w * i * z).sum()) / den if den else 1.0
    return 1.0 if s <= least or s > most else s


def clipped(values: np.ndarray, sigma: float, rounds: int) -> tuple[float, float]:
    """Median and population deviation of what survives clipping about the median."""
    v = values[np.isfinite(values)]
    for _ in range(rounds):
        m, s = np.median(v), v.std()
        keep = (v >= m - sigma * s) & (v <= m + sigma * s)
        if keep.all():
            break
        v = v[keep]
    return (float(np.median(v)), float(v.std())) if len(v) else (0.0, 0.0)


def background(image, flags, x, y, radius, cfg: PhotometryConfig) -> tuple[float, float, int]:
    """Level and error per pixel and the number of pixels; zeros without enough of them."""
    ny, nx = image.shape
    if cfg.background_method == "window":
        h, w = cfg.window_size if not isinstance(cfg.window_size, int) else (cfg.window_size,) * 2
        y0, y1, x0, x1 = (int(v) for v in (max(0, math.floor(y - h / 2)), min(ny, math.ceil(y + h / 2)), max(0, math.floor(x - w / 2)), min(nx, math.ceil(x + w / 2))))
        yy, xx = np.mgrid[y0:y1, x0:x1]
        box, f = image[y0:y1, x0:x1], flags[y0:y1, x0:x1]
        outside = np.hypot(xx - x, yy - y) > radius + 0.707
        use = outside & ((f & STRICT) == 0)
        if use.sum() < cfg.min_usable_pixels:
            use = outside & ((f & RELAXED) == 0)
            if use.sum() < cfg.min_usable_pixels:
                return 0.0, 0.0, 0
    else:
        inner, tried = annulus_plan(x, y, radius, nx, ny, least=cfg.min_usable_pixels, most=cfg.max_outer_radius, offset=cfg.annulus_inner_offset, attempts=cfg.max_annulus_attempts, step=cfg.annulus_expansion_step)
        far = tried[-1] + 1  # only the ring's surroundings are looked at
        y0, y1, x0, x1 = max(0, math.floor(y - far)), min(ny, math.ceil(y + far) + 1), max(0, math.floor(x - far)), min(nx, math.ceil(x + far) + 1)
        yy, xx = np.mgrid[y0:y1, x0:x1]
        box, f, d = image[y0:y1, x0:x1], flags[y0:y1, x0:x1], np.hypot(xx - x, yy - y)
        for k, outer in enumerate(tried):
            ring = (d >= inner) & (d <= outer)
            use = ring & ((f & STRICT) == 0)
            if use.sum() >= cfg.min_usable_pixels:
                break
            if k == cfg.max_annulus_attempts - 1:
                use = ring & ((f & RELAXED) == 0)
    n = int(use.sum())
    if n == 0:
        return 0.0, 0.0, 0
    level, sd = clipped(box[use], cfg.bg_sigma_clip_sigma, cfg.bg_sigma_clip_maxiters)
    return level, sd / math.sqrt(n), n


# The flag of pixels that a partial cutout fills: one that neither mask lets through.
MISSING = S.flag_mask((S.FLAG_BITS["MISSING_DATA"],))
OUTSIDE = "near or outside the edge"


def measure(mef: Mef, ra: float, dec: float, cfg: PhotometryConfig) -> dict:
    """One source on one decoded file. A ``problem`` says why there is no usable flux."""
    x, y = (float(v) for v in mef.celestial.to_pixel(ra, dec))
    return measure_at(mef, x, y, cfg)


def measure_all(mef: Mef, ra: np.ndarray, dec: np.ndarray, cfg: PhotometryConfig, outside: bool = True):
    """(index, measurement) of sources on one file; those surely off it only if ``outside``."""
    x, y = mef.celestial.to_pixel(ra, dec)
    ny, nx = mef.image.shape
    with np.errstate(invalid="ignore"):
        on = (x >= 0) & (x < nx) & (y >= 0) & (y < ny)
    for i in range(len(x)) if outside else np.flatnonzero(on):
        yield int(i), measure_at(mef, float(x[i]), float(y[i]), cfg)


def measure_at(mef: Mef, x: float, y: float, cfg: PhotometryConfig) -> dict:
    """``measure`` at a pixel position."""
    out: dict = {"obs_id": mef.obs_id, "mjd": mef.mjd, "band": f"D{mef.detector}" if 1 <= mef.detector <= 6 else "Unknown"}
    try:
        image, variance = mef.calibrated(cfg)
        out |= {"pix_x": x, "pix_y": y}
        ny, nx = mef.image.shape
        scale = mef.celestial.pixel_scale() or cfg.pixel_scale_fallback
        radius = cfg.aperture_diameter / 2
        if cfg.aperture_method == "fwhm" and math.isfinite(x) and math.isfinite(y):
            width = mef.fwhm_arcsec(x, y)
            if math.isfinite(width) and width > 0:
                radius = width / scale * cfg.fwhm_multiplier / 2
        edge = max(radius, cfg.max_outer_radius)
        if not (edge <= x < nx - edge and edge <= y < ny - edge):
            return out | {"problem": OUTSIDE}
        wavelength, bandwidth = mef.spectral.at(x, y) if mef.spectral else (math.nan, math.nan)
        out |= {"wavelength": wavelength, "bandwidth": bandwidth}
        level, error, n = background(image, mef.flags, x, y, radius, cfg)
        if n == 0:
            return out | {"problem": "no background pixels"}
        raw, raw_error = apertures.aperture_sum(image, variance, x, y, radius)
        area = math.pi * radius * radius
        flux, flux_error = (raw - level * area) * scale**2, math.hypot(raw_error, error * area) * scale**2
        y0, y1, x0, x1 = max(0, math.floor(y - radius)), min(ny, math.ceil(y + radius) + 1), max(0, math.floor(x - radius)), min(nx, math.ceil(x + radius) + 1)
        yy, xx = np.mgrid[y0:y1, x0:x1]
        inside = (xx - x) ** 2 + (yy - y) ** 2 <= radius * radius
        out |= {"flux": flux, "flux_error": flux_error, "flag": int(np.bitwise_or.reduce(mef.flags[y0:y1, x0:x1][inside], initial=0))}
        if not flux > 0:
            return out | {"problem": "flux is not positive"}
        return out | {"mag_ab": 23.9 - 2.5 * math.log10(flux), "mag_ab_error": 2.5 / math.log(10) * flux_error / flux}
    except ValueError as e:
        return out | {"problem": str(e)}


def read_files(spark: SparkSession, directory: str, pattern: str = "*.fits") -> DataFrame:
    """path, content of the image files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory).select("path", "content")


def list_files(spark: SparkSession, directory: str, pattern: str = "*.fits") -> DataFrame:
    """path, length of the files below a folder, by path, without reading them; empty if it is missing."""
    from skyloom.session import hadoop

    fs, at = hadoop(spark, directory)
    if not fs.exists(at):
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory).select("path", "length").orderBy("path")


def footprints(files: DataFrame) -> DataFrame:
    """path, poly (its four corners, half a degree wider) of each readable file (path, content)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                try:
                    m = decode(b.column(1)[i].as_py(), b.column(0)[i].as_py())
                except (ValueError, KeyError):
                    continue
                ny, nx = m.image.shape
                pad = 0.5 * 3600 / (m.celestial.pixel_scale() or 1.0)
                ra, dec = m.celestial.to_world(np.array([-pad, nx + pad, nx + pad, -pad]), np.array([-pad, -pad, ny + pad, ny + pad]))
                yield pa.RecordBatch.from_pylist([{"path": b.column(0)[i].as_py(), "poly": [{"ra": float(x), "dec": float(y)} for x, y in zip(ra, dec)]}], schema=pa.schema([("path", pa.string()), ("poly", pa.list_(pa.struct([("ra", pa.float64()), ("dec", pa.float64())])))]))

    return files.select("path", "content").mapInArrow(run, "path string, poly array<struct<ra:double,dec:double>>")


def photometry(files: DataFrame, sources: DataFrame, cfg: PhotometryConfig | None = None, *, keep_problems: bool = False, together: int = 10_000) -> DataFrame:
    """``MEASUREMENT`` rows of every source on every file (path, content).

    ``sources`` needs source_id, ra, dec. Up to ``together`` of them (counted) go along with
    each file's task. More are paired with the files whose footprints hold them
    (``archive.spatial_join``) and reach a file in portions of about ``together``, each of which
    reads the file again. A file is calibrated once for all sources of a portion. Files that
    can't be read, and measurements with a problem, are dropped unless ``keep_problems``; of
    paired sources those off the frame aren't listed. Null positions are left out.
    """
    cfg = cfg or PhotometryConfig()
    how = asdict(cfg)
    placed = sources.where("ra IS NOT NULL AND dec IS NOT NULL").select("source_id", F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"))
    wanted = placed.limit(together + 1).collect()
    given = None if len(wanted) > together else tuple(np.array([r[c] for r in wanted], t) for c, t in (("source_id", object), ("ra", float), ("dec", float)))

    def run(batches):
        import pyarrow as pa

        c = PhotometryConfig(**how)
        kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
        for b in batches:
            for i in range(b.num_rows):  # files are large: one at a time
                path = b.column(0)[i].as_py()
                ids, ra, dec = given or tuple(np.array([s[k] for s in b.column(2)[i].as_py()], t) for k, t in (("source_id", object), ("ra", float), ("dec", float)))
                try:
                    m = decode(b.column(1)[i].as_py(), path)
                    rows = [{"source_id": ids[k], "path": path} | r for k, r in measure_all(m, ra, dec, c, keep_problems and given is not None)]
                except (ValueError, KeyError) as e:
                    rows = [{"path": path, "problem": f"unreadable: {e}"}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], kinds[f.dataType]) for f in MEASUREMENT.fields], names=MEASUREMENT.names)

    todo = files.select("path", "content")
    if given is None:
        from skyloom.operators.archive import spatial_join

        pairs = checkpointed(spatial_join(placed, footprints(todo)).drop("poly"))
        portions = pairs.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("n"))
        lists = pairs.join(portions, "path").groupBy("path", F.pmod(F.xxhash64("source_id", "ra", "dec"), F.col("n")).alias("part")).agg(F.collect_list(F.struct("source_id", "ra", "dec")).alias("s"))
        todo = todo.join(lists, "path").select("path", "content", "s")
    m = todo.mapInArrow(run, MEASUREMENT)
    return m if keep_problems else m.where(F.col("problem").isNull())


def cutout(mef: Mef, x: float, y: float, size: int | tuple[int, int], mode: str = "trim") -> Mef:
    """A part of a file around a pixel with its coordinates moved along; the PSF stays whole.

    mode: ``trim`` keeps what lies on the image, ``strict`` raises ValueError if part
    of the box doesn't, ``partial`` fills that with NaN and sets the flag ``MISSING`` there.
    """
    h, w = (size, size) if isinstance(size, int) else size
    ny, nx = mef.image.shape
    top, left = math.ceil(y - h / 2), math.ceil(x - w / 2)
    y0, y1, x0, x1 = max(top, 0), min(top + h, ny), max(left, 0), min(left + w, nx)
    if y0 >= y1 or x0 >= x1:
        raise ValueError("the box doesn't meet the image")
    if mode == "strict" and (y1 - y0, x1 - x0) != (h, w):
        raise ValueError("the box leaves the image")

    def part(a, fill):
        if mode != "partial":
            return a[y0:y1, x0:x1]
        out = np.full((h, w), fill, a.dtype)
        out[y0 - top : y1 - top, x0 - left : x1 - left] = a[y0:y1, x0:x1]
        return out

    oy, ox = (top, left) if mode == "partial" else (y0, x0)
    c = mef.celestial
    spectral = mef.spectral
    if spectral:
        p1, d1, v1, p2, d2, v2 = spectral.scale
        spectral = Spectral(spectral.x, spectral.y, spectral.values, (p1 - ox, d1, v1, p2 - oy, d2, v2))
    header = mef.header | {"CRPIX1A": float(mef.header.get("CRPIX1A", 0.0)) - ox, "CRPIX2A": float(mef.header.get("CRPIX2A", 0.0)) - oy}
    return Mef(part(mef.image, np.nan), part(mef.flags, MISSING), part(mef.variance, np.nan), part(mef.zodi, np.nan), mef.psf, header, mef.psf_header, Celestial(c.crpix - [ox, oy], c.crval, c.cd, c.a, c.b), spectral, mef.obs_id, mef.detector, mef.mjd)
