from skyloom.sources import mef
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.functions import scalars as S
from skyloom.operators import apertures
from skyloom.plans.config import PhotometryConfig
from skyloom.sources import fits, mef
from tests import images


@settings(max_examples=60, deadline=None)
@given(st.floats(-3, 3), st.floats(-3, 3), st.floats(0.05, 4))
def test_overlap_against_sampling(dx, dy, r):
    g = (np.arange(200) + 0.5) / 200 - 0.5
    brute = ((dx + g[:, None]) ** 2 + (dy + g[None, :]) ** 2 <= r * r).mean()
    assert abs(apertures.overlap(dx, dy, r) - brute) < 0.006


@pytest.mark.parametrize("r", [0.3, 1.0, 2.5, 7.3])
def test_overlap_adds_up_to_the_circle(r):
    yy, xx = np.mgrid[-10:11, -10:11]
    assert apertures.overlap(xx + 0.2, yy - 0.4, r).sum() == pytest.approx(math.pi * r * r, rel=1e-12)
    assert apertures.overlap(0.0, 0.0, 0.0) == 0


def test_fwhm_of_a_gaussian():
    assert apertures.fwhm(images.psf_cube()[0].astype(float)) == pytest.approx(2.3548 * 6.0, rel=0.01)


def test_fits_round_trip():
    hdus = [
        fits.Hdu({"NOTE": "it's", "FLAG": True, "N": -3, "X": 1.5e-7}),
        *[fits.Hdu({"EXTNAME": k}, np.arange(12).reshape(3, 4).astype(k)) for k in ("u1", "i2", "i4", "i8", "f4", "f8")],
        fits.Hdu({"EXTNAME": "T"}, {"A": np.arange(3, dtype="i4"), "B": np.arange(12.0).reshape(3, 2, 2)}),
    ]
    back = fits.read(fits.write(hdus))
    assert (back[0].header["NOTE"], back[0].header["FLAG"], back[0].header["N"], back[0].header["X"]) == ("it's", True, -3, 1.5e-7)
    for a, b in zip(hdus[1:7], back[1:7]):
        assert b.data.dtype == a.data.dtype and (b.data == a.data).all()
    assert (back[7].data["A"] == [0, 1, 2]).all() and (back[7].data["B"] == hdus[7].data["B"]).all()


def test_scaled_and_blank_images():
    raw = fits.write([fits.Hdu({"BSCALE": 2.0, "BZERO": 10.0, "BLANK": 7}, np.array([[1, 7]], "i2"))])
    v = fits.read(raw)[0].data
    assert v[0, 0] == 12 and math.isnan(v[0, 1])
    assert fits.read(fits.write([fits.Hdu({"BZERO": 32768}, np.array([[-32768, 32767]], "i2"))]))[0].data.tolist() == [[0, 65535]]
    with pytest.raises(ValueError):
        fits.read(raw[:2882])


def test_world_coordinates_round_trip():
    c = mef.decode(images.mef()).celestial
    x, y = np.meshgrid(np.linspace(0, 59, 7), np.linspace(0, 59, 5))
    ra, dec = c.to_world(x, y)
    bx, by = c.to_pixel(ra, dec)
    assert np.abs(bx - x).max() < 1e-8 and np.abs(by - y).max() < 1e-8
    assert c.to_world(29.0, 29.0) == (pytest.approx(150.0), pytest.approx(20.0))
    assert c.pixel_scale() == pytest.approx(6.2)
    assert math.isnan(c.to_pixel(330.0, -20.0)[0])


def test_wavelength_table():
    s = mef.decode(images.mef()).spectral
    assert s.at(0, 0) == (pytest.approx(1.0), pytest.approx(0.05))
    assert s.at(59, 59)[0] == pytest.approx(4.0) and s.at(29.5, 29.5)[0] == pytest.approx(2.5)
    assert math.isnan(s.at(-5, 0)[0])


@pytest.mark.parametrize("method", ["annulus", "window"])
def test_known_flux(method):
    m = mef.decode(images.mef(flux=100.0))
    ra, dec = m.celestial.to_world(30.0, 29.0)
    cfg = PhotometryConfig(aperture_method="fixed", aperture_diameter=6.0, background_method=method, window_size=20)
    r = mef.measure(m, float(ra), float(dec), cfg)
    assert "problem" not in r
    assert r["flux"] == pytest.approx(100.0 * S.UJY_ARCSEC2 * 6.2**2, rel=0.01)
    assert (r["band"], r["mjd"], r["obs_id"]) == ("D3", 61000.25, "2026A_1") and r["flag"] & (1 << 21)
    assert r["mag_ab"] == pytest.approx(23.9 - 2.5 * math.log10(r["flux"]))
    assert 1 < r["wavelength"] < 4


def test_problems_are_named():
    m = mef.decode(images.mef(flux=-50.0))
    ra, dec = (float(v) for v in m.celestial.to_world(30.0, 29.0))
    cfg = PhotometryConfig(aperture_method="fixed")
    assert "not positive" in mef.measure(m, ra, dec, cfg)["problem"]
    assert "edge" in mef.measure(m, *(float(v) for v in m.celestial.to_world(2.0, 29.0)), cfg)["problem"]
    assert "variance" in mef.measure(mef.decode(images.mef(broken_variance=True)), ra, dec, cfg)["problem"]
    # An inner radius beyond the largest outer one leaves an empty ring.
    assert "background" in mef.measure(mef.decode(images.mef()), ra, dec, PhotometryConfig(aperture_method="fixed", aperture_diameter=7.4))["problem"]
    with pytest.raises(ValueError):
        mef.decode(fits.write([fits.Hdu()]))


def test_zones_and_fwhm_radius():
    m = mef.decode(images.mef())
    assert m.zone_at(9, 9) == 1 and m.zone_at(48, 48) == 4
    assert m.zone_at(29, 29) == 1  # all equally near: the first in the header
    assert m.fwhm_arcsec(30, 29) == pytest.approx(2.3548 * 6 * 0.62, rel=0.01)


def test_cutouts_keep_the_sky():
    m = mef.decode(images.mef())
    c = mef.cutout(m, 30.0, 29.0, (20, 24))
    assert c.image.shape == (20, 24)
    ra, dec = m.celestial.to_world(30.0, 29.0)
    x, y = c.celestial.to_pixel(ra, dec)
    assert (x, y) == (pytest.approx(12.0), pytest.approx(10.0))
    assert c.spectral.at(12, 10) == (pytest.approx(m.spectral.at(30, 29)[0]), pytest.approx(0.05))
    assert c.zone_at(0, 0) == m.zone_at(18, 19)
    assert mef.cutout(m, 2.0, 2.0, 10).image.shape == (7, 7)
    assert np.isnan(mef.cutout(m, 2.0, 2.0, 10, "partial").image).sum() == 100 - 49
    with pytest.raises(ValueError):
        mef.cutout(m, 2.0, 2.0, 10, "strict")


def test_files_to_measurements(spark, tmp_path):
    (tmp_path / "D3").mkdir()
    for i in range(3):
        (tmp_path / "D3" / f"o{i}.fits").write_bytes(images.mef(obs=f"o{i}", flux=50.0 * (i + 1)))
    (tmp_path / "D3" / "bad.fits").write_bytes(b"nothing")
    ra, dec = (float(v) for v in mef.decode(images.mef()).celestial.to_world(30.0, 29.0))
    sources = spark.createDataFrame([(1, ra, dec), (2, ra + 90, dec), (3, None, dec)], "source_id long, ra double, dec double")
    files = mef.read_files(spark, str(tmp_path))
    got = mef.photometry(files, sources).orderBy("obs_id").collect()
    assert [(r["source_id"], r["obs_id"]) for r in got] == [(1, "o0"), (1, "o1"), (1, "o2")]
    assert got[2]["flux"] == pytest.approx(3 * got[0]["flux"], rel=0.02)
    every = mef.photometry(files, sources, keep_problems=True).collect()
    assert len(every) == 7 and sum("unreadable" in (r["problem"] or "") for r in every) == 1
    assert mef.list_files(spark, str(tmp_path)).count() == 4 and mef.list_files(spark, str(tmp_path / "none")).count() == 0


def test_many_sources_on_a_large_frame_are_fast():
    """What a file needs is done once, and sources off the frame cost next to nothing."""
    import time

    small = mef.decode(images.mef())
    n = 2040
    rng = np.random.default_rng(0)
    big = mef.Mef(1 + rng.random((n, n)), np.zeros((n, n), np.int64), np.full((n, n), 0.01), np.full((n, n), 0.5), small.psf, small.header, small.psf_header, small.celestial, small.spectral, "o", 3, 61000.0)
    x, y = rng.uniform(100, n - 100, 1000), rng.uniform(100, n - 100, 1000)
    ra, dec = big.celestial.to_world(x, y)
    far = np.r_[ra, rng.uniform(0, 360, 50_000)], np.r_[dec, rng.uniform(-90, -30, 50_000)]
    t = time.perf_counter()
    got = dict(mef.measure_all(big, *far, PhotometryConfig(), outside=False))
    assert time.perf_counter() - t < 20 and set(range(1000)) <= set(got)
    assert sum("flux" in r for r in got.values()) >= 1000


def test_partial_cutouts_can_be_measured():
    m = mef.decode(images.mef())
    part = mef.cutout(m, 30.0, 29.0, 2 * max(m.image.shape), "partial")
    assert np.isnan(part.image).any() and (part.flags[np.isnan(part.variance)] != 0).all()
    ra, dec = (float(v) for v in m.celestial.to_world(30.0, 29.0))
    got = mef.measure(part, ra, dec, PhotometryConfig(subtract_zodi=False))
    assert "problem" not in got and got["flux"] == pytest.approx(mef.measure(m, ra, dec, PhotometryConfig(subtract_zodi=False))["flux"], rel=1e-6)


def test_paired_sources_equal_those_sent_along(spark):
    ra, dec = (float(v) for v in mef.decode(images.mef()).celestial.to_world(30.0, 29.0))
    sources = spark.createDataFrame([(i, ra + 1e-5 * i, dec) for i in range(12)] + [(99, (ra + 180) % 360, -dec), (100, None, dec)], "source_id long, ra double, dec double")
    files = spark.createDataFrame([(f"f{i}.fits", images.mef(obs=f"o{i}")) for i in range(2)] + [("bad.fits", b"x")], "path string, content binary")
    a, b = (sorted(map(tuple, mef.photometry(files, sources, together=k).drop("problem").collect()), key=repr) for k in (1000, 5))
    assert len(a) == 24 and a == b
