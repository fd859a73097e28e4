import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalars as S
from skyloom.functions.logbuckets import bucket, representative
from skyloom.operators import archive, clip, lightcurves, pixels, selection
from skyloom.plans import adapters
from skyloom.plans.config import PhotometryConfig
from skyloom.sources import mef


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    "flux, err, snr, limit",
    [(10.0, 2.0, 5.0, False), (1.0, 0.0, 0.0, False), (1.0, -1.0, 0.0, False), (1.0, math.nan, 0.0, False), (2.0, 2.0, 1.0, False), (1.0, 2.0, 0.5, True), (0.0, 1.0, 0.0, True), (-3.0, 1.0, -3.0, True)],
)
def test_snr_and_limits(spark, flux, err, snr, limit):
    assert one(spark, S.snr(lit(flux), lit(err))) == snr and one(spark, S.is_upper_limit(lit(flux), lit(err))) is limit


def test_magnitudes(spark):
    assert one(spark, S.ab_magnitude(lit(1.0))) == pytest.approx(23.9)
    for bad in (0.0, -1.0, math.nan, math.inf):
        assert one(spark, S.ab_magnitude(lit(bad))) is None
    jy = one(spark, S.magnitude_to_jansky(lit(23.9)))
    assert jy * 1e6 == pytest.approx(1.0, rel=0.01)
    assert one(spark, S.unit_factor(lit(" ujy / ARCSEC2 "))) == pytest.approx(23.504, rel=1e-4)


@pytest.mark.parametrize("flag, text", [(0, "0" * 22), (5, "0" * 19 + "101"), (1 << 21, "1" + "0" * 21), (1 << 25, "1" + "0" * 25), (-1, "-" + "0" * 20 + "1")])
def test_flag_binary(spark, flag, text):
    assert one(spark, S.flag_binary(lit(flag))) == text


def test_flags(spark):
    assert S.flag_mask() == 708295 and S.flag_mask((0, 2, 4)) == 21 and S.flag_mask(()) == 0
    assert one(spark, S.set_bits(lit(2097157))) == [0, 2, 21]
    assert one(spark, S.has_flag(lit(2097152), 708295)) is False


@pytest.mark.parametrize("text, ok, mb", [("200px", True, 5.0), ("0.1", True, 5.0), ("100,200px", True, 5.0), ("3arcmin", True, 5.0), ("0px", False, 71.6), ("-1px", False, 71.6), ("5000px", True, 71.6 * (5000 / 2040) ** 2), ("abc", False, 71.6), (None, False, 71.6)])
def test_cutout_sizes(spark, text, ok, mb):
    assert one(spark, S.valid_cutout_size(F.lit(text).cast("string"))) is ok
    assert one(spark, S.cutout_megabytes(F.lit(text).cast("string"))) == pytest.approx(mb)


@pytest.mark.parametrize("text, ok", [("70,20", True), ("300.5,120px", True), ("10,95", False), ("10", False), ("10,-90deg", True)])
def test_cutout_centers(spark, text, ok):
    assert one(spark, S.valid_cutout_center(lit(text))) is ok


def test_small_text_functions(spark):
    assert one(spark, S.obs_id_of(lit("ivo://x/y?2026A_1/D3"))) == "2026A_1" and one(spark, S.obs_id_of(lit("none"))) is None
    assert one(spark, S.band_of(lit("x-D3"))) == "D3" and one(spark, S.band_of(lit("D3"))) == "D3"
    assert one(spark, S.human_size(lit(1536))) == "1.5 KB" and one(spark, S.human_size(lit(2**60))) == "1024.0 PB"
    assert one(spark, S.detector_band(lit(7))) == "Unknown"
    assert str(one(spark, S.mjd_to_timestamp(lit(40587.5)))) == "1970-01-01 12:00:00"


def test_log_buckets(spark):
    rng = np.random.default_rng(0)
    v = np.r_[np.exp(rng.uniform(-700, 700, 500)) * rng.choice([-1, 1], 500), 0.0, 5e-324, 1.7e308, -1.0, 1.0]
    df = spark.createDataFrame([(float(x),) for x in v], "x double").select("x", bucket(F.col("x"), 0.01).alias("b")).withColumn("r", representative(F.col("b"), 0.01))
    rows = sorted(df.collect(), key=lambda r: r["x"])
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)
    for r in rows:
        if abs(r["x"]) > 1e-300:
            assert abs(r["r"] - r["x"]) <= 0.01 * abs(r["x"])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 10, 501), "b": np.r_[np.zeros(400), rng.normal(5, 1, 100)], "c": np.array([3.0]), None: np.exp(rng.normal(0, 20, 77))}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("a", math.nan), ("d", math.inf)]
    got = {r["g"]: r for r in selection.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"q0": 0.0, "q2": 0.5, "q9": 0.9}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k]["n"] == len(v)
        for name, q in (("q0", 0), ("q2", 0.5), ("q9", 0.9)):
            assert got[k][name] == pytest.approx(np.quantile(v, q), rel=1e-12)
    assert selection.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"m": 0.5}).count() == 0
    assert selection.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), [], "x", {"m": 0.5}).first()["n"] == 501 + 500 + 1 + 77


def numpy_clip(v, sigma, rounds):
    keep = np.isfinite(v)
    for _ in range(rounds):
        m, s = np.median(v[keep]), v[keep].std()
        new = keep & (np.abs(v - m) <= sigma * s)
        if (new == keep).all():
            break
        keep = new
    return keep


@pytest.mark.parametrize("large", [10_000, 100])
def test_sigma_clip(spark, large):
    """By windows and, for groups over ``large``, by intervals: the same rows survive."""
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for g, n in (("a", 400), (None, 60), ("c", 1)):
        v = rng.standard_t(1.5, n)
        if n > 10:
            v[3] = np.nan
        keep = numpy_clip(v, 2.5, 10)
        rows += [(g, i, float(x)) for i, x in enumerate(v)]
        want |= {(g, i) for i in np.flatnonzero(keep)}
    got = clip.sigma_clip(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], "x", sigma=2.5, large=large)
    assert {(r["g"], r["i"]) for r in got.collect()} == want


def test_polygons(spark):
    box = [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0)]
    over_zero = [(355.0, -5.0), (5.0, -5.0), (5.0, 5.0), (355.0, 5.0)]
    cap = [(0.0, 80.0), (120.0, 80.0), (240.0, 80.0)]
    wide = [(10.0, 40.0), (110.0, 40.0), (110.0, 50.0), (10.0, 50.0)]
    points = [(1, 15.0, 15.0), (2, 25.0, 15.0), (3, 195.0, -15.0), (4, 0.0, 0.0), (5, 359.0, 4.0), (6, 77.0, 89.0), (7, 60.0, 55.0), (8, 60.0, 45.0), (9, None, 1.0), (10, 0.5, -4.9)]
    p = spark.createDataFrame(points, "source_id long, ra double, dec double")
    q = spark.createDataFrame([("box", box), ("zero", over_zero), ("cap", cap), ("wide", wide), ("line", box[:2])], "name string, poly array<struct<ra:double,dec:double>>")
    got = {(r["source_id"], r["name"]) for r in archive.spatial_join(p, q).select("source_id", "name").collect()}
    brute = {(r["source_id"], r["name"]) for r in p.crossJoin(q).where(archive.inside_polygon(F.col("ra"), F.col("dec"), F.col("poly"))).collect()}
    assert got == brute == {(1, "box"), (4, "zero"), (5, "zero"), (10, "zero"), (6, "cap"), (7, "wide")}
    plan = archive.spatial_join(p, q)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_classes(spark):
    rows = [(1, 100.0, 1.0, 0), (2, 100.0, 1.0, 1), (3, 1.0, 1.0, 0), (4, 1.0, 2.0, 0), (5, None, 1.0, 0), (6, 100.0, 1.0, None), (7, 100.0, 1.0, 1 << 21)]
    df = spark.createDataFrame(rows, "id int, flux double, flux_error double, flag int")
    got = {r["id"]: r["quality_class"] for r in lightcurves.classified(df).collect()}
    assert got == {1: "good_regular", 2: "rejected_regular", 3: "rejected_regular", 4: "rejected_upper_limits", 5: "rejected_regular", 6: "good_regular", 7: "good_regular"}
    low = {r["id"]: r["quality_class"] for r in lightcurves.classified(df, sigma=0.1, mask=0).collect()}
    assert low[4] == "good_upper_limits" and low[2] == "good_regular"


def test_limits_of_flat_and_empty(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("z", 0.0), ("n", math.nan)], "g string, y double")
    got = {r["g"]: (r["y_min"], r["y_max"]) for r in lightcurves.plot_limits(df, ["g"], "y").collect()}
    assert got == {"a": (pytest.approx(1.8), pytest.approx(2.2)), "z": (-0.1, 0.1), "n": (0.0, 1.0)}  # as surveyed for no values


@pytest.mark.parametrize("method", ["annulus", "window"])
@pytest.mark.parametrize("radius", [0.5, 1.0, 1.6])
def test_relational_background_equals_kernel(spark, data, method, radius):
    px = adapters.pixels(spark, data).cache()
    x, y = 3.5, 3.6
    if method == "window":
        got = pixels.window_background(px, x, y, radius, size=(7, 6))
    else:
        got = pixels.annulus_background(px, x, y, radius, nx=8, ny=8, least=20)
    got = {r["img"]: r for r in got.collect()}
    cfg = PhotometryConfig(background_method=method, window_size=(7, 6), min_usable_pixels=10 if method == "window" else 20)
    images = px.toPandas()
    for img, g in list(images.groupby("img"))[:60]:
        g = g.sort_values(["y", "x"])
        level, error, n = mef.background(g.image.to_numpy().reshape(8, 8), g["flags"].to_numpy().reshape(8, 8), x, y, radius, cfg)
        r = got.get(img)
        assert (r["background"], r["error"], r["n_usable"]) == (pytest.approx(level), pytest.approx(error), n)


def test_nearest_zone_ties(spark):
    z = spark.createDataFrame([(2, 1.0, 1.0), (1, 3.0, 1.0)], "zone_id int, xctr double, yctr double")
    p = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], "x double, y double")
    assert [r["zone_id"] for r in pixels.nearest_zone(p, z).orderBy("x").collect()] == [2, 1, 1]
    assert pixels.nearest_zone(p, z.limit(0)).where("zone_id IS NULL").count() == 3


def test_quantiles_of_full_buckets(spark):
    """Most values lie in one bucket or are one value: buckets are cut until they are small."""
    rng = np.random.default_rng(3)
    values = np.r_[1 + rng.random(3000) * 1e-9, np.full(2000, 5.0), rng.normal(0, 100, 500), [0.0, -0.0, 1e308, -1e308]]
    df = spark.createDataFrame([(k, float(x)) for k in (1, None) for x in values[: len(values) - 200 * (k or 0)]], "k long, v double")
    q = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    for most in (50, 10**6):
        got = {r["k"]: r for r in selection.exact_quantiles(df, ["k"], "v", q, most=most).collect()}
        for k in (1, None):
            x = values[: len(values) - 200 * (k or 0)]
            assert got[k]["n"] == len(x)
            for name, f in q.items():
                assert got[k][name] == pytest.approx(np.quantile(x, f), rel=1e-12, abs=1e-12)


def test_places_of_a_group_with_one_time(spark):
    """A group that is most of the table, half of it at one time and some rows repeated, is ordered over many ranges."""
    rows = [(1, "D1", f"o{i:04}", i, 61100.0) for i in range(2000)] + [(1, "D1", f"p{i:04}", i, None if i % 9 == 0 else 61041.0 + i) for i in range(600)] + [(2, None, "z", 1, float("nan"))] * 3
    df = spark.createDataFrame(rows, "source_id long, band string, obs_id string, meas_id long, mjd double").repartition(5)
    got = lightcurves.time_order(df, ["source_id", "band"]).collect()
    mine = sorted((r for r in got if r["source_id"] == 1), key=lambda r: (r["mjd"] is not None, r["mjd"] or 0, r["obs_id"], r["meas_id"]))
    assert [r["seq"] for r in mine] == list(range(1, 2601)) and sorted(r["seq"] for r in got if r["source_id"] == 2) == [1, 2, 3]


def test_footprints_over_right_ascension_zero(spark):
    """They are split into few cells, and polygons of more than four corners are tested as well."""
    boxes = [(0, [(355.0, -5.0), (5.0, -5.0), (5.0, 5.0), (355.0, 5.0)]), (1, [(350.0, 20.0), (0.0, 18.0), (10.0, 20.0), (12.0, 30.0), (0.0, 34.0), (349.0, 30.0)]), (2, [(10.0, 80.0), (130.0, 80.0), (250.0, 80.0)])]
    planes = spark.createDataFrame(boxes, "k long, poly array<struct<ra:double,dec:double>>")
    cells = {r["k"]: r["n"] for r in planes.select("k", F.size(archive.covering_cells(F.col("poly"), 5.0)).alias("n")).collect()}
    assert cells[0] <= 12 and cells[1] <= 30 and cells[2] == 72 * 36
    points = [(0, 359.0, 0.0), (1, 1.0, 4.0), (2, 6.0, 0.0), (3, 0.0, 33.0), (4, 355.0, 25.0), (5, 180.0, 0.0), (6, 300.0, 89.0), (7, 0.0, 40.0), (8, None, 1.0), (9, 361.0, 1.0)]
    got = {tuple(r) for r in archive.spatial_join(spark.createDataFrame(points, "p long, ra double, dec double"), planes).select("p", "k").collect()}
    assert got == {(0, 0), (1, 0), (9, 0), (3, 1), (4, 1), (6, 2)}


def test_limits_of_groups_without_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (2, float("nan")), (None, 0.0)], "k long, v double")
    got = {r["k"]: (r["y_min"], r["y_max"]) for r in lightcurves.plot_limits(df, ["k"], "v").collect()}
    assert got == {1: (4.5, 5.5), 2: (0.0, 1.0), None: (-0.1, 0.1)}


def _catalogue(spark, n_sources, n_planes, n_artifacts):
    sources = spark.range(n_sources).select(F.col("id").alias("source_id"), (F.col("id") * 0.001).alias("ra"), (F.col("id") * -0.002).alias("dec"))
    poly = F.expr("array(struct(355D AS ra, -5D AS dec), struct(5D AS ra, -5D AS dec), struct(5D AS ra, 5D AS dec), struct(355D AS ra, 5D AS dec))")
    did = F.concat(F.lit("ivo://x/qr?"), F.col("id").cast("string"), F.lit("/D1"))
    planes = spark.range(n_planes).select(F.col("id").alias("planeid"), did.alias("obs_publisher_did"), (F.col("id") % 7).cast("double").alias("time_bounds_lower"), F.lit(9.0).alias("time_bounds_upper"), F.lit("S-D1").alias("energy_bandpassname"), F.lit(1.0).alias("energy_bounds_lower"), F.lit(2.0).alias("energy_bounds_upper"), poly.alias("poly"))
    artifacts = spark.range(n_planes * n_artifacts).select((F.col("id") % n_planes).alias("planeid"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("uri"))
    return sources, artifacts, planes


def test_ordered_search_keeps_only_the_catalogue(spark):
    """Of 400 sources in 300 footprints of four artifacts, half a million rows, none are written or shuffled before the result."""
    from pathlib import Path

    from skyloom.session import local_path, shared_dir

    size = lambda: sum(p.stat().st_size for p in Path(local_path(shared_dir(spark))).rglob("*.parquet"))
    before = size()
    found = archive.search(*_catalogue(spark, 400, 300, 4), ordered=True)
    assert found.columns == ["source_id", "obs_id", "band", "mjd", "wavelength_min", "wavelength_max", "download_url", "t_min", "t_max", "seq"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and size() - before < 200_000
    got = found.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("d"), F.max("seq").alias("m")).collect()
    assert len(got) == 400 and {(r["n"], r["d"], r["m"]) for r in got} == {(1200, 1200, 1200)}


@pytest.mark.parametrize("sizes", [{}, {"rows": 40, "entries": 16, "lists": 100, "cells": 25_000}])
def test_ordered_search_of_odd_catalogues(spark, sizes):
    """Alike planes, one source twice, null ids, uris and times, many artifacts of a plane, footprints of three to six corners, around a pole or over 0."""
    from skyloom.operators import sightings

    box = lambda ra, dec, w=10.0: [(ra, dec), (ra + w, dec), (ra + w, dec + w), (ra, dec + w)]
    shapes = [box(355.0, -5.0), box(-5.0, -5.0), box(0.0, 0.0), [(10.0, 80.0), (130.0, 80.0), (250.0, 80.0)], [(350.0, 20.0), (0.0, 18.0), (10.0, 20.0), (12.0, 30.0), (0.0, 34.0), (349.0, 30.0)], box(100.0, 40.0, 30.0), [(1.0, 1.0), (2.0, 2.0)], None, [(0.0, 0.0), (None, 1.0), (3.0, 3.0)]]
    rows = [(i, None if i % 23 == 0 else float("nan") if i % 29 == 0 else float(i % 6), f"o{i % 40}" if i % 3 else f"u{i}", None if i % 31 == 0 else f"D{i % 2}", shapes[i % 9]) for i in range(180)]
    planes = spark.createDataFrame(rows, "planeid long, t_min double, obs_id string, band string, poly array<struct<ra:double,dec:double>>")
    files = [(i % 190, None if i % 41 == 0 else f"f{i * 7919 % 1000}") for i in range(700)] + [(4, f"g{i}") for i in range(3000)] + [(None, "x")]
    artifacts = spark.createDataFrame(files, "planeid long, uri string")
    places = [(k, (k * 37.3) % 360, (k * 11.7) % 180 - 90) for k in range(150)] + [(k, 358.0 + k % 5, k % 9 - 4.3) for k in range(200, 260)] + [(3, 1.0, 1.1), (3, 1.2, 1.1), (None, 2.0, 2.1), (None, 359.0, 1.0), (7, None, 1.0), (8, 361.3, 0.2), (9, 1.3, 88.0), (10, 110.0, 71.0)]
    sources = spark.createDataFrame(places, "source_id long, ra double, dec double")
    got = sightings.numbered(sources, planes, artifacts, ["band", "obs_id", "t_min"], **sizes).collect()
    hits = archive.spatial_join(sources, planes).join(artifacts, "planeid").select("source_id", "band", "obs_id", "t_min", "uri").collect()
    last = lambda v: (v is None, v != v, 0 if v is None or v != v else v)
    key = lambda r: tuple(last(r[c]) for c in ("t_min", "obs_id", "band", "uri"))
    want = {}
    for r in hits:
        want.setdefault(r["source_id"], []).append(key(r))
    mine = {}
    for r in sorted(got, key=lambda r: r["seq"]):
        mine.setdefault(r["source_id"], []).append((r["seq"], key(r)))
    assert len(got) == len(hits) > 10_000 and len(want[3]) > 400 and None in want
    assert mine == {k: list(enumerate(sorted(v), 1)) for k, v in want.items()}
