"""Queries over the whole table leave no usable reading out, however large."""

import math

import pytest

import __spark_entry__ as entry

SCHEMA = "meas_id long, source_id long, obs_id string, band string, flux double, flux_error double, mag_ab double, snr double, wavelength double"


@pytest.fixture(scope="module")
def tail(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tail"))
    rows = [(4, 1, "a", "D1", 2e7, 1.0, 23.9 - 2.5 * math.log10(2e7), 2e7, 9.0), (8, 1, "b", "D1", 0.5, 1.0, 23.9 - 2.5 * math.log10(0.5), -3000.0, 0.1)]
    rows += [(12, 1, "c", "D1", 50.0, 5.0, 23.9 - 2.5 * math.log10(50.0), 10.0, 1.0), (16, 1, "d", "D1", None, -1.0, None, math.inf, None), (20, 1, "e", "D1", None, -1.0, None, 7.0, math.nan)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(d + "/lightcurve.parquet")
    return d


def run(spark, name, d):
    return entry.queries()[name](spark, d).collect()


def test_describe(spark, tail):
    (r,) = run(spark, "describe_snr_all", tail)
    assert (r["n"], r["min"], r["max"]) == (4, -3000.0, 2e7)


def test_histograms(spark, tail):
    assert sum(r["count"] for r in run(spark, "histogram20_snr_all", tail)) == 3
    assert sum(r["count"] for r in run(spark, "histogram20_wavelength_all", tail)) == 3


def test_compare(spark, tail):
    (r,) = run(spark, "compare_curves_all", tail)
    assert r["n"] == 3 and abs(r["mean_diff"]) < 1e-3


def test_convert(spark, tail):
    got = {r["meas_id"]: r["converted"] for r in run(spark, "unit_convert_all", tail)}
    assert got == {4: 2e7, 8: -3000.0, 12: 10.0, 16: math.inf, 20: 7.0}
