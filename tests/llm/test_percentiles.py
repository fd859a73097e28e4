import math

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import percentiles as P
from skyloom.llm import queries

A = 0.005


def frame(spark, rows):
    return spark.createDataFrame(rows, "source_id long, band string, x double, day int, bucket int, n int, quantity string")


def test_within_the_bound_of_exact_ranks(spark):
    rng = np.random.default_rng(0)
    v = {"D1": np.exp(rng.normal(0, 30, 4001)) * rng.choice([-1, 1], 4001), "D2": np.r_[np.zeros(50), rng.normal(0, 1, 51)], None: np.array([7.0]), "D3": np.full(99, -3.5)}
    rows = [(1, b, float(x), i % 5, 1, 2, "q") for b, xs in v.items() for i, x in enumerate(xs)]
    rows += [(1, "D1", bad, 0, 1, 2, "q") for bad in (None, math.nan, math.inf, -math.inf)] + [(1, "D9", None, 0, 1, 2, "q")]
    df = frame(spark, rows)
    got = {r["band"]: r for r in P.percentiles(P.sketch(df, {"x": "x"}, ["band"], A), ["band"], A).collect()}
    assert set(got) == set(v)
    for b, xs in v.items():
        assert got[b]["n"] == len(xs)
        for q in P.QUANTILES:
            exact = np.sort(xs)[int(math.floor(q * (len(xs) - 1)))]
            assert abs(got[b][P.name(q)] - exact) <= A * abs(exact) + 1e-300


def test_parts_add_up(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(int(s), str(b), float(x), int(d), 1, 2, "q") for s, b, x, d in zip(rng.integers(0, 3, 900), rng.integers(0, 2, 900), rng.normal(0, 1e3, 900), rng.integers(0, 4, 900))])
    whole = P.sketch(df, {"x": "x"}, ["band"], A)
    days = [P.sketch(df.where(F.col("day") == k), {"x": "x"}, ["source_id", "band"], A) for k in range(4)]
    rows = lambda s: sorted(map(tuple, s.select("band", "quantity", "bucket", "n").collect()))
    assert rows(P.merge(*days, groups=["band"])) == rows(whole)
    assert rows(P.merge(P.merge(*days[:2], groups=["band"]), P.merge(*days[2:], groups=["band"]), groups=["band"])) == rows(whole)


def test_empty_and_names(spark):
    assert P.percentiles(P.sketch(frame(spark, []), {"x": "x"}, ["band"]), ["band"]).count() == 0
    assert [P.name(q) for q in (0.01, 0.5, 0.999, 0.0)] == ["p01", "p50", "p99_9", "p00"]


def test_query_levels(spark, data):
    rows = queries.p1_percentiles(spark, data).collect()
    lc = spark.read.parquet(f"{data}/lightcurve.parquet").select("source_id", "band", "flux").toPandas()
    lc = lc[np.isfinite(lc.flux)]
    assert {r["level"] for r in rows} == {"band", "source", "source_band"}
    for r in rows:
        if r["quantity"] == "flux":
            x = lc[(lc.band == r["band"]) if r["band"] else lc.band.notna()]
            x = np.sort(x[x.source_id == r["source_id"]].flux if r["source_id"] is not None else x.flux)
            assert r["n"] == len(x)
            exact = x[int(math.floor(0.5 * (len(x) - 1)))]
            assert abs(r["p50"] - exact) <= r["error_bound"] * abs(exact)
