"""Searching the observation catalogue: by position, band and time; download book-keeping."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import scalars as S
from skyloom.operators import sightings


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    a, d = F.radians(ra), F.radians(dec)
    return [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]


def inside_polygon(ra: Column, dec: Column, poly: Column) -> Column:
    """Is a position inside a convex polygon on the sphere (array of struct ra, dec)?

    It is if it lies on the same side of the great circles through all edges, and on the
    polygon's half of the sphere; on an edge counts as inside. Null positions or polygons of under three corners give false.
    """
    p, q = _point(ra, dec), _edges(poly)
    return _inside(p, q)


def _point(ra: Column, dec: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(unit_vector(ra, dec), "xyz")])


def _edges(poly: Column) -> Column:
    """What the test needs of a polygon: number of corners, normals of its edges, sum of its corners."""
    cross = lambda a, b: F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))

    def edges(c: Column) -> Column:
        following = F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), F.slice(c, 1, 1))
        total = lambda n: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v[n]).alias(n)
        return F.struct(F.size(c).alias("n"), F.zip_with(c, following, cross).alias("normals"), *[total(n) for n in "xyz"])

    return _let(F.transform(poly, lambda v: _point(v["ra"], v["dec"])), edges)


def _inside(p: Column, q: Column) -> Column:
    """The first four edges are tested by plain expressions, which compile; only further ones in a lambda."""
    dot = lambda v: v["x"] * p["x"] + v["y"] * p["y"] + v["z"] * p["z"]
    towards = (q["n"] >= 3) & (dot(q) > 0)
    sides = [dot(F.get(q["normals"], F.lit(k))) for k in range(4)]
    every = lambda f: (q["n"] <= 4) | F.forall(q["normals"], f)
    left, right = F.lit(True), F.lit(True)
    for x in sides:
        left, right = left & F.coalesce(x >= 0, F.lit(True)), right & F.coalesce(x <= 0, F.lit(True))
    return F.coalesce(p["x"].isNotNull() & p["z"].isNotNull() & towards & ((left & every(lambda v: dot(v) >= 0)) | (right & every(lambda v: dot(v) <= 0))), F.lit(False))


def _cell(ra: Column, dec: Column, size: float) -> Column:
    return F.struct(F.floor(F.pmod(ra, F.lit(360.0)) / size).cast("int").alias("i"), F.floor((dec + 90) / size).cast("int").alias("j"))


def covering_cells(poly: Column, size: float) -> Column:
    """Cells of a ra/dec grid that a polygon can touch: its bounding box and the bulge of
    its edges; all cells for polygons wider than 160 degrees, which includes those around a
    pole. Those over right ascension 0 are taken as lying around 360."""
    n, last = int(round(360 / size)), int(round(180 / size)) - 1
    wide = lambda v: F.array_max(v) - F.array_min(v)

    def place(plain: Column) -> Column:
        around = F.transform(plain, lambda v: F.when(v < 180, v + 360).otherwise(v))
        return _let(around, lambda w: F.when((wide(plain) > 160) & (wide(w) <= 160), w).otherwise(plain))

    def bounds(ras: Column) -> Column:
        decs = F.transform(poly, lambda v: v["dec"])
        return F.struct(F.array_min(ras).alias("west"), F.array_max(ras).alias("east"), F.array_min(decs).alias("south"), F.array_max(decs).alias("north"))

    def ranges(b: Column) -> Column:
        half = (b["east"] - b["west"]) / 2
        steep = F.greatest(F.abs(b["south"]), F.abs(b["north"]))
        # Great circles between corners bulge towards the pole, by at most this.
        bulge = F.degrees(F.atan(F.tan(F.radians(steep)) / F.cos(F.radians(half)))) - steep
        # Corners within less than half a turn can't surround a pole, and edges stay between their meridians.
        polar = half > 80
        lo = F.when(polar, F.lit(0)).otherwise(F.greatest(F.floor((b["south"] - bulge + 90) / size), F.lit(0)))
        hi = F.when(polar, F.lit(last)).otherwise(F.least(F.floor((b["north"] + bulge + 90) / size), F.lit(last)))
        first = F.when(polar, F.lit(0)).otherwise(F.floor(b["west"] / size))
        final = F.when(polar, F.lit(n - 1)).otherwise(F.floor(b["east"] / size))
        return F.struct(F.sequence(lo.cast("int"), hi.cast("int")).alias("rows"), F.sequence(first.cast("int"), final.cast("int")).alias("cols"))

    def cells(r: Column) -> Column:
        return F.flatten(F.transform(r["rows"], lambda j: F.transform(r["cols"], lambda i: F.struct(F.pmod(i, F.lit(n)).alias("i"), j.alias("j")))))

    ra = F.transform(poly, lambda v: F.pmod(v["ra"], F.lit(360.0)))
    return _let(_let(_let(_let(ra, place), bounds), ranges), cells)


def spatial_join(points: DataFrame, planes: DataFrame, *, ra: str = "ra", dec: str = "dec", poly: str = "poly", cell: float = 5.0) -> DataFrame:
    """Pairs of points and planes with the point inside the polygon.

    An equi-join on grid cells with the exact test as its residual: no nested loop. A
    point has one cell, so no pair comes twice. Points without a position match nothing.
    """
    if 360 % cell or 180 % cell:
        raise ValueError("cell must divide 180 and 360 degrees")
    # Unit vectors are computed once per row, not once per pair.
    p = points.withColumn("_cell", _cell(F.col(ra), F.col(dec), cell)).withColumn("_point", _point(F.col(ra), F.col(dec)))
    q = planes.withColumn("_edges", _edges(F.col(poly))).withColumn("_cell", F.explode(covering_cells(F.col(poly), cell)))
    return p.join(q, "_cell").where(_inside(F.col("_point"), F.col("_edges"))).drop("_cell", "_point", "_edges")


def search(sources: DataFrame, artifact: DataFrame, plane: DataFrame, bands: tuple[str, ...] | None = None, ordered: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Observations of each source: catalogue join, containment, bands, derived columns.

    Rows whose publisher id has no observation id are dropped. ordered: with seq, the place
    in the source's order of start time. columns: only these, and seq.
    """
    if bands:
        plane = plane.where(F.col("energy_bandpassname").isin(*[S.BANDPASS + b for b in bands]))
    lo, hi = F.col("time_bounds_lower"), F.col("time_bounds_upper")
    obs_id = S.obs_id_of(F.col("obs_publisher_did"))
    derived = {
        "obs_id": obs_id,
        "band": S.band_of(F.col("energy_bandpassname")),
        "mjd": (lo + hi) / 2,
        "wavelength_min": F.col("energy_bounds_lower") * 1e6,
        "wavelength_max": F.col("energy_bounds_upper") * 1e6,
        "download_url": S.archive_url(F.col("uri")),
        "t_min": lo,
        "t_max": hi,
    }
    columns = columns or ["source_id", *derived]
    shown = {c: derived[c] for c in columns if c != "source_id"}
    if ordered:
        of_plane = {c: v for c, v in derived.items() if c != "download_url" and (c in shown or c in sightings.ORDER)}
        named = plane.select("planeid", *[v.alias(c) for c, v in of_plane.items()], "poly").where(F.col("obs_id").isNotNull())
        found = sightings.numbered(sources, named, artifact, [c for c in of_plane if c in shown])
        return found.withColumn("download_url", derived["download_url"]).select(*columns, "seq")
    hit = spatial_join(sources.select("source_id", "ra", "dec"), plane)
    return hit.join(artifact, "planeid").where(obs_id.isNotNull()).select(*[shown[c].alias(c) if c in shown else c for c in columns])


def band_counts(obs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return obs.groupBy(*(keys or []), "band").agg(F.count(F.lit(1)).alias("n"))


def time_span(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count(F.lit(1)).alias("n_observations"), F.coalesce(F.max("mjd") - F.min("mjd"), F.lit(0.0)).alias("time_span_days"))


def filter_by_band(spark, obs: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Counts of the requested bands, zeros included, with the parent's time span."""
    asked = spark.createDataFrame([(b,) for b in bands], "band string")
    counts = band_counts(obs.where(F.col("band").isin(*bands)))
    return asked.join(counts, "band", "left").crossJoin(F.broadcast(time_span(obs).select("time_span_days"))).select("band", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "time_span_days")


def download_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.groupBy(*keys).agg(F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed"), (F.sum(F.when(ok, F.coalesce("size_mb", F.lit(0.0)))) / 1024).alias("total_gb"))


def first_failures(results: DataFrame, n: int = 5) -> DataFrame:
    """The n first failures, by time, and how many more there are."""
    bad = results.where(~F.coalesce(F.col("success"), F.lit(False)))
    total = bad.agg(F.count(F.lit(1)).alias("_n"))
    return bad.orderBy("finished_at", "url", "error_text").limit(n).crossJoin(F.broadcast(total)).select("url", "error_text", "finished_at", F.greatest(F.col("_n") - n, F.lit(0)).alias("n_more"))


def still_to_fetch(obs: DataFrame, results: DataFrame) -> DataFrame:
    """Distinct (band, obs_id) whose file has not been fetched successfully."""
    have = results.where(F.col("success")).select(F.col("local_path").alias("path"))
    want = obs.select("band", "obs_id", S.output_path("data", F.col("band"), F.col("obs_id")).alias("path")).distinct()
    return want.join(have, "path", "left_anti").select("band", "obs_id", "path")
