"""Photometry of small images as relations: one row per pixel.

A pixel relation has the columns img (key of the image), y, x (0-based), image, variance,
zodi, flags. Windows here are over one image, whose size is bounded; full frames go
through ``sources.mef`` instead, which reads them as arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions import scalars as S

STRICT = S.flag_mask((*S.BAD_FLAGS, S.FLAG_BITS["SOURCE"]))
RELAXED = S.flag_mask(S.BAD_FLAGS)


def _image():
    return Window.partitionBy("img")


def usable(mask: int = STRICT) -> Column:
    """Pixels without any flag of ``mask`` (strict: bad pixels and those with a source)."""
    return ~S.has_flag(F.col("flags"), mask)


def distance(x0: float, y0: float) -> Column:
    dx, dy = F.col("x") - F.lit(float(x0)), F.col("y") - F.lit(float(y0))
    return F.sqrt(dx * dx + dy * dy)


def repair_variance(px: DataFrame) -> DataFrame:
    """NaN variances become the median of the image's valid ones.

    Images with a NaN variance where no flag is set, or without a valid one, are dropped.
    """
    nan = F.isnan("variance")
    valid = ~nan & (F.col("variance") > 0)
    return (
        px.withColumn("_bad", F.bool_or(nan & (F.col("flags") == 0)).over(_image()))
        .withColumn("_mid", F.median(F.when(valid, F.col("variance"))).over(_image()))
        .withColumn("_nan", F.bool_or(nan).over(_image()))
        .where(~F.col("_bad") & (~F.col("_nan") | F.col("_mid").isNotNull()))
        .withColumn("variance", F.when(nan, F.col("_mid")).otherwise(F.col("variance")))
        .drop("_bad", "_mid", "_nan")
    )


def zodi_scale(px: DataFrame, *, least: float = 0.0, most: float = 10.0, good: float = 0.5) -> DataFrame:
    """img, good_fraction, fit, scale: weighted fit of the zodiacal model through the origin.

    Weights are 1 / variance; without a positive variance the fit is unweighted. The scale is 1
    where the fit is impossible, not in (least, most], or fewer than ``good`` of the pixels count.
    """
    ok = usable() & (F.col("zodi") != 0)
    heavy = ok & (F.col("variance") > 0)
    i, z, v = F.col("image"), F.col("zodi"), F.col("variance")
    t = px.groupBy("img").agg(
        F.avg(usable().cast("double")).alias("good_fraction"),
        F.sum(F.when(heavy, i * z / v)).alias("a"),
        F.sum(F.when(heavy, z * z / v)).alias("b"),
        F.sum(F.when(ok, i * z)).alias("c"),
        F.sum(F.when(ok, z * z)).alias("d"),
    )
    fit = F.coalesce(F.try_divide("a", "b"), F.try_divide("c", "d"), F.lit(1.0))
    return t.select("img", "good_fraction", fit.alias("fit")).withColumn("scale", F.when((F.col("good_fraction") < good) | F.isnan("fit") | (F.col("fit") <= least) | (F.col("fit") > most), 1.0).otherwise(F.col("fit")))


def subtract_zodi(px: DataFrame, **how) -> DataFrame:
    return px.join(zodi_scale(px, **how).select("img", "scale"), "img").withColumn("image", F.col("image") - F.col("scale") * F.col("zodi")).drop("scale")


def flag_union(px: DataFrame, x0: float, y0: float, radius: float) -> DataFrame:
    """img, flag: bitwise OR over pixels whose centre lies within the radius; 0 for none."""
    dx, dy = F.col("x") - F.lit(float(x0)), F.col("y") - F.lit(float(y0))
    inside = dx * dx + dy * dy <= radius * radius
    return px.groupBy("img").agg(F.coalesce(F.bit_or(F.when(inside, F.col("flags"))), F.lit(0)).alias("flag"))


def aperture_sum(px: DataFrame, x0: float, y0: float, radius: float, weight: Column | None = None) -> DataFrame:
    """img, raw_flux, raw_error: Σ w·image and √Σ w·variance, w 1 for centres inside by default."""
    w = F.when(distance(x0, y0) <= radius, 1.0).otherwise(0.0) if weight is None else weight
    return px.where(w > 0).groupBy("img").agg(F.sum(w * F.col("image")).alias("raw_flux"), F.sqrt(F.sum(w * F.col("variance"))).alias("raw_error"))


def _clipped(px: DataFrame, used: str, sigma: float, maxiters: int) -> DataFrame:
    """img, background, error, n_usable from the pixels where column ``used`` holds."""
    out = px.withColumn("_kept", F.col(used))
    v = F.col("image")
    for _ in range(maxiters):
        x = F.when(F.col("_kept"), v)
        out = out.withColumn("_mid", F.median(x).over(_image())).withColumn("_sd", F.stddev_pop(x).over(_image()))
        out = out.withColumn("_kept", F.col("_kept") & (v >= F.col("_mid") - sigma * F.col("_sd")) & (v <= F.col("_mid") + sigma * F.col("_sd")))
    x = F.when(F.col("_kept"), v)
    n = F.count_if(F.col(used))
    return out.groupBy("img").agg(F.median(x).alias("_m"), F.stddev_pop(x).alias("_s"), n.alias("n_usable")).select(
        "img", F.coalesce("_m", F.lit(0.0)).alias("background"), F.coalesce(F.when(F.col("n_usable") > 0, F.col("_s") / F.sqrt(F.greatest(F.col("n_usable"), F.lit(1)))), F.lit(0.0)).alias("error"), "n_usable"
    )


def window_background(px: DataFrame, x0: float, y0: float, radius: float, *, size: tuple[int, int] = (50, 50), least: int = 10, sigma: float = 3.0, maxiters: int = 3) -> DataFrame:
    """img, background, error, n_usable from a window around the position.

    Pixels of the window farther than ``radius`` + 0.707 and not flagged count; those with a
    source too if there are fewer than ``least`` otherwise. Fewer than that still: all zero.
    The level is the median after clipping, its error the deviation over √n before clipping.
    """
    h, w = size
    inside = (F.col("y") >= math.floor(y0 - h / 2)) & (F.col("y") < math.ceil(y0 + h / 2)) & (F.col("x") >= math.floor(x0 - w / 2)) & (F.col("x") < math.ceil(x0 + w / 2))
    outside = inside & (distance(x0, y0) > radius + 0.707)
    q = px.withColumn("_strict", outside & usable(STRICT)).withColumn("_loose", outside & usable(RELAXED))
    q = q.withColumn("_ns", F.count_if("_strict").over(_image())).withColumn("_nl", F.count_if("_loose").over(_image()))
    used = F.when(F.col("_ns") >= least, F.col("_strict")).otherwise(F.col("_loose") & (F.col("_nl") >= least))
    return _clipped(q.withColumn("_used", used), "_used", sigma, maxiters)


def annulus_plan(x0: float, y0: float, radius: float, nx: int, ny: int, *, least: int = 10, most: float = 5.0, offset: float = 1.414, attempts: int = 5, step: float = 0.5) -> tuple[float, list[float]]:
    """Inner radius, and the outer radii that are tried one after the other."""
    inner = radius + offset
    outer = min(math.sqrt(least / math.pi + inner * inner), most)
    edge = min(x0, y0, nx - x0, ny - y0)
    if outer > edge:
        outer = edge
        if inner >= outer:
            inner = outer * 0.7
    tried = [outer]
    while len(tried) < attempts and tried[-1] < most and tried[-1] < edge:
        wider = min(tried[-1] + step, most, edge)
        if wider <= tried[-1]:
            break
        tried.append(wider)
    return inner, tried


def annulus_background(px: DataFrame, x0: float, y0: float, radius: float, *, nx: int, ny: int, least: int = 10, attempts: int = 5, sigma: float = 3.0, maxiters: int = 3, **how) -> DataFrame:
    """img, background, error, n_usable from a ring around the position.

    The first ring of ``annulus_plan`` with ``least`` unflagged pixels counts, else the
    last one; if all attempts were needed, its pixels with a source count as well.
    """
    inner, tried = annulus_plan(x0, y0, radius, nx, ny, least=least, attempts=attempts, **how)
    d = distance(x0, y0)
    q = px
    for k, outer in enumerate(tried):
        q = q.withColumn(f"_r{k}", (d >= inner) & (d <= outer) & usable(STRICT))
        q = q.withColumn(f"_n{k}", F.count_if(f"_r{k}").over(_image()))
    last = len(tried) - 1
    used = F.col(f"_r{last}")
    if len(tried) == attempts:
        used = F.when(F.col(f"_n{last}") >= least, used).otherwise((d >= inner) & (d <= tried[last]) & usable(RELAXED))
    for k in range(last - 1, -1, -1):
        used = F.when(F.col(f"_n{k}") >= least, F.col(f"_r{k}")).otherwise(used)
    return _clipped(q.withColumn("_used", used), "_used", sigma, maxiters)


def photometry(px: DataFrame, background: DataFrame, x0: float, y0: float, radius: float, scale_arcsec: float = S.PIXEL_ARCSEC, weight: Column | None = None) -> DataFrame:
    """img, flux, flux_error, background, background_error, n_usable.

    Images without background pixels get flux 0 and error 1e10.
    """
    area = math.pi * radius * radius
    j = aperture_sum(px, x0, y0, radius, weight).join(background, "img")
    none = F.col("n_usable") == 0
    be = F.col("error") * area
    return j.select(
        "img",
        F.when(none, 0.0).otherwise(S.pixel_area_flux(F.col("raw_flux") - F.col("background") * area, F.lit(scale_arcsec))).alias("flux"),
        F.when(none, 1e10).otherwise(S.pixel_area_flux(F.sqrt(F.col("raw_error") * F.col("raw_error") + be * be), F.lit(scale_arcsec))).alias("flux_error"),
        F.when(none, 0.0).otherwise(F.col("background")).alias("background"),
        F.when(none, 1e10).otherwise(F.col("error")).alias("background_error"),
        "n_usable",
    )


def cutout(px: DataFrame, x0: float, y0: float, h: int, w: int) -> DataFrame:
    """The pixels of an h × w box around a position, trimmed at the image's edge, re-indexed."""
    top, left = math.ceil(y0 - h / 2), math.ceil(x0 - w / 2)
    return px.where(F.col("y").between(top, top + h - 1) & F.col("x").between(left, left + w - 1)).withColumn("y", F.col("y") - max(top, 0)).withColumn("x", F.col("x") - max(left, 0))


def peak(px: DataFrame) -> DataFrame:
    """img, y, x, image of each image's largest value; the first in row order of several."""
    best = F.max(F.struct(F.col("image").alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx")))
    return px.groupBy("img").agg(best.alias("b")).select("img", (-F.col("b.ny")).alias("y"), (-F.col("b.nx")).alias("x"), F.col("b.v").alias("image"))


def nearest_zone(points: DataFrame, zones: DataFrame, *, most_zones: int = 1000) -> DataFrame:
    """points with zone_id and zone_distance of the nearest PSF zone; the lowest id of ties.

    ``points`` has x and y (0-based); zone centres are 1-based. A detector has 121 zones: the
    zones go along as one array, after a check of their number.
    """
    rows = zones.select("zone_id", "xctr", "yctr").limit(most_zones + 1).collect()
    if len(rows) > most_zones:
        raise ValueError(f"more than {most_zones} zones")
    if not rows:
        return points.withColumn("zone_id", F.lit(None).cast("int")).withColumn("zone_distance", F.lit(None).cast("double"))
    px, py = F.col("x") + 1.0, F.col("y") + 1.0
    each = F.array(*[F.struct(F.sqrt((px - F.lit(float(r["xctr"]))) * (px - F.lit(float(r["xctr"]))) + (py - F.lit(float(r["yctr"]))) * (py - F.lit(float(r["yctr"])))).alias("d"), F.lit(int(r["zone_id"])).alias("z")) for r in rows])
    return points.withColumn("_best", F.array_min(each)).withColumn("zone_id", F.col("_best.z")).withColumn("zone_distance", F.col("_best.d")).drop("_best")
