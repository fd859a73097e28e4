"""Building, classifying, summarising and comparing light curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions import scalars as S
from skyloom.operators.clip import sigma_clip
from skyloom.operators.selection import exact_quantiles
from skyloom.session import checkpointed


def usable(m: DataFrame) -> DataFrame:
    """Measurements that are kept: positive finite flux and a magnitude."""
    return m.where(S.finite(F.col("flux")) & (F.col("flux") > 0) & F.col("mag_ab").isNotNull() & ~F.isnan("mag_ab"))


def time_order(m: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``m`` with seq, each row's place in its group's order of mjd, obs_id and meas_id, or of ``order``.

    Null comes first, NaN last; equal rows are in any order. The table is written once in
    ranges of the whole order, whose bounds are sampled, so that a group of any size is
    spread over as many ranges as it needs, even if all its rows have one time. A place is the
    number of the group's rows in earlier ranges plus the place within the range.
    """
    order = order or ["mjd", "obs_id", "meas_id"]
    ranged = checkpointed(m.repartitionByRange(*keys, *order, F.rand(5)).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_kr"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_kr")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = ranged.withColumn("_r", within).join(before, same)
    return placed.select(*m.columns, (F.col("_before") + F.col("_r")).alias("seq"))


def light_curve(m: DataFrame) -> DataFrame:
    """Derived columns and the place of each measurement in its source's and band's time order."""
    return time_order(m, ["source_id", "band"]).select(
        "source_id",
        "obs_id",
        "band",
        "meas_id",
        "mjd",
        "flux",
        "flux_error",
        S.snr(F.col("flux"), F.col("flux_error")).alias("snr"),
        S.is_upper_limit(F.col("flux"), F.col("flux_error")).alias("is_upper_limit"),
        S.flag_binary(F.col("flag")).alias("flag_binary"),
        "seq",
    )


def quality_class(flux: Column, error: Column, flag: Column, *, sigma: float = 5.0, mask: int | None = None, separate: bool = True) -> Column:
    """good_regular, rejected_regular, good_upper_limits or rejected_upper_limits.

    Rejected: snr below ``sigma`` or a bit of ``mask`` set (None: flags don't count).
    """
    mask = S.flag_mask() if mask is None else mask
    r = S.snr(flux, error)
    low = (r < sigma) & ~F.isnan(r)
    rejected = F.coalesce(low, F.lit(True)) | F.coalesce(S.has_flag(flag, mask), F.lit(False))
    limit = F.coalesce(S.is_upper_limit(flux, error), F.lit(False)) if separate else F.lit(False)
    return F.concat(F.when(rejected, "rejected").otherwise("good"), F.when(limit, "_upper_limits").otherwise("_regular"))


def classified(m: DataFrame, **how) -> DataFrame:
    return m.withColumn("quality_class", quality_class(F.col("flux"), F.col("flux_error"), F.col("flag"), **how))


def quality_filter(m: DataFrame, *, sigma: float = 5.0, mask: int | None = None, strict: bool = False) -> DataFrame:
    """The measurements that pass: snr not below ``sigma`` (nor missing) and no bit of ``mask`` set.

    strict: snr of ``sigma`` or more and a flag of 0.
    """
    r = S.snr(F.col("flux"), F.col("flux_error"))
    if strict:
        return m.where((r >= sigma) & (F.col("flag") == 0))
    mask = S.flag_mask() if mask is None else mask
    return m.where(~F.coalesce(r < sigma, F.lit(True)) & ~F.coalesce(S.has_flag(F.col("flag"), mask), F.lit(False)))


def band_days(m: DataFrame) -> DataFrame:
    """band, day (of mjd), n: how many measurements fall on each day."""
    return m.where(S.finite(F.col("mjd"))).groupBy("band", F.floor("mjd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def filter_counts(m: DataFrame, *, keys: list[str], sigma: float = 5.0, mask: int | None = None) -> DataFrame:
    """How many measurements pass, and why the others don't (each counted once)."""
    mask = S.flag_mask() if mask is None else mask
    low = F.coalesce(S.snr(F.col("flux"), F.col("flux_error")) < sigma, F.lit(True))
    bad = F.coalesce(S.has_flag(F.col("flag"), mask), F.lit(False))
    return m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~low & ~bad).alias("n_kept"),
        F.count_if(low & bad).alias("rejected_both"),
        F.count_if(low & ~bad).alias("rejected_snr"),
        F.count_if(~low & bad).alias("rejected_flag"),
    )


def summary(m: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, bands, ranges, span and mean signal-to-noise of light curves."""
    return m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_measurements"),
        F.countDistinct("band").alias("n_bands"),
        F.concat_ws(",", F.sort_array(F.collect_set("band"))).alias("bands"),
        F.min("mjd").alias("mjd_min"),
        F.max("mjd").alias("mjd_max"),
        (F.max("mjd") - F.min("mjd")).alias("time_span_days"),
        F.min("wavelength").alias("wavelength_min"),
        F.max("wavelength").alias("wavelength_max"),
        F.count_if(S.is_upper_limit(F.col("flux"), F.col("flux_error"))).alias("n_upper_limits"),
        F.avg(S.snr(F.col("flux"), F.col("flux_error"))).alias("mean_snr"),
    )


def clipped(m: DataFrame, keys: list[str], *, sigma: float = 3.0, maxiters: int = 10) -> DataFrame:
    """Regular measurements clipped on flux, and all upper limits after them."""
    limit = F.coalesce(S.is_upper_limit(F.col("flux"), F.col("flux_error")), F.lit(False))
    return sigma_clip(m.where(~limit), keys, "flux", sigma=sigma, maxiters=maxiters).unionByName(m.where(limit))


def plot_limits(df: DataFrame, keys: list[str], value: str, *, low: float = 0.001, high: float = 0.999, padding: float = 0.1) -> DataFrame:
    """keys..., y_min, y_max: percentiles with padding; flat values get ±10 % or ±0.1, groups without values 0 to 1."""
    q = exact_quantiles(df, keys, value, {"a": low, "b": high})
    if keys:
        q = _null_safe(df.select(*keys).distinct(), q, keys, "left")
    a, b = F.col("a"), F.col("b")
    wide = b > a
    return q.select(
        *keys,
        F.when(a.isNull(), 0.0).when(wide, a - (b - a) * padding).when(a != 0, a * 0.9).otherwise(-0.1).alias("y_min"),
        F.when(a.isNull(), 1.0).when(wide, b + (b - a) * padding).when(a != 0, b * 1.1).otherwise(0.1).alias("y_max"),
    )


def _null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null with null; those of ``other`` are dropped."""
    o = other.select(*[F.col(k).alias(f"_on_{k}") if k in keys else F.col(k) for k in other.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(o, on, how).drop(*[f"_on_{k}" for k in keys])


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 20, upto: float | None = None) -> DataFrame:
    """keys..., bin, count: equal bins over the group's range, the last one closed.

    upto: only values up to that quantile of the group.
    """
    v = df.where(S.finite(F.col(value))).select(*keys, F.col(value).alias("_v"))
    if upto is not None:
        v = _null_safe(v, exact_quantiles(v, keys, "_v", {"_most": upto}).select(*keys, "_most"), keys).where("_v <= _most").drop("_most")
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / w), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    return _null_safe(v, ends, keys).select(*keys, place.cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))


def days_since_first(m: DataFrame, keys: list[str]) -> DataFrame:
    """``m`` with days since the group's first mjd: from an aggregate, not a window, so
    that no group has to be in one task."""
    first = m.groupBy(*keys).agg(F.min("mjd").alias("_first"))
    return _null_safe(m, first, keys).withColumn("days", F.col("mjd") - F.col("_first")).drop("_first")


def spectrum_series(m: DataFrame, *, magnitude: bool = False, ordered: bool = False, **how) -> DataFrame:
    """One row per measurement of a spectrum plot: class, wavelength, full bandwidth, y, yerr, days.

    ``how`` goes to ``quality_class``. ordered: with seq, the place in the source's order of wavelength.
    """
    c = classified(m, **how)
    limit = F.col("quality_class").endswith("upper_limits")
    y = F.col("mag_ab") if magnitude else F.when(limit, F.col("flux") + F.col("flux_error")).otherwise(F.col("flux"))
    first = c.where(F.col("quality_class") == "good_regular").groupBy("source_id").agg(F.min("mjd").alias("_first"))
    out = (
        c.withColumn("y", y)
        .where(F.col("y").isNotNull() & ~F.isnan("y"))
        .join(first, "source_id", "left")
        .select("source_id", "meas_id", "quality_class", "wavelength", "bandwidth", "y", F.when(~limit, F.col("mag_ab_error" if magnitude else "flux_error")).alias("yerr"), (F.col("mjd") - F.col("_first")).alias("days"))
    )
    return time_order(out, ["source_id"], ["wavelength", "meas_id"]) if ordered else out


def time_series(m: DataFrame, *, magnitude: bool = False, ordered: bool = False, **how) -> DataFrame:
    """One row per measurement of a light-curve plot; limits are drawn at flux + error if good.

    magnitude: y and yerr are magnitudes. ``how`` goes to ``quality_class``. ordered: with
    seq, the place in the source's order of time.
    """
    c = classified(m, separate=False, **how)
    good = F.col("quality_class") == "good_regular"
    limit = F.coalesce(S.is_upper_limit(F.col("flux"), F.col("flux_error")), F.lit(False))
    y = F.col("mag_ab") if magnitude else F.when(good & limit, F.col("flux") + F.col("flux_error")).otherwise(F.col("flux"))
    out = (
        c.withColumn("y", y)
        .where(F.col("y").isNotNull() & ~F.isnan("y"))
        .select("source_id", "meas_id", F.when(good, "good").otherwise("rejected").alias("class"), "mjd", "y", F.col("mag_ab_error" if magnitude else "flux_error").alias("yerr"), "wavelength", limit.alias("is_limit"))
    )
    return time_order(out, ["source_id"], ["mjd", "meas_id"]) if ordered else out


def axis_limits(df: DataFrame, keys: list[str], value: str, margin: float = 0.05) -> DataFrame:
    """x_min and x_max with a margin of the range, where there is one."""
    a, b = F.min(value), F.max(value)
    return df.where(S.finite(F.col(value))).groupBy(*keys).agg((a - (b - a) * margin).alias("x_min"), (b + (b - a) * margin).alias("x_max"))


def compare(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Per band: count, mean and sample deviation of the relative flux difference in percent."""
    j = a.select(*on, F.col("flux").alias("_a")).join(b.select(*on, F.col("flux").alias("_b")), on)
    d = (F.col("_b") - F.col("_a")) / F.col("_a") * 100
    return j.where(S.finite(F.col("_a")) & S.finite(F.col("_b")) & (F.col("_a") != 0)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"))
