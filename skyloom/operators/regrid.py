"""Irregular readings onto a regular grid, by local polynomial regression.

Every reading lends itself to the grid times within the kernel's support, found by
arithmetic on its period number (no range join). The weighted normal equations of a
local line are five sums, so each grid time is one hash aggregation, and the line's
value at the grid time is their closed form; nothing leaves the JVM.

Readings are shuffled once, by series and block of periods, together with the few
readings of the neighbouring block that reach over; repeated deliveries, regression and
counts are then computed without another exchange. Series of more than ``hot_rows`` rows
go another way: deliveries fold by reading, which spreads a series over all tasks, and
the sums fold by period on the map side, so that what is brought together of a series,
however large, is some rows for each of its periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.logbuckets import is_finite
from skyloom.session import bounded_broadcast, checkpointed


def regular_grid(
    readings: DataFrame,
    *,
    origin: float = 61041.0,
    end: float = 61761.0,
    period: float = 10.0,
    bandwidth: float = 20.0,
    min_support: float = 2.0,
    block: int = 12,
    hot_rows: int = 1_000_000,
    bands: tuple[str, ...] = ("D1", "D2", "D3", "D4", "D5", "D6"),
) -> DataFrame:
    """One row per source, band and period from the first to the last reading.

    ``readings`` needs source_id, obs_id, band, mjd, flux; other columns are ignored.
    A reading counts if its band is one of ``bands``, ``origin`` <= mjd < ``end`` and
    its flux is neither null, NaN nor infinite. Deliveries of the same (source, band,
    obs_id) count once (smallest mjd, then flux, of the valid deliveries).

    Columns: source_id, band, period_no int, period_mid double, n_readings long (in
    the period itself), support double (effective number of readings, (Σw)²/Σw², 0
    where none is in reach), flux double, status string. The kernel is Epanechnikov's
    with half-width ``bandwidth`` days around the middle of the period; where all
    weight lies on one time the estimate is the weighted mean.
    status: ``observed`` (has a reading), ``filled`` (no reading, but support of at
    least ``min_support``) or ``missing`` (flux null). Null source_id is a series of
    its own. An empty input gives an empty result. ``block`` and ``hot_rows`` change how the work is
    divided, not the result.
    """
    last = int((end - origin) // period) - 1
    p = F.floor((F.col("mjd") - F.lit(origin)) / F.lit(period)).cast("int")
    reach = F.lit(bandwidth / period)
    centre = (F.col("mjd") - F.lit(origin)) / F.lit(period) - F.lit(0.5)
    lo = F.greatest(F.ceil(centre - reach).cast("int"), F.lit(0))
    hi = F.least(F.floor(centre + reach).cast("int"), F.lit(last))
    keys = ["source_id", "band"]
    r = readings.select("source_id", "obs_id", "band", F.col("mjd").cast("double").alias("mjd"), F.col("flux").cast("double").alias("flux")).where(
        F.col("band").isin(*bands) & (F.col("mjd") >= origin) & (F.col("mjd") < end) & is_finite(F.col("flux"))
    )
    first = F.min(F.struct("mjd", "flux")).alias("m")

    def sums(once: DataFrame, by: list[str], a, z) -> DataFrame:
        """The sums of the normal equations by period, from readings to periods a to z."""
        w, d, y = F.col("w"), F.col("d"), F.col("flux")
        reached = (
            once.withColumn("own", p)
            .withColumn("t", F.explode(F.sequence(a, z)))
            .withColumn("d", (F.col("mjd") - F.lit(origin)) / F.lit(period) - (F.col("t") + F.lit(0.5)))
            .withColumn("w", F.greatest(1 - (F.col("d") / reach) * (F.col("d") / reach), F.lit(0.0)))
            .withColumn("mine", (F.col("t") == F.col("own")).cast("long"))
        )
        parts = {"n": "mine", "s0": w, "q": w * w, "s1": w * d, "s2": w * d * d, "t0": w * y, "t1": w * d * y}
        return reached.groupBy(*by, "t").agg(*[F.sum(x).alias(k) for k, x in parts.items()])

    from_, to = F.least(lo, p), F.greatest(hi, p)
    hot = checkpointed(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows).select(*[F.col(k).alias(f"_{k}") for k in keys]))
    is_hot = F.col("source_id").eqNullSafe(F.col("_source_id")) & (F.col("band") == F.col("_band"))
    some = not hot.isEmpty()
    cold = (
        (r.join(bounded_broadcast(hot), is_hot, "left_anti") if some else r)
        .withColumn("blk", F.explode(F.sequence((from_ / F.lit(block)).cast("int"), (to / F.lit(block)).cast("int"))))
        .repartition("source_id", "band", "blk")
    )
    once = cold.groupBy(*keys, "blk", "obs_id").agg(first).select(*keys, "blk", "m.mjd", "m.flux")
    inside = F.greatest(F.least(lo, F.col("own")), F.col("blk") * block), F.least(F.greatest(hi, F.col("own")), F.col("blk") * block + (block - 1))
    total = sums(once, [*keys, "blk"], *inside).drop("blk")
    if some:
        large = r.join(bounded_broadcast(hot), is_hot, "left_semi").groupBy(*keys, "obs_id").agg(first).select(*keys, "m.mjd", "m.flux")
        total = total.unionByName(sums(large, keys, F.least(lo, F.col("own")), F.greatest(hi, F.col("own"))))
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    det = s0 * s2 - s1 * s1
    fit = F.when(s0 <= 0, F.lit(None)).when(det > 1e-9 * s0 * s0, (s2 * t0 - s1 * t1) / det).otherwise(t0 / s0)
    at = total.select("source_id", "band", F.struct(F.col("t"), F.col("n"), F.when(s0 > 0, s0 * s0 / F.col("q")).otherwise(0.0).alias("support"), fit.alias("flux")).alias("g"))
    # A series has at most as many grid times as the survey has periods.
    series = (
        at.groupBy("source_id", "band")
        .agg(F.min(F.when(F.col("g.n") > 0, F.col("g.t"))).alias("first"), F.max(F.when(F.col("g.n") > 0, F.col("g.t"))).alias("last"), F.collect_list("g").alias("gs"))
        .where(F.col("first").isNotNull())
        .withColumn("by", F.map_from_arrays(F.transform("gs", lambda g: g["t"]), F.col("gs")))
        .select("source_id", "band", "by", F.explode(F.sequence("first", "last")).alias("period_no"))
        .select("source_id", "band", "period_no", F.try_element_at("by", F.col("period_no")).alias("g"))
    )
    n, support = F.coalesce(F.col("g.n"), F.lit(0).cast("long")), F.coalesce(F.col("g.support"), F.lit(0.0))
    return series.select(
        "source_id",
        "band",
        "period_no",
        (F.lit(origin) + (F.col("period_no") + 0.5) * F.lit(period)).alias("period_mid"),
        n.alias("n_readings"),
        support.alias("support"),
        F.when((n > 0) | (support >= min_support), F.col("g.flux")).alias("flux"),
        F.when(n > 0, "observed").when(support >= min_support, "filled").otherwise("missing").alias("status"),
    )


def empty_periods(grid: DataFrame) -> DataFrame:
    """The periods of a grid without a reading of their own, filled or not."""
    return grid.where(F.col("n_readings") == 0).select("source_id", "band", "period_no")
