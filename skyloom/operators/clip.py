"""Iterative sigma clipping of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.logbuckets import is_finite
from skyloom.operators.selection import exact_quantiles
from skyloom.session import bounded_broadcast, checkpointed


def sigma_clip(df: DataFrame, keys: list[str], value: str, *, sigma: float = 3.0, maxiters: int = 10, large: int = 200_000) -> DataFrame:
    """The rows of ``df`` whose value survives clipping within its group.

    Each round keeps values within ``sigma`` population standard deviations of the
    median of what was kept, until nothing changes or ``maxiters`` rounds. Rows whose value
    is null, NaN or infinite are dropped. Null keys are groups of their own.

    Groups of up to ``large`` rows are clipped in one exchange over windows; larger
    ones (at most rows / ``large`` of them) keep an interval per group instead, narrowed
    by aggregations round by round.
    """
    some = df.where(is_finite(F.col(value)))
    hot = checkpointed(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*keys))
    if hot.isEmpty():
        return _by_windows(some, keys, value, sigma, maxiters)
    hot = bounded_broadcast(hot)
    cond = _same(some, hot, keys)
    return _by_windows(some.join(hot, cond, "left_anti"), keys, value, sigma, maxiters).unionByName(_by_intervals(some.join(hot, cond, "left_semi"), keys, value, sigma, maxiters))


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _by_windows(df: DataFrame, keys: list[str], value: str, sigma: float, maxiters: int) -> DataFrame:
    w = Window.partitionBy(*keys)
    out = df.withColumn("_kept", F.lit(True))
    v = F.col(value).cast("double")
    for _ in range(maxiters):
        x = F.when(F.col("_kept"), v)
        out = out.withColumn("_mid", F.median(x).over(w)).withColumn("_sd", F.stddev_pop(x).over(w))
        out = out.withColumn("_kept", F.col("_kept") & (v >= F.col("_mid") - sigma * F.col("_sd")) & (v <= F.col("_mid") + sigma * F.col("_sd")))
    return out.where("_kept").drop("_kept", "_mid", "_sd")


def _by_intervals(df: DataFrame, keys: list[str], value: str, sigma: float, maxiters: int) -> DataFrame:
    v = F.col(value).cast("double")
    bounds = df.select(*keys).distinct().withColumns({"_lo": F.lit(float("-inf")), "_hi": F.lit(float("inf"))})
    kept = df
    for _ in range(maxiters):
        mid = exact_quantiles(kept, keys, value, {"_mid": 0.5}).drop("n")
        sd = kept.groupBy(*keys).agg(F.stddev_pop(v).alias("_sd"))
        new = mid.join(sd, _same(mid, sd, keys)).select(*[mid[k] for k in keys], (F.col("_mid") - sigma * F.col("_sd")).alias("_lo"), (F.col("_mid") + sigma * F.col("_sd")).alias("_hi"))
        old = bounds.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_lo").alias("_olo"), F.col("_hi").alias("_ohi"))
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
        bounds = checkpointed(new.join(old, cond).select(*keys, F.greatest("_lo", "_olo").alias("_lo"), F.least("_hi", "_ohi").alias("_hi")))
        ends = bounds.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "_lo", "_hi")
        cond = (v >= F.col("_lo")) & (v <= F.col("_hi"))
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        narrower = df.join(bounded_broadcast(ends), cond, "left_semi")
        before = kept
        kept = narrower
        if before.count() == kept.count():
            break
    return kept
