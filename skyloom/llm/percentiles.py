"""Percentiles of very large columns from mergeable counts in logarithmic buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.logbuckets import bucket, is_finite, offset, representative

__all__ = ["QUANTILES", "by_levels", "merge", "name", "offset", "percentiles", "sketch"]

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def sketch(df: DataFrame, values: dict[str, Column | str], groups: list[str], alpha: float = 0.005) -> DataFrame:
    """groups..., quantity, bucket, n: how many values of each quantity lie in each bucket.

    ``values`` names the quantities. Null, NaN and infinite values are left out; null
    group values are groups of their own. Counts fold on the map side, so a group that
    holds a third of all rows is shuffled as its buckets only; a group has at most
    2 ln(1.8e308 / 4.9e-324) / (2 alpha) of them, whatever its rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("quantity"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("x")) for k, v in values.items()]))
    return (
        df.select(*groups, pairs.alias("_p"))
        .select(*groups, "_p.quantity", "_p.x")
        .where(is_finite(F.col("x")))
        .groupBy(*groups, "quantity", bucket(F.col("x"), alpha).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(*sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch over ``groups`` (a subset of each sketch's) of all inputs together.

    Matching buckets' counts are added: exact, in any order and grouping.
    """
    every = sketches[0].select(*groups, "quantity", "bucket", "n")
    for s in sketches[1:]:
        every = every.unionByName(s.select(*groups, "quantity", "bucket", "n"))
    return every.groupBy(*groups, "quantity", "bucket").agg(F.sum("n").alias("n"))


def percentiles(merged: DataFrame, groups: list[str], alpha: float = 0.005, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """groups..., quantity, n, and one column ``pNN`` per quantile: values of a sketch.

    ``merged`` must hold each bucket of a group once. The q-quantile is the value of rank
    floor(q (n - 1)) + 1 in ascending order; what comes out is within ``alpha`` of that
    value, relative to it (zero exactly). A group without values gives no row.
    """
    w = Window.partitionBy(*groups, "quantity")
    ranked = merged.withColumn("_n", F.sum("n").over(w)).withColumn("_upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = [F.min(F.when(F.col("_upto") >= F.floor(F.lit(q) * (F.col("_n") - 1)) + 1, F.col("bucket"))).alias(f"_{i}") for i, q in enumerate(quantiles)]
    out = ranked.groupBy(*groups, "quantity").agg(F.max("_n").alias("n"), *at)
    return out.select(*groups, "quantity", "n", *[representative(F.col(f"_{i}"), alpha).alias(name(q)) for i, q in enumerate(quantiles)])


def name(q: float) -> str:
    """Column name of a quantile: p01, p50, p99_9."""
    whole, _, part = f"{100 * q:.10g}".partition(".")
    return f"p{whole:0>2}" + (f"_{part}" if part else "")


def by_levels(sketch_: DataFrame, levels: dict[str, list[str]], alpha: float = 0.005, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Percentiles at several levels of grouping from one sketch.

    Columns: level, the union of all levels' group columns (null where a level doesn't
    use them), quantity, n, percentiles, error_bound.
    """
    every = list(dict.fromkeys(g for gs in levels.values() for g in gs))
    kinds = {f.name: f.dataType for f in sketch_.schema.fields}
    out = None
    for level, gs in levels.items():
        p = percentiles(merge(sketch_, groups=gs), gs, alpha, quantiles)
        p = p.select(F.lit(level).alias("level"), *[F.col(g) if g in gs else F.lit(None).cast(kinds[g]).alias(g) for g in every], *[c for c in p.columns if c not in gs], F.lit(alpha).alias("error_bound"))
        out = p if out is None else out.unionByName(p)
    return out
