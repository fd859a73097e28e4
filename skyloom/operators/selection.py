"""Exact order statistics of groups of any size, without gathering a group.

Counts in logarithmic buckets tell in which bucket a rank lies. A bucket that still holds
many rows is cut into 4096 even parts between its ends, as often as need be; only values of
small buckets are then counted one by one. All steps fold on the map side, so neither a
large group nor a value that repeats endlessly ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.logbuckets import bucket, is_finite
from skyloom.session import bounded_broadcast, checkpointed


def _same(part: list[str]):
    out = F.lit(True)
    for c in part:
        out = out & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out


def _values_at(v: DataFrame, part: list[str], counts: DataFrame, ranks: DataFrame, keys: list[str], most: int) -> list[DataFrame]:
    """keys..., q, side, f, n, v: the values at ``ranks`` (keys, q, side, f, n, part as _k_..., r) of ``v``.

    ``v``: part..., _b, _v, a row per value; ``counts``: its rows _c by part and _b.
    """
    w = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_c").over(w))
    rank = [f"_g_{c}" for c in keys] + ["_q", "_side", "_f", "_n"]
    wanted = (
        upto.join(ranks, _same(part) & (F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
        .select(*rank, *[F.col(c).alias(f"_k_{c}") for c in part], F.col("_b").alias("_k__b"), "_c", (F.col("_r") - (F.col("_upto") - F.col("_c"))).alias("_r"))
    )
    cell = [*part, "_b"]
    few = wanted.where(F.col("_c") <= most).drop("_c")
    inside = v.join(few.select(*[f"_k_{c}" for c in cell]).distinct(), _same(cell), "left_semi").groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ordered = inside.withColumn("_end", F.sum("_c").over(Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = ordered.join(few, _same(cell) & (F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_c"))).select(*rank, F.col("_v"))
    # Full buckets are few: there are at most rows over ``most`` of them.
    full = counts.where(F.col("_c") > most).limit(1)
    if full.isEmpty():
        return [found]
    many = checkpointed(wanted.where(F.col("_c") > most).drop("_c"))
    if many.isEmpty():
        return [found]
    hit = bounded_broadcast(many.select(*[f"_k_{c}" for c in cell]).distinct())
    rows = v.join(hit, _same(cell), "left_semi")
    ends = checkpointed(rows.groupBy(*cell).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * 4096), F.lit(4095))).otherwise(F.lit(0)).cast("int")
    level = f"_b{len(part)}"
    deeper = [*part, level]
    named = ends.select(*[F.col(c).alias(f"_k_{c}") for c in cell], "_lo", "_hi")
    finer = rows.join(bounded_broadcast(named), _same(cell)).select(*part, F.col("_b").alias(level), "_v", at.alias("_b"), "_lo", "_hi")
    again = checkpointed(finer.groupBy(*deeper, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")))
    ranks = many.withColumnRenamed("_k__b", f"_k_{level}")
    # A bucket of one value is settled, however many rows it has.
    one = again.where("_lo = _hi").join(ranks, _same(deeper)).select(*rank, F.col("_lo").alias("_v"))
    return [found, one, *_values_at(finer.where("_lo < _hi").select(*deeper, "_b", "_v"), deeper, again.where("_lo < _hi").select(*deeper, "_b", "_c"), ranks, keys, most)]


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], alpha: float = 0.002, most: int = 1_000_000) -> DataFrame:
    """keys..., n long, and a double per entry of ``quantiles`` (name -> fraction).

    Linear interpolation between order statistics (rank (n - 1) q counted from 0). Null, NaN
    and infinite values are left out; groups without another value give no row. Null
    keys are groups of their own. Buckets of more than ``most`` rows are cut finer.
    """
    part = keys or ["_all"]
    v = df.where(is_finite(F.col(value))).select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v"))
    v = v.withColumn("_b", bucket(F.col("_v"), alpha))
    counts = checkpointed(v.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_c")))
    ranks = []
    for name, q in quantiles.items():
        r = F.lit(q) * (F.col("_n") - 1)
        ranks += [F.struct(F.lit(name).alias("_q"), F.lit(side).alias("_side"), (r - F.floor(r)).alias("_f"), k.cast("long").alias("_r")) for side, k in ((0, F.floor(r)), (1, F.ceil(r)))]
    sizes = counts.groupBy(*part).agg(F.sum("_c").alias("_n"))
    asked = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in part], *[F.col(c).alias(f"_k_{c}") for c in part], "_n", F.explode(F.array(*ranks)).alias("_x")).select("*", "_x.*").drop("_x")
    found = _values_at(v, part, counts, asked, part, most)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    out = []
    for name in quantiles:
        lo = F.max(F.when((F.col("_q") == name) & (F.col("_side") == 0), F.col("_v")))
        hi = F.max(F.when((F.col("_q") == name) & (F.col("_side") == 1), F.col("_v")))
        f = F.max(F.when(F.col("_q") == name, F.col("_f")))
        out.append((lo + (hi - lo) * f).alias(name))
    got = every.groupBy(*[f"_g_{c}" for c in part]).agg(F.max("_n").alias("n"), *out)
    return got.select(*[F.col(f"_g_{c}").alias(c) for c in keys], "n", *quantiles)
