"""Domain relations made from the test tables that aren't astronomical."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import scalars as S
from skyloom.session import table


def planes(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue planes: a footprint of ten by ten degrees for each order."""
    o = table(spark, d, "orders")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1858-11-17").cast("date")).cast("double")
    ra, dec = ((F.col("o_orderkey") * 7) % 350).cast("double"), ((F.col("o_orderkey") * 13) % 170 - 85).cast("double")
    corner = lambda r, q: F.struct(r.alias("ra"), q.alias("dec"))
    top = F.least(dec + 10, F.lit(89.5))
    return o.select(
        F.col("o_orderkey").alias("planeid"),
        F.concat(F.lit("ivo://x/qr?"), F.col("o_orderkey").cast("string"), F.lit("_"), (F.col("o_custkey") % 4).cast("string"), F.lit("/D"), (F.col("o_custkey") % 6 + 1).cast("string")).alias("obs_publisher_did"),
        days.alias("time_bounds_lower"),
        (days + 0.0013).alias("time_bounds_upper"),
        F.concat(F.lit(S.BANDPASS + "D"), (F.col("o_custkey") % 6 + 1).cast("string")).alias("energy_bandpassname"),
        F.lit(0.75e-6).alias("energy_bounds_lower"),
        F.lit(5.0e-6).alias("energy_bounds_upper"),
        F.array(corner(ra, dec), corner(ra + 10, dec), corner(ra + 10, top), corner(ra, top)).alias("poly"),
    )


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("planeid"), F.concat(F.lit("ibe/data/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"), F.lit(".fits")).alias("uri"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sky_source").select("source_id", "ra", F.col("decl").alias("dec"), F.col("source_name").alias("name"))


def pixels(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    """An 8 × 8 image from each embedding; ``broken`` puts NaN into some variances."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("pos", "v"))
    pos, k = F.col("pos"), F.col("img") + F.col("pos")
    flags = F.when((F.col("img") * 64 + pos) % 11 == 0, F.call_function("shiftleft", F.lit(1), (k % 22).cast("int"))).otherwise(0)
    variance = F.lit(0.01) + (pos % 7) * F.lit(0.001)
    px = e.select("img", F.expr("int(pos div 8)").alias("y"), (pos % 8).alias("x"), (F.lit(0.3) + F.col("v").cast("double")).alias("image"), variance.alias("variance"), (F.lit(0.05) + (pos % 8) * F.lit(0.002)).alias("zodi"), flags.alias("flags"), pos.alias("pos"))
    if broken:
        px = px.withColumn("variance", F.when((F.col("flags") != 0) & ((F.col("img") + F.col("pos")) % 3 == 0), float("nan")).otherwise(F.col("variance")))
    return px.drop("pos")


def zones(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select((F.col("n_nationkey") + 1).alias("zone_id"), (F.lit(1.0) + (F.col("n_nationkey") % 5) * 1.75).alias("xctr"), (F.lit(1.0) + F.floor(F.col("n_nationkey") / 5) * 1.75).alias("yctr"))


def cutout_texts(spark: SparkSession, d: str) -> DataFrame:
    """Cutout sizes and centers as users write them, good and bad, for each order."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    cases = [F.concat(n(500), F.lit("px")), F.concat(F.lit("0."), n(9)), F.concat(n(300), F.lit(","), n(200), F.lit("px")), F.concat(n(90), F.lit("arcmin")), F.lit("-1px"), F.lit("abc"), F.lit(None).cast("string"), F.concat(n(4000), F.lit("arcsec")), F.concat(F.lit("0.0"), n(30), F.lit("rad")), F.concat(n(7), F.lit("deg")), F.lit("")]
    places = [F.lit("70,20"), F.concat(n(400), F.lit(".5,"), n(150), F.lit("px")), F.concat(F.lit("10,"), n(120)), F.lit("10"), F.concat(F.lit("-3.5,-"), n(95), F.lit("deg"))]
    pick = lambda cs: F.element_at(F.array(*cs), (k % len(cs) + 1).cast("int"))
    return o.select(k.alias("id"), pick(cases).alias("size"), pick(places).alias("center"))
