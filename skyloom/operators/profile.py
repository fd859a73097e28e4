"""Column profiles of large tables, from file footers first and a scan for the rest.

``footer_chunks`` reads the footers (and, for dictionary-encoded columns, the page
headers and dictionary pages) of all files, distributed over the executors.
``footer_profile`` takes nulls, extrema and distinct values of a load from there where
they are sufficient, and scans the other files only. ``profile`` scans for what breaks
the rules and takes distinct values from ``footer_profile``. ``load_changes`` compares each
load's shape with the other loads.
"""

from __future__ import annotations


from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.logbuckets import bucket, is_finite
from skyloom.session import checkpointed

CHUNK = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("row_group", T.IntegerType()),
        T.StructField("load_min", T.LongType()),
        T.StructField("load_max", T.LongType()),
        T.StructField("load_nulls", T.LongType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_null", T.LongType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("exact", T.BooleanType()),
        T.StructField("distinct", T.ArrayType(T.DoubleType())),
    ]
)


def footer_chunks(spark: SparkSession, files: list[str], columns: list[str], load: str = "load_id", dictionaries: str = "all") -> DataFrame:
    """One row per file, row group and column, from footers and dictionary pages.

    ``n_null``, ``min``, ``max`` are null where the footer doesn't have them.
    ``distinct`` holds the values of the chunk's dictionary if every data page of the
    chunk uses it, else null. ``exact`` is true if the footer's figures can stand for
    the chunk: null count present, extrema present and finite or all values null, and,
    for floating columns, no NaN possible, which only a complete dictionary shows
    (writers leave NaN out of extrema). A file without a wanted column gives no row
    for it. dictionaries: ``all``, or ``constant`` for those of chunks with equal extrema.
    """
    cols = list(columns)

    def read(batches):
        import pandas as pd

        from skyloom.sources.parquet_pages import chunk_facts

        for b in batches:
            rows = [r for p in b["path"] for r in chunk_facts(p, cols, load, dictionaries)]
            yield pd.DataFrame(rows, columns=CHUNK.names)

    n = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(n)
    return paths.mapInPandas(read, CHUNK)


@dataclass
class Rule:
    """What a column's values may be.

    holds: is a non-null value possible (null counts as yes);
    expected: the value that follows from other columns of the row, if one does;
    tolerance: relative and absolute difference from it that rounding explains;
    discrete: values are codes (compared one by one) rather than measurements;
    decimals: numbers of decimal places at which a loss of precision is looked for;
    bits: of that many lowest bits, the share set is compared;
    alone: no expression of the rule uses another column;
    extra: more traits by name, as boolean columns.
    """

    holds: Column
    expected: Column | None = None
    tolerance: float = 1e-6
    discrete: bool = False
    decimals: tuple[int, ...] = (0, 1, 2, 3, 4)
    bits: int = 0
    alone: bool = False
    extra: dict[str, Column] = field(default_factory=dict)


def profile(spark: SparkSession, df: DataFrame, rules: dict[str, Rule], load: str = "load_id", distinct: bool = True) -> DataFrame:
    """load, column_name, n_rows, n_null, null_rate, n_nan, min, max, n_broken, n_distinct.

    ``df`` must be a plain parquet scan. min and max are over values that are not NaN
    (infinities count); both null where a load has no such value. n_broken counts
    values that break the column's rule. n_distinct, unless ``distinct`` is false, is the exact
    number of values that are neither null nor NaN, from ``footer_profile``. All else
    comes from a scan, for which a rule over other columns needs the rows.
    A null load is a load of its own; an empty table gives no row.
    """
    parts = []
    for c, rule in rules.items():
        v = F.col(c).cast("double")
        ok = v.isNotNull() & ~F.isnan(v)
        parts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.when(ok, v).alias("v"),
                F.col(c).isNull().cast("long").alias("null"),
                F.coalesce(F.isnan(v), F.lit(False)).cast("long").alias("nan"),
                (F.col(c).isNotNull() & (~F.coalesce(rule.holds, F.lit(True)) | F.isnan(v))).cast("long").alias("broken"),
            )
        )
    long = df.select(F.col(load), F.explode(F.array(*parts)).alias("x")).select(load, "x.*")
    out = long.groupBy(load, "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("null").alias("n_null"),
        F.sum("nan").alias("n_nan"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.sum("broken").alias("n_broken"),
    ).withColumn("null_rate", F.col("n_null") / F.col("n_rows"))
    if not distinct:
        return out
    of = footer_profile(spark, df, list(rules), load).select(F.col(load).alias("_load"), F.col("column_name").alias("_column"), "n_distinct")
    return out.join(of, F.col(load).eqNullSafe(F.col("_load")) & (F.col("column_name") == F.col("_column")), "left").drop("_load", "_column")


def footer_profile(spark: SparkSession, df: DataFrame, columns: list[str], load: str = "load_id") -> DataFrame:
    """load, column_name, n_rows, n_null, min, max, n_distinct, scanned_share.

    Figures over the values that are neither null nor NaN. Chunks of one load with exact
    footers and complete dictionaries are taken from there; all other files are scanned,
    for just the columns in question. n_distinct is exact: the union of the load's
    dictionaries and of the values scanned. scanned_share is the share of the load's
    rows that had to be read.
    """
    files = list(df.inputFiles())
    if not files:
        return spark.createDataFrame([], f"{load} bigint, column_name string, n_rows bigint, n_null bigint, min double, max double, n_distinct bigint, scanned_share double")
    chunks = checkpointed(footer_chunks(spark, files, columns, load))
    complete = F.col("distinct").isNotNull() | (F.col("n_null") == F.col("n_rows"))
    good = F.col("exact") & complete & (F.col("load_min") == F.col("load_max")) & (F.col("load_nulls") == 0)
    per_file = chunks.groupBy("path", "column_name").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
    settled = chunks.join(per_file.where("good").drop("good"), ["path", "column_name"]).withColumn(load, F.col("load_min"))
    # Values with the rows that were scanned for them: none for those of dictionaries.
    values = [settled.select(load, "column_name", F.explode("distinct").alias("v"), F.lit(0).cast("long").alias("n"))]
    for c in columns:
        # As many names as the table has files of this kind; the listing holds them already.
        todo = [r["path"] for r in per_file.where((~F.col("good")) & (F.col("column_name") == c)).select("path").toLocalIterator()]
        if not todo:
            continue
        s = spark.read.schema(T.StructType([f for f in df.schema.fields if f.name in {c, load}])).parquet(*todo)
        values.append(s.groupBy(load, F.col(c).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).select(load, F.lit(c).alias("column_name"), "v", "n"))
    every = values[0]
    for x in values[1:]:
        every = every.unionByName(x)
    v, n = F.col("v"), F.col("n")
    ok = v.isNotNull() & ~F.isnan(v)
    # Equal values of dictionaries and scans fold into one before they are counted.
    seen = (
        every.groupBy(load, "column_name", "v")
        .agg(F.sum("n").alias("n"))
        .groupBy(load, "column_name")
        .agg(F.sum(n).alias("n_rows"), F.sum(F.when(v.isNull(), n).otherwise(0)).alias("n_null"), F.min(F.when(ok, v)).alias("min"), F.max(F.when(ok, v)).alias("max"), F.count_if(ok).alias("n_distinct"), F.sum(n).alias("read"))
    )
    zero = F.lit(0).cast("long")
    both = seen.unionByName(settled.select(load, "column_name", "n_rows", "n_null", "min", "max", zero.alias("n_distinct"), zero.alias("read")))
    return (
        both.groupBy(load, "column_name")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n_distinct").alias("n_distinct"), F.sum("read").alias("read"))
        .select(load, "column_name", "n_rows", "n_null", "min", "max", "n_distinct", (F.col("read") / F.col("n_rows")).alias("scanned_share"))
    )


#: Stands for a null load, which is a load of its own, where rows are joined by load.
NO_LOAD = -(1 << 63)


def written_by_load(df: DataFrame, at: str, load: str = "load_id", files: int | None = None) -> DataFrame:
    """``df`` written to the parquet folder ``at`` in the order of loads, and read back.

    Files hold ranges of loads, large loads several files, so the row groups of all files but
    those at the bounds are of one load, which is what ``footer_profile`` can take
    from footers and dictionaries.
    """
    spark = df.sparkSession
    n = files or spark.sparkContext.defaultParallelism * 4
    df.repartitionByRange(n, F.col(load), F.rand(7)).sortWithinPartitions(load).write.parquet(at)
    return spark.read.parquet(at)


def _trait_names(rule: Rule) -> list[str]:
    """The traits of a column in the order of their bits in a mask (62 at most)."""
    names = ["null", "not_finite", "impossible", "negative", "zero"]
    names += ["not_as_expected"] * (rule.expected is not None)
    names += [] if rule.discrete else [f"rounded_{k}" for k in rule.decimals]
    return names + list(rule.extra) + [f"bit_{b}" for b in range(rule.bits)]


def _basics(c: str, rule: Rule) -> list[Column]:
    """What the traits of column c are made of, computed once per row."""
    v = F.col(c).cast("double")
    out = [v.alias(f"v_{c}"), F.coalesce(is_finite(v), F.lit(False)).alias(f"f_{c}"), F.coalesce(rule.holds, F.lit(True)).alias(f"h_{c}")]
    if rule.expected is not None:
        out.append(F.coalesce(is_finite(rule.expected) & (F.abs(v - rule.expected) > rule.tolerance * (1 + F.abs(rule.expected))), F.lit(False)).alias(f"e_{c}"))
    return out + [F.coalesce(x, F.lit(False)).alias(f"x_{c}_{i}") for i, x in enumerate(rule.extra.values())]


def _cell(c: str, rule: Rule, alpha: float, max_shape: int) -> Column:
    """column_name, key (bucket of the value; null for null) and mask (traits) of a row."""
    v, fin = F.col(f"v_{c}"), F.col(f"f_{c}")
    shape = F.pmod(F.hash(v.cast("long")), F.lit(max_shape)) if rule.discrete else bucket(v, alpha)
    key = F.when(fin, shape).when(v.isNotNull(), F.lit(2_000_000_000))
    traits = [v.isNull(), v.isNotNull() & ~fin, fin & ~F.col(f"h_{c}"), fin & (v < 0), fin & (v == 0)]
    traits += [fin & F.col(f"e_{c}")] * (rule.expected is not None)
    if not rule.discrete:
        for k in rule.decimals:
            # Too small or large for that many places: rounding would say nothing.
            scaled = v * 10.0**k
            traits.append(fin & (F.abs(scaled) > 1) & (F.abs(scaled) < 1e13) & (F.abs(scaled - F.rint(scaled)) < F.lit(1e-12) * F.abs(scaled)))
    traits += [F.col(f"x_{c}_{i}") for i in range(len(rule.extra))]
    mask = F.lit(0).cast("long")
    for i, t in enumerate(traits):
        mask = mask + F.coalesce(t, F.lit(False)).cast("long") * F.lit(1 << i).cast("long")
    if rule.bits:
        mask = mask + F.when(fin & (v >= 0) & (v < 2.0**62), F.shiftleft(v.cast("long").bitwiseAND(F.lit((1 << rule.bits) - 1).cast("long")), len(traits))).otherwise(F.lit(0).cast("long"))
    return F.struct(F.lit(c).alias("column_name"), key.cast("int").alias("key"), mask.alias("mask"))


def _cells(spark: SparkSession, df: DataFrame, rules: dict[str, Rule], load: str, alpha: float, max_shape: int) -> DataFrame:
    """load, column_name, key, mask, n: counts of equal cells, from footers where they do.

    A chunk of one load whose footer proves it all null, or constant under a rule that
    stands alone, is one cell known from there. A file is scanned for the columns of
    which it has any other chunk.
    """
    cols = list(rules)
    files = list(df.inputFiles())
    facts = checkpointed(footer_chunks(spark, files, cols, load, "constant")) if files else spark.createDataFrame([], CHUNK)
    alone = [c for c in cols if rules[c].alone]
    empty = F.col("n_null") == F.col("n_rows")
    constant = F.col("column_name").isin(*alone) & F.col("exact") & (F.col("min") == F.col("max")) if alone else F.lit(False)
    settled = (F.col("load_min") == F.col("load_max")) & (F.col("load_nulls") == 0) & (empty | constant)
    per = facts.groupBy("path", "column_name").agg(F.bool_and(F.coalesce(settled, F.lit(False))).alias("settled"))
    parts, known = [], {}
    for r in per.where("settled").select("path", "column_name").toLocalIterator():
        known.setdefault(r["path"], set()).add(r["column_name"])
    by_open: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        by_open.setdefault(tuple(c for c in cols if c not in known.get(f, ())), []).append(f)
    for open_cols, fs in by_open.items():
        if not open_cols:
            continue
        scan = df if len(fs) == len(files) else spark.read.schema(df.schema).parquet(*fs)
        # A scan per column reads that column only and keeps generated methods small
        # enough for the JVM to compile; one scan of all columns was three times slower.
        for c in open_cols:
            of = F.coalesce(F.col(load).cast("long"), F.lit(NO_LOAD)).alias(load)
            base = scan.select(of, *_basics(c, rules[c])).select(load, _cell(c, rules[c], alpha, max_shape).alias("x"))
            parts.append(base.groupBy(load, "x.column_name", "x.key", "x.mask").agg(F.count(F.lit(1)).alias("n")))
    if known:
        mine = facts.join(per.where("settled").drop("settled"), ["path", "column_name"]).withColumn(load, F.col("load_min"))
        for c in sorted(set().union(*known.values())):
            of = mine.where(F.col("column_name") == c)
            kind = df.schema[c].dataType
            both = [of.select(load, F.lit(None).cast(kind).alias(c), F.col("n_null").alias("n"))]
            if rules[c].alone:
                both.append(of.where(~empty).select(load, F.col("min").cast(kind).alias(c), (F.col("n_rows") - F.col("n_null")).alias("n")))
            for x in both:
                if rules[c].alone:
                    x = x.select(load, "n", *_basics(c, rules[c]))
                    cell = _cell(c, rules[c], alpha, max_shape)
                else:  # all null: the first trait and no bucket
                    cell = F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("int").alias("key"), F.lit(1).cast("long").alias("mask"))
                parts.append(x.where("n > 0").select(load, cell.alias("x"), "n").groupBy(load, "x.column_name", "x.key", "x.mask").agg(F.sum("n").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else out.groupBy(load, "column_name", "key", "mask").agg(F.sum("n").alias("n"))


def load_changes(df: DataFrame, rules: dict[str, Rule], load: str = "load_id", *, alpha: float = 0.05, max_shape: int = 4096) -> DataFrame:
    """load, column_name, trait, n_rows, share, usual, excess, noise.

    For each load and column: the share of rows with each trait (missing, not finite,
    impossible, negative, zero, rounded to k decimals, not what other columns say,
    bits set), the median share of all loads, the excess over it, and the noise to be
    expected of the excess (1.4826 times the median absolute deviation of the loads,
    and at least the binomial deviation). The trait ``shape`` is the total variation
    between the load's distribution and that of all loads pooled by their median,
    over signed logarithmic buckets of relative width ``2 alpha`` (measurements) or
    values (codes, hashed into ``max_shape`` classes).

    ``df`` must be a plain parquet scan. Its footers come first (``_cells``); in what is
    scanned, rows fold into (load, column, bucket, traits) counts on the map side, so
    what is shuffled grows with loads times buckets, not with rows. A null load is
    a load of its own. An empty table gives no row.
    """
    spark = df.sparkSession
    names = {c: _trait_names(r) for c, r in rules.items()}
    counts = checkpointed(_cells(spark, df, rules, load, alpha, max_shape))
    sizes = counts.groupBy(load, "column_name").agg(F.sum("n").alias("n_rows"))
    known = F.create_map(*[x for c, ts in names.items() for x in (F.lit(c), F.array(*[F.lit(t) for t in ts]))])
    traits = (
        counts.select(load, "column_name", "mask", "n", F.posexplode(known[F.col("column_name")]).alias("i", "trait"))
        .groupBy(load, "column_name", "trait")
        .agg(F.sum(F.when(F.expr("shiftright(mask, i) & 1") == 1, F.col("n")).otherwise(0)).alias("k"))
    )
    by_trait = traits.join(sizes, [load, "column_name"]).select(load, "column_name", "trait", "n_rows", (F.col("k") / F.col("n_rows")).alias("share"))
    # Shape: half the summed differences of bucket shares from the loads' median share.
    loads = sizes.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_loads"))
    cell = counts.where(F.col("key").isNotNull()).groupBy(load, "column_name", "key").agg(F.sum("n").alias("k"))
    filled = counts.where(F.col("key").isNotNull()).groupBy(load, "column_name").agg(F.sum("n").alias("filled"))
    share = cell.join(filled, [load, "column_name"]).select(load, "column_name", "key", (F.col("k") / F.col("filled")).alias("p"))
    usual = (
        share.groupBy("column_name", "key")
        .agg(F.sort_array(F.collect_list("p")).alias("ps"))
        .join(loads, "column_name")
        # Loads without the bucket count as 0: the median of all is at this place of the present ones.
        .select("column_name", "key", F.coalesce(F.try_element_at("ps", (F.size("ps") - F.floor(F.col("n_loads") / 2)).cast("int")), F.lit(0.0)).alias("u"), (F.size("ps") > F.col("n_loads") / 2).alias("common"))
        .where("common")
        .select("column_name", "key", "u")
    )
    shape = (
        share.join(usual, ["column_name", "key"], "left")
        .groupBy(load, "column_name")
        .agg(F.sum(F.greatest(F.col("p") - F.coalesce("u", F.lit(0.0)), F.lit(0.0))).alias("share"))
        .join(sizes, [load, "column_name"])
        .select(load, "column_name", F.lit("shape").alias("trait"), "n_rows", "share")
    )
    every = by_trait.unionByName(shape)
    med = every.groupBy("column_name", "trait").agg(F.median("share").alias("usual"))
    dev = every.join(med, ["column_name", "trait"])
    mad = dev.groupBy("column_name", "trait").agg((F.median(F.abs(F.col("share") - F.col("usual"))) * 1.4826).alias("mad"))
    return dev.join(mad, ["column_name", "trait"]).select(
        F.nullif(F.col(load), F.lit(NO_LOAD)).alias(load),
        "column_name",
        "trait",
        "n_rows",
        "share",
        "usual",
        (F.col("share") - F.col("usual")).alias("excess"),
        F.greatest(F.col("mad"), F.sqrt(F.greatest(F.col("usual") * (1 - F.col("usual")), 1 / F.col("n_rows")) / F.col("n_rows"))).alias("noise"),
    )


def gone_wrong(changes: DataFrame, load: str = "load_id", *, least: float = 0.04, shape_least: float = 0.06, times_noise: float = 6.0) -> DataFrame:
    """The loads and columns with a trait in excess of the usual share. Null is no load here.

    A trait counts if its excess is at least ``least`` of the load's rows (``shape``:
    ``shape_least``) and at least ``times_noise`` times the noise.
    """
    need = F.when(F.col("trait") == "shape", F.lit(shape_least)).otherwise(F.lit(least))
    return changes.where(F.col(load).isNotNull() & (F.col("excess") >= need) & (F.col("excess") >= times_noise * F.col("noise"))).select(load, "column_name").distinct()


# Wavelength bounds of the bands in micrometres.
BAND_BOUNDS = {"D1": (0.7455, 1.1167), "D2": (1.1033, 1.6499), "D3": (1.6301, 2.4346), "D4": (2.4027, 3.8473), "D5": (3.8113, 4.43), "D6": (4.4115, 5.0096)}


def lightcurve_rules(slack: float = 0.02) -> dict[str, Rule]:
    """Rules of the light-curve columns that are profiled.

    mag_ab: between -5 and 40, and 23.9 - 2.5 log10(flux) where flux is positive;
    flag: between 0 and 2^22 - 1; wavelength: within its band's bounds, ``slack``
    micrometres wider; snr: flux / flux_error where the error is positive.
    """
    flux, err, wl = F.col("flux"), F.col("flux_error"), F.col("wavelength")
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for b, (x, y) in BAND_BOUNDS.items():
        lo = F.when(F.col("band") == b, F.lit(x - slack)).otherwise(lo)
        hi = F.when(F.col("band") == b, F.lit(y + slack)).otherwise(hi)
    lo, hi = F.coalesce(lo, F.lit(0.7)), F.coalesce(hi, F.lit(5.1))
    return {
        "mag_ab": Rule(F.col("mag_ab").between(-5.0, 40.0), expected=F.when(is_finite(flux) & (flux > 0), 23.9 - 2.5 * F.log10(flux))),
        "flag": Rule(F.col("flag").between(0, (1 << 22) - 1), discrete=True, bits=22, alone=True),
        "wavelength": Rule(wl.between(lo, hi)),
        "snr": Rule(is_finite(F.col("snr")), expected=F.when(is_finite(flux) & is_finite(err) & (err > 0), F.try_divide(flux, err))),
    }
