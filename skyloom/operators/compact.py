"""Consolidating a landing directory of tiny files into few sorted, well-sized ones.

Records are parsed from the files' lines, reduced to one row per record key (partial
aggregation first, so a record that a third of all lines repeat is no hot spot),
range-partitioned by the clustering keys over sampled boundaries, and written sorted
into a staging folder. Only when the counts read back from there, and the lines that were
rejected, agree with a count of the payloads' lines is the staging folder swapped in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.session import checkpointed, hadoop, run_dir

RECORD = T.StructType(
    [
        T.StructField("obs_id", T.StringType()),
        T.StructField("band", T.StringType()),
        T.StructField("mjd", T.DoubleType()),
        T.StructField("wavelength_min", T.DoubleType()),
        T.StructField("wavelength_max", T.DoubleType()),
        T.StructField("download_url", T.StringType()),
        T.StructField("t_min", T.DoubleType()),
        T.StructField("t_max", T.DoubleType()),
    ]
)
KEYS = ("obs_id", "band", "proc_version")


def proc_version(url: Column) -> Column:
    """The directory of a download URL that begins with ``pv``; null without one."""
    return F.nullif(F.regexp_extract(url, r"/(pv[^/]*)/", 1), F.lit(""))


# Blanks at the ends of a line, a byte order mark among them.
BLANK = r"\s\uFEFF"


def lines(files: DataFrame) -> DataFrame:
    """One row per non-blank line of ``payload``, blanks at its ends cut off."""
    return (
        files.select(F.explode(F.split("payload", r"\r\n|\n|\r")).alias("line"))
        .select(F.regexp_replace("line", rf"^[{BLANK}]+|[{BLANK}]+$", "").alias("line"))
        .where(F.length("line") > 0)
    )


def count_lines(files: DataFrame) -> int:
    """The non-blank lines of all payloads, counted in the payloads and not by ``lines``."""
    n = files.agg(F.sum(F.regexp_count("payload", F.lit(rf"[^{BLANK}][^\r\n]*")))).first()[0]
    return int(n or 0)


# Text that JSON readers accept by default but that is no JSON.
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false", "maxNestingDepth": "2000"}


def parsed(files: DataFrame) -> DataFrame:
    """One row per non-blank line of ``files``: the fields of ``RECORD``, proc_version, and rejected.

    A complete line is one JSON object, nested however deep (2,000 levels). ``rejected`` is null for
    those and the line itself for all others: lines that break off, other text, several
    objects, JSON that isn't an object. obs_id is trimmed and in upper case, band trimmed; a
    number may be quoted, and is null if it can't be read as one. Null payloads and
    files without a line give nothing. Other columns of ``files`` are ignored.
    """
    # Readers stop after the first value and pass over the rest. As the first of two
    # elements whose second is the line's own hash, a line is read to its end or not at all.
    mark = F.xxhash64("line").cast("string")
    text = T.ArrayType(T.StructType([*[T.StructField(f.name, T.StringType()) for f in RECORD.fields], T.StructField("_end", T.StringType())]))
    pair = F.concat(F.lit("["), F.col("line"), F.lit(',{"_end":"'), mark, F.lit('"}]'))
    r = lines(files).select("line", mark.alias("mark"), F.when(F.col("line").startswith("{"), F.from_json(pair, text, STRICT)).alias("r"))
    whole = F.coalesce((F.size("r") == 2) & (F.col("r")[1]["_end"] == F.col("mark")) & F.col("r")[0].isNotNull(), F.lit(False))
    return (
        r.select(F.when(~whole, F.col("line")).alias("rejected"), F.when(whole, F.col("r")[0]).alias("r"))
        .select(*[F.col(f"r.{f.name}").try_cast(f.dataType).alias(f.name) for f in RECORD.fields], "rejected")
        .withColumn("obs_id", F.upper(F.trim("obs_id")))
        .withColumn("band", F.trim("band"))
        .withColumn("proc_version", proc_version(F.col("download_url")))
    )


def records(files: DataFrame) -> DataFrame:
    """The complete lines of ``files`` as records (see ``parsed``)."""
    return parsed(files).where(F.col("rejected").isNull()).drop("rejected")


def distinct_records(recs: DataFrame) -> DataFrame:
    """One row per (obs_id, band, proc_version) with ``n_lines``, the lines that hold it.

    Of lines that differ in other fields one is kept whole: that with the fewest nulls, then the
    smallest by its fields in order. ``n_variants`` counts the different ones. Null
    keys are equal to each other: such records are kept, not lost.
    """
    rest = [f.name for f in RECORD.fields if f.name not in KEYS]
    nulls = sum((F.col(c).isNull().cast("int") for c in rest), F.lit(0))
    each = recs.groupBy(*KEYS, *rest).agg(F.count(F.lit(1)).alias("n"))  # copies fold on the map side
    one = each.groupBy(*KEYS).agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_variants"), F.min(F.struct(nulls.alias("nulls"), *rest)).alias("r"))
    return one.select(*KEYS, "n_lines", "n_variants", *[F.col(f"r.{c}").alias(c) for c in rest])


def compact(files: DataFrame, target: str, *, target_bytes: int = 128 << 20, keys: tuple[str, ...] = ("obs_id", "band", "proc_version"), rejects: str | None = None) -> dict:
    """Write the records of ``files`` to the parquet folder ``target``; returns counts.

    The number of files is the size of the distinct records, as first written, over
    ``target_bytes``, one at least; each holds one range of ``keys`` in order. An existing
    ``target`` is replaced only after the new files were read back and hold every
    complete line exactly once under keys that don't repeat, and complete and rejected lines
    together are as many as the payloads have (``count_lines``); otherwise RuntimeError is
    raised and ``target`` stays as it was. Lines that hold no record go to the parquet
    folder ``rejects`` (column ``line``), if one is named, and are counted anyhow. An empty
    input gives one empty file. One run at a time may write to a ``target``; what a run that
    died between its two renames left is put back first (``recover``).
    """
    spark = files.sparkSession
    recover(spark, target)
    every = checkpointed(parsed(files))  # lines are parsed once
    bad = every.where(F.col("rejected").isNotNull()).select(F.col("rejected").alias("line"))
    n_all, n_bad = count_lines(files), bad.count()
    at = run_dir(spark, "records")
    distinct_records(every.where(F.col("rejected").isNull()).drop("rejected")).write.parquet(at)
    out = spark.read.parquet(at)
    fs, path = hadoop(spark, at)
    n_files = max(1, -(-fs.getContentSummary(path).getLength() // target_bytes)) if n_all > n_bad else 1
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    out = out.repartitionByRange(n_files, *keys) if n_files > 1 else out.coalesce(1)
    out.sortWithinPartitions(*keys).write.parquet(staging)
    back = spark.read.parquet(staging)
    got = back.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines")).first()
    twice = back.groupBy(*KEYS).count().where("count > 1").limit(1).count()
    if got["lines"] + n_bad != n_all or twice:
        fs, path = hadoop(spark, staging)
        fs.delete(path, True)
        raise RuntimeError(f"{n_all} lines in the source, {n_bad} rejected, {got['lines']} in the new files, repeated keys: {bool(twice)}")
    if rejects is not None:
        bad.write.mode("overwrite").parquet(rejects)
    swap(spark, staging, target)
    return {"lines": got["lines"], "rejects": n_bad, "records": got["rows"], "files": n_files}


def recover(spark: SparkSession, target: str) -> bool:
    """Undo what a run that ended inside ``swap`` left; true if ``target`` was put back.

    Without a ``target`` its newest ``.old-`` folder takes its place again. Beside a
    ``target`` such folders were replaced already and are deleted.
    """
    fs, at = hadoop(spark, target)
    old = sorted(fs.globStatus(hadoop(spark, f"{target.rstrip('/')}.old-*")[1]) or [], key=lambda s: s.getModificationTime())
    back = bool(old) and not fs.exists(at)
    if back and not fs.rename(old.pop().getPath(), at):
        raise RuntimeError(f"can't put {target} back")
    for s in old:
        fs.delete(s.getPath(), True)
    return back


def swap(spark: SparkSession, staging: str, target: str) -> None:
    """Put folder ``staging`` in the place of ``target``; the old one goes last.

    Between the two renames there is no ``target``: readers must wait, and ``recover`` mends a death there.
    """
    fs, new = hadoop(spark, staging)
    _, at = hadoop(spark, target)
    old = None
    if fs.exists(at):
        _, old = hadoop(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
        if not fs.rename(at, old):
            raise RuntimeError(f"can't move {target} away")
    if not fs.rename(new, at):
        if old is not None:
            fs.rename(old, at)
        raise RuntimeError(f"can't move {staging} to {target}")
    if old is not None:
        fs.delete(old, True)


def repeated(compacted: DataFrame) -> DataFrame:
    """Key of each compacted record that stood in more than one complete line."""
    return compacted.where((F.col("n_lines") > 1) & F.col("obs_id").isNotNull() & F.col("band").isNotNull() & F.col("proc_version").isNotNull()).select(*KEYS)
