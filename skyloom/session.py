"""Session building and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every session of this engine wants; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_RUNS: list[str] = []


def build_session(app: str = "skyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, local runs) a folder of our own is made and
    set. The context's checkpoint directory is pointed there too, so that
    ``DataFrame.checkpoint()`` writes to the same place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder path for one run below the shared folder."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _RUNS.append(at)
    return at


def runs_made() -> int:
    return len(_RUNS)


def clear_runs(spark: SparkSession, since: int = 0) -> int:
    """Delete the folders made by ``run_dir`` so far, or ``since`` there were so many (``runs_made``).

    Results that read them must be done with.
    """
    n = 0
    while len(_RUNS) > since:
        fs, path = hadoop(spark, _RUNS.pop())
        n += fs.delete(path, True)
    return n


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    That cuts its lineage (the files outlive lost executors) and tells the planner its
    true size.
    """
    at = run_dir(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes a row takes in memory, about: fixed widths, and the lengths of texts and arrays."""
    total = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            total = total + 8 * (len(f.dataType.fields) if isinstance(f.dataType, T.StructType) else 1)
    return total


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``max_rows`` rows of ``max_bytes`` together.

    ``df`` should be cheap to run again or already materialised. Above a limit
    it is returned unmarked and Catalyst plans a shuffled join, which AQE splits
    where keys are skewed.
    """
    few = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if few["n"] <= max_rows and few["b"] <= max_bytes else df


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI or path, None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def hadoop(spark: SparkSession, uri: str):
    """(file system, path) of the JVM for a URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per context.

    Functions defined here are pickled by reference. On a cluster the workers may not
    have the package on their path, so a zip of its sources goes along with
    the context; Spark sends it to executors that join later as well.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_skyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="skyloom-src-")) / "skyloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("skyloom") / p.relative_to(root))
    sc.addPyFile(str(at))
    sc._skyloom_shipped = True


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    fs, path = hadoop(spark, uri)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, uri: str) -> str | None:
    """The content of a file, None without one."""
    fs, path = hadoop(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
