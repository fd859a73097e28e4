"""Streams over landing directories: new image files into measurements, deliveries into counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.plans.config import PhotometryConfig
from skyloom.sources import mef

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def measure_new_files(spark: SparkSession, directory: str, sources: DataFrame, target: str, checkpoint: str, cfg: PhotometryConfig | None = None, per_trigger: int = 64) -> StreamingQuery:
    """Photometry of image files as they land, appended to the parquet folder ``target``.

    A file is read once; after a failure the checkpoint takes up where it was. Stops when
    all files present are done.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.fits").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(directory)

    measured = mef.photometry(files, sources, cfg)
    return measured.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def arrivals(readings: DataFrame, *, late: str = "30 days", every: str = "1 day") -> DataFrame:
    """Per band and window of loading time: deliveries, each (meas_id) once.

    For streams: state is kept for ``late``; what comes later is dropped, as the
    watermark says. On a static table the same counts over all rows.
    """
    r = readings.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    if r.isStreaming:
        r = r.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["meas_id"])
    else:
        r = r.dropDuplicates(["meas_id"])
    return r.groupBy(F.window("loaded_at", every), "band").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("since"), "band", "n")
