"""Light curves as CSV files with a commented header, and tables of comparison curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.session import hadoop

_D, _S = T.DoubleType(), T.StringType()
LIGHT_CURVE = T.StructType(
    [T.StructField(n, t) for n, t in (("obs_id", _S), ("mjd", _D), ("flux", _D), ("flux_error", _D), ("mag_ab", _D), ("mag_ab_error", _D), ("wavelength", _D), ("bandwidth", _D), ("band", _S), ("flag", T.LongType()), ("flag_binary", _S), ("pix_x", _D), ("pix_y", _D), ("is_upper_limit", T.BooleanType()), ("snr", _D))]
)
EXTERNAL = T.StructType([T.StructField(n, _D) for n in ("lambda", "flux", "flux_err", "lambda_width")])


def write_csv(curve: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One source's light curve as one CSV file in the folder ``path``, in order of mjd.

    ``metadata`` becomes ``# key: value`` lines in a file of their own that readers
    of the folder see as comments.
    """
    spark = curve.sparkSession
    curve.select(*LIGHT_CURVE.names).orderBy("mjd", "obs_id", "band").coalesce(1).write.mode("overwrite").csv(path, header=True)
    if metadata:
        fs, at = hadoop(spark, path.rstrip("/") + "/000-metadata.csv")
        out = fs.create(at, True)
        out.write(bytearray((",".join(LIGHT_CURVE.names) + "\n" + "".join(f"# {k}: {v}\n" for k, v in metadata.items())).encode()))
        out.close()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``LIGHT_CURVE`` rows of CSV files; ``#`` lines are skipped, NaN magnitudes are null."""
    df = spark.read.schema(LIGHT_CURVE).csv(path, header=True, comment="#")
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mag_ab", "mag_ab_error")})


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Curves of other origin for comparison: wavelength, flux, error, width."""
    return spark.read.schema(EXTERNAL).csv(path, header=True, comment="#")
