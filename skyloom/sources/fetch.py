"""Fetching image files into a folder of bands, distributed over the executors."""

from __future__ import annotations

import os
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.plans.config import DownloadConfig

RESULT = T.StructType([T.StructField("url", T.StringType()), T.StructField("local_path", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error_text", T.StringType()), T.StructField("size_mb", T.DoubleType())])
Opener = Callable[[str, DownloadConfig], object]


def open_url(url: str, cfg: DownloadConfig):
    """A response that reads like a file and may have a Content-Length; http and file URLs."""
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": cfg.user_agent}), timeout=cfg.timeout)


def fetch_one(url: str, path: str, cfg: DownloadConfig, opener: Opener = open_url, sleep=time.sleep) -> tuple[bool, str | None, float | None]:
    """success, error, size in MB. Written aside and renamed when complete, tried again
    with growing delays; what is left of a failed attempt is removed."""
    part = f"{path}.{os.getpid()}.part"
    error = None
    for attempt in range(cfg.max_retries + 1):
        if attempt:
            sleep(cfg.retry_delay * 2 ** (attempt - 1))
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with opener(url, cfg) as r, open(part, "wb") as out:
                expected = r.headers.get("Content-Length") if getattr(r, "headers", None) else None
                n = 0
                while chunk := r.read(cfg.chunk_size):
                    out.write(chunk)
                    n += len(chunk)
            if expected is not None and int(expected) != n:
                raise OSError(f"{n} of {expected} bytes")
            os.replace(part, path)
            return True, None, n / 1024**2
        except (OSError, ValueError) as e:
            error = str(e)
            if os.path.exists(part):
                os.remove(part)
    return False, error, None


def fetch(observations: DataFrame, directory: str, cfg: DownloadConfig | None = None, *, skip_existing: bool = True, opener: Opener = open_url) -> DataFrame:
    """One ``RESULT`` row per distinct (band, obs_id, download_url) of ``observations``.

    Files go to directory/band/obs_id.fits; ``directory`` must be mounted on all executors.
    Existing files count as successes if ``skip_existing``. As many tasks run as
    ``cfg.max_download_workers``. Rows with a null among the three are left out.
    """
    cfg = cfg or DownloadConfig()
    want = observations.select("band", "obs_id", "download_url").where("band IS NOT NULL AND obs_id IS NOT NULL AND download_url IS NOT NULL").distinct()
    jobs = want.repartition(cfg.max_download_workers).select(F.col("download_url").alias("url"), F.concat(F.lit(directory.rstrip("/") + "/"), "band", F.lit("/"), "obs_id", F.lit(".fits")).alias("path"))

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for url, path in zip(b["url"], b["path"]):
                if skip_existing and os.path.exists(path):
                    rows.append((url, path, True, None, os.path.getsize(path) / 1024**2))
                else:
                    rows.append((url, path, *fetch_one(url, path, cfg, opener)))
            yield pd.DataFrame(rows, columns=RESULT.names)

    return jobs.mapInPandas(run, RESULT)
