"""The four stages as written tables with a manifest, so that a run can be taken up again."""

from __future__ import annotations

import datetime as dt
import logging
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import scalars as S
from skyloom.operators import archive, lightcurves
from skyloom.plans.config import NEEDS, AdvancedConfig
from skyloom.session import clear_runs, local_path, read_text, runs_made, ship_package, write_text
from skyloom.sources import curves, fetch, mef


log = logging.getLogger("skyloom")


class Pipeline:
    """Search, download, photometry and plot tables of one configuration.

    ``catalogue`` returns (artifact, plane) tables. Each stage writes below
    ``output_dir``: ``results/<table>`` as parquet, images to ``data``, the manifest
    ``state.yaml`` (settings and completed stages) and ``results/query_summary.yaml``.
    ``output_dir`` is a URI, or a path of the session's default file system; images are
    fetched and read by executors, to which their folder must be a path (a mounted one on a cluster).
    """

    def __init__(self, spark: SparkSession, config: AdvancedConfig, catalogue, stages: list[str] | None = None, opener: fetch.Opener = fetch.open_url):
        self.spark, self.config, self.catalogue, self.opener = spark, config, catalogue, opener
        self.stages = list(stages or config.pipeline_stages)
        given = str(config.query.output_dir)
        self.out = given.rstrip("/") if ":" in given else str(Path(given).resolve())
        self.completed: list[str] = []
        ship_package(spark)

    # -- state ---------------------------------------------------------------
    @property
    def manifest(self) -> str:
        return f"{self.out}/state.yaml"

    @property
    def images(self) -> str:
        at = local_path(self.out)
        if at is None:
            raise ValueError(f"images can't be fetched to {self.out}: name a folder that executors have mounted")
        return f"{at}/data"

    def save_state(self) -> None:
        write_text(self.spark, self.manifest, yaml.safe_dump({"config": self.config.to_dict(), "completed_stages": self.completed}, sort_keys=False))

    def load_state(self) -> bool:
        text = read_text(self.spark, self.manifest)
        if text is None:
            return False
        self.completed = list((yaml.safe_load(text) or {}).get("completed_stages") or [])
        return True

    def check_dependencies(self, stage: str) -> None:
        missing = [s for s in NEEDS.get(stage, ()) if s not in self.completed]
        if missing:
            raise RuntimeError(f"stage {stage} needs {', '.join(missing)} first")

    def mark_stage_complete(self, stage: str) -> None:
        log.info("stage %s completed", stage)
        if stage not in self.completed:
            self.completed.append(stage)
        self.save_state()

    def status(self) -> str:
        left = [s for s in self.stages if s not in self.completed]
        return f"completed: {', '.join(self.completed) or 'none'}; to do: {', '.join(left) or 'none'}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/results/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.out}/results/{name}")
        return self.table(name)

    # -- stages ----------------------------------------------------------------
    def run_query(self) -> DataFrame:
        q = self.config.query
        artifact, plane = self.catalogue()
        source = self.spark.createDataFrame([(1, float(q.source.ra), float(q.source.dec))], "source_id bigint, ra double, dec double")
        found = archive.search(source, artifact, plane, tuple(q.bands) if q.bands else None)
        obs = self._write(found.withColumn("estimated_mb", S.cutout_megabytes(F.lit(self.config.download.cutout_size))), "observation")
        self._summarise(obs, obs.agg(F.coalesce(F.sum("estimated_mb"), F.lit(0.0)) / 1024).first()[0], True)
        self.mark_stage_complete("query")
        return obs

    def _summarise(self, obs: DataFrame, gb: float, estimated: bool) -> None:
        q = self.config.query.source
        span = archive.time_span(obs).first()
        at = f"{self.out}/results/query_summary.yaml"
        before = {} if estimated else yaml.safe_load(read_text(self.spark, at) or "") or {}
        summary = {
            "source": q.to_dict(),
            "query_time": before.get("query_time") or dt.datetime.now(dt.UTC).isoformat(),
            "n_observations": span["n_observations"],
            "time_span_days": float(span["time_span_days"]),
            "total_size_gb": float(gb),
            "total_size_gb_estimated": estimated,
            "band_counts": {r["band"]: r["n"] for r in archive.band_counts(obs).orderBy("band").collect()},
        }
        write_text(self.spark, at, yaml.safe_dump(summary, sort_keys=False))
        log.info("%d observations over %.1f days, %.2f GB%s, by band %s", summary["n_observations"], summary["time_span_days"], gb, " estimated" if estimated else "", summary["band_counts"])

    def run_download(self, skip_existing: bool = True) -> DataFrame:
        self.check_dependencies("download")
        obs, d = self.table("observation"), self.config.download
        if d.cutout_size:
            q = self.config.query.source
            obs = obs.withColumn("download_url", F.concat("download_url", S.cutout_parameters(F.lit(d.cutout_size), F.lit(d.cutout_center).cast("string"), F.lit(float(q.ra)), F.lit(float(q.dec)))))
        got = self._write(fetch.fetch(obs, self.images, d, skip_existing=skip_existing, opener=self.opener), "download_result")
        size = got.agg(F.sum(F.when(F.col("success"), F.coalesce("size_mb", F.lit(0.0))))).first()[0]
        self._summarise(self.table("observation"), (size or 0.0) / 1024, False)
        self.mark_stage_complete("download")
        return got

    def run_processing(self) -> DataFrame:
        self.check_dependencies("processing")
        q = self.config.query.source
        files = mef.list_files(self.spark, f"file://{self.images}")
        source = self.spark.createDataFrame([(1, float(q.ra), float(q.dec))], "source_id bigint, ra double, dec double")
        if files.isEmpty():
            m = self.spark.createDataFrame([], mef.MEASUREMENT)
        else:
            m = mef.photometry(mef.read_files(self.spark, f"file://{self.images}"), source, self.config.photometry)
        f, e = F.col("flux"), F.col("flux_error")
        curve = self._write(m.withColumns({"flag_binary": S.flag_binary(F.col("flag")), "is_upper_limit": S.is_upper_limit(f, e), "snr": S.snr(f, e), "meas_id": F.xxhash64("obs_id", "band")}), "lightcurve")
        label = q.name or f"RA{q.ra:.4f}_Dec{q.dec:.4f}"
        curves.write_csv(curve, f"{self.out}/results/lightcurve_csv", {"source": label, "ra": str(q.ra), "dec": str(q.dec)})
        self.mark_stage_complete("processing")
        return curve

    def run_visualization(self) -> dict[str, DataFrame]:
        """The tables a figure is drawn from: spectrum, time series and axis limits."""
        self.check_dependencies("visualization")
        v = self.config.visualization
        how = {"sigma": v.sigma_threshold, "mask": S.flag_mask(self.config.photometry.bad_flags)}
        curve = self.table("lightcurve")
        if self.config.query.bands:
            curve = curve.where(F.col("band").isin(*self.config.query.bands))
        kept = lightcurves.clipped(curve, ["source_id"], sigma=v.sigma_clip_sigma, maxiters=v.sigma_clip_maxiters)
        spectrum = self._write(lightcurves.spectrum_series(kept, magnitude=v.use_magnitude, ordered=True, **how), "spectrum_series")
        series = self._write(lightcurves.time_series(kept, magnitude=v.use_magnitude, ordered=True, **how), "time_series")
        y = lightcurves.plot_limits(series, ["source_id"], "y", low=v.ylim_percentile_min / 100, high=v.ylim_percentile_max / 100, padding=v.ylim_padding_fraction)
        limits = self._write(y.join(lightcurves.axis_limits(series, ["source_id"], "mjd"), "source_id"), "plot_limits")
        self.mark_stage_complete("visualization")
        return {"spectrum": spectrum, "series": series, "limits": limits}

    def run(self, skip_existing: bool = True) -> None:
        """All configured stages in order; unknown names are passed over."""
        steps: dict[str, Any] = {"query": self.run_query, "download": lambda: self.run_download(skip_existing), "processing": self.run_processing, "visualization": self.run_visualization}
        for s in self.stages:
            if s in steps and s not in self.completed:
                before = runs_made()
                steps[s]()
                clear_runs(self.spark, before)  # what a stage returns is read from its own tables

    def resume(self, skip_existing: bool = True) -> None:
        """What the manifest doesn't list as completed."""
        self.load_state()
        self.run(skip_existing)


def run_pipeline(spark: SparkSession, catalogue, ra: float, dec: float, *, output_dir: str | Path = ".", source_name: str | None = None, resume: bool = False, skip_existing_downloads: bool = True, advanced_params_file: str | Path | None = None, **values) -> Pipeline:
    """A whole run for one source; ``values`` are parameters of ``AdvancedConfig.update``."""
    p = Pipeline(spark, AdvancedConfig.create(ra, dec, name=source_name, output_dir=output_dir, params_file=advanced_params_file, **values), catalogue)
    (p.resume if resume else p.run)(skip_existing_downloads)
    return p
