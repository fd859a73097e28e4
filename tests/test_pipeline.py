import pytest
import yaml
from pyspark.sql import functions as F

from skyloom.functions import scalars as S
from skyloom.plans.config import AdvancedConfig, DownloadConfig
from skyloom.plans.pipeline import Pipeline, run_pipeline
from skyloom.sources import curves, fetch, mef
from skyloom.streaming import landing
from tests import images


@pytest.fixture(scope="module")
def archive_dir(tmp_path_factory):
    at = tmp_path_factory.mktemp("archive")
    for i in range(3):
        (at / f"o{i}.fits").write_bytes(images.mef(obs=f"o{i}", flux=60.0 + i))
    return at


def catalogue(spark, archive_dir):
    ra, dec = (float(v) for v in mef.decode(images.mef()).celestial.to_world(30.0, 29.0))
    box = [(ra - 1, dec - 1), (ra + 1, dec - 1), (ra + 1, dec + 1), (ra - 1, dec + 1)]
    rows = [(i, f"ivo://x/q?o{i}/D3", 61000.0 + i, 61000.1 + i, S.BANDPASS + "D3", 1.6e-6, 2.4e-6, box) for i in range(4)]
    plane = spark.createDataFrame(rows, "planeid long, obs_publisher_did string, time_bounds_lower double, time_bounds_upper double, energy_bandpassname string, energy_bounds_lower double, energy_bounds_upper double, poly array<struct<ra:double,dec:double>>")
    artifact = spark.createDataFrame([(i, f"o{i}.fits") for i in range(4)], "planeid long, uri string")
    return (ra, dec), lambda: (artifact, plane)


def test_whole_run_and_resume(spark, archive_dir, tmp_path):
    (ra, dec), cat = catalogue(spark, archive_dir)
    base = f"file://{archive_dir}/"

    def opener(url, cfg):
        return fetch.open_url(url.replace(S.ARCHIVE, base), cfg)

    cfg = AdvancedConfig.create(ra, dec, name="star", output_dir=tmp_path, max_retries=0, retry_delay=0)
    p = Pipeline(spark, cfg, cat, opener=opener)
    with pytest.raises(RuntimeError, match="download"):
        p.run_processing()
    p.run()
    assert p.completed == ["query", "download", "processing", "visualization"]
    got = {r["success"]: r["n"] for r in p.table("download_result").groupBy("success").agg(F.count("*").alias("n")).collect()}
    assert got == {True: 3, False: 1}  # one file of the catalogue doesn't exist
    assert p.table("lightcurve").count() == 3
    summary = yaml.safe_load((tmp_path / "results" / "query_summary.yaml").read_text())
    assert (summary["n_observations"], summary["band_counts"], summary["total_size_gb_estimated"]) == (4, {"D3": 4}, False)
    assert curves.read_csv(spark, str(tmp_path / "results" / "lightcurve_csv")).count() == 3
    assert p.table("spectrum_series").count() == 3 and p.table("plot_limits").count() == 1
    again = Pipeline(spark, cfg, cat, opener=opener)
    again.resume()
    assert again.completed == p.completed and "to do: none" in again.status()


def test_settings_reach_the_classes(spark, archive_dir, tmp_path):
    """The threshold and the bad flags of the settings decide on classes; the time of the query stays."""
    (ra, dec), cat = catalogue(spark, archive_dir)

    def opener(url, cfg):
        return fetch.open_url(url.replace(S.ARCHIVE, f"file://{archive_dir}/"), cfg)

    classes = {}
    for sigma in (3.0, 1e9):
        cfg = AdvancedConfig.create(ra, dec, output_dir=tmp_path / str(sigma), max_retries=0, retry_delay=0, sigma_threshold=sigma)
        p = Pipeline(spark, cfg, cat, opener=opener)
        p.run_query()
        asked = yaml.safe_load((tmp_path / str(sigma) / "results" / "query_summary.yaml").read_text())["query_time"]
        p.run()
        assert yaml.safe_load((tmp_path / str(sigma) / "results" / "query_summary.yaml").read_text())["query_time"] == asked
        classes[sigma] = {r["class"] for r in p.table("time_series").collect()}
        assert {r["quality_class"].split("_")[0] for r in p.table("spectrum_series").collect()} == classes[sigma]
        assert sorted(r["seq"] for r in p.table("time_series").collect()) == [1, 2, 3]
    assert classes == {3.0: {"good"}, 1e9: {"rejected"}}


def test_no_observations(spark, archive_dir, tmp_path):
    _, cat = catalogue(spark, archive_dir)
    p = run_pipeline(spark, cat, 10.0, -60.0, output_dir=tmp_path, aperture_diameter=2.0)
    assert p.table("lightcurve").count() == 0 and p.config.photometry.aperture_diameter == 2.0


def test_fetch_retries_and_verifies(tmp_path):
    import io

    class Response(io.BytesIO):
        headers = {"Content-Length": "5"}

    answers = [Response(b"123"), OSError("down"), Response(b"12345")]
    waits = []

    def opener(url, cfg):
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    at = tmp_path / "D1" / "a.fits"
    assert fetch.fetch_one("u", str(at), DownloadConfig(retry_delay=1), opener, waits.append) == (True, None, 5 / 1024**2)
    assert at.read_bytes() == b"12345" and waits == [1, 2]
    ok, error, size = fetch.fetch_one("u", str(tmp_path / "b"), DownloadConfig(max_retries=0), lambda u, c: Response(b"1"), waits.append)
    assert not ok and "of 5 bytes" in error and size is None and not list(tmp_path.glob("b*"))


def test_csv_round_trip(spark, tmp_path):
    row = ("o", 61000.0, 1.0, 0.1, float("nan"), None, 1.5, 0.05, "D1", 3, "0" * 20 + "11", 1.0, 2.0, False, 10.0)
    df = spark.createDataFrame([row], curves.LIGHT_CURVE)
    curves.write_csv(df, str(tmp_path / "c"), {"source": "x"})
    back = curves.read_csv(spark, str(tmp_path / "c")).collect()
    assert len(back) == 1 and back[0]["mag_ab"] is None and back[0]["flag_binary"] == row[10]


def test_landing_stream(spark, archive_dir, tmp_path):
    ra, dec = (float(v) for v in mef.decode(images.mef()).celestial.to_world(30.0, 29.0))
    sources = spark.createDataFrame([(1, ra, dec)], "source_id long, ra double, dec double")
    for _ in range(2):  # the second run finds nothing new
        q = landing.measure_new_files(spark, str(archive_dir), sources, str(tmp_path / "m"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_arrivals_stream_equals_batch(spark, data, tmp_path):
    lc = spark.read.parquet(f"{data}/lightcurve.parquet").select("meas_id", "band", "loaded_at")
    lc.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lc.schema).parquet(str(tmp_path / "in"))
    q = landing.arrivals(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, landing.arrivals(lc).collect()), key=repr)
    assert sorted(map(tuple, spark.table("arrivals").collect()), key=repr) == want
