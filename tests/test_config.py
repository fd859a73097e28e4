import pytest
import yaml

from skyloom.plans.config import AdvancedConfig, DownloadConfig, PhotometryConfig, QueryConfig, Source, VisualizationConfig, export_default_parameters, load_advanced_config


def config(tmp_path, **parts):
    return AdvancedConfig(QueryConfig(Source(100.0, 20.0, "x"), tmp_path / "out"), **parts)


def test_defaults():
    p, v, d = PhotometryConfig(), VisualizationConfig(), DownloadConfig()
    assert (p.aperture_method, p.aperture_diameter, p.fwhm_multiplier, p.min_usable_pixels, p.window_size) == ("fwhm", 3.0, 2.5, 10, 50)
    assert p.bad_flags == [0, 1, 2, 6, 7, 9, 10, 11, 14, 15, 17, 19]
    assert (v.sigma_threshold, v.dpi, v.figsize, v.sigma_clip_maxiters) == (5.0, 150, (10, 8), 10)
    assert (d.chunk_size, d.timeout, d.max_retries, d.retry_delay, d.cutout_size) == (8192, 300, 3, 5, None)


@pytest.mark.parametrize(
    "kind, values",
    [
        (PhotometryConfig, {"annulus_inner_offset": -1}),
        (PhotometryConfig, {"bg_sigma_clip_sigma": 0}),
        (PhotometryConfig, {"zodi_scale_min": 10.0, "zodi_scale_max": 1.0}),
        (PhotometryConfig, {"aperture_method": "other"}),
        (PhotometryConfig, {"background_method": "other"}),
        (PhotometryConfig, {"window_size": (0, 5)}),
        (VisualizationConfig, {"errorbar_alpha": 1.5}),
        (VisualizationConfig, {"marker_alpha": -0.1}),
        (VisualizationConfig, {"wavelength_cmap": "no such map"}),
        (VisualizationConfig, {"ylim_percentile_min": 99, "ylim_percentile_max": 1}),
        (DownloadConfig, {"chunk_size": 0}),
        (DownloadConfig, {"timeout": -1}),
        (DownloadConfig, {"cutout_size": "abc"}),
        (DownloadConfig, {"cutout_center": "10,95"}),
        (Source, {"ra": 400, "dec": 0}),
    ],
)
def test_rejected(kind, values):
    with pytest.raises(ValueError):
        kind(**values)


def test_bands_and_window_list(tmp_path):
    with pytest.raises(ValueError):
        QueryConfig(Source(1, 1), tmp_path, ["D7"])
    assert PhotometryConfig(window_size=[30, 40]).window_size == (30, 40)


def test_round_trips(tmp_path):
    c = config(tmp_path, photometry=PhotometryConfig(bg_sigma_clip_sigma=4.0, window_size=(8, 9)), visualization=VisualizationConfig(dpi=200, figsize=(1, 2)))
    assert AdvancedConfig.from_dict(c.to_dict()) == c
    c.to_yaml_file(tmp_path / "c.yaml")
    assert load_advanced_config(tmp_path / "c.yaml") == c
    (tmp_path / "state.yaml").write_text(yaml.safe_dump({"config": c.to_dict(), "completed_stages": []}))
    assert AdvancedConfig.from_saved_state(tmp_path / "state.yaml") == c


def test_unknown_names(tmp_path):
    assert PhotometryConfig.from_dict({"nothing": 1}) == PhotometryConfig()
    with pytest.raises(ValueError, match="Unknown"):
        config(tmp_path).update(nothing=1)


def test_update_is_all_or_nothing(tmp_path):
    c = config(tmp_path)
    c.update(dpi=99, aperture_diameter=2.0, bands=["D1"])
    assert (c.visualization.dpi, c.photometry.aperture_diameter, c.query.bands) == (99, 2.0, ["D1"])
    with pytest.raises(ValueError):
        c.update(dpi=1, chunk_size=0)
    assert c.visualization.dpi == 99


def test_template_and_priority(tmp_path):
    at = export_default_parameters(tmp_path)
    data = yaml.safe_load(at.read_text())
    assert {"photometry", "visualization", "download"} <= set(data) and not {"source", "ra", "dec", "name", "query"} & set(data)
    assert export_default_parameters(tmp_path / "own.yaml").name == "own.yaml"
    data["photometry"]["aperture_diameter"] = 7.0
    at.write_text(yaml.safe_dump(data))
    assert AdvancedConfig.create(1, 2, params_file=at).photometry.aperture_diameter == 7.0
    assert AdvancedConfig.create(1, 2, params_file=at, aperture_diameter=2.0).photometry.aperture_diameter == 2.0


def test_bad_files(tmp_path):
    with pytest.raises(FileNotFoundError):
        load_advanced_config(tmp_path / "none.yaml")
    (tmp_path / "bad.yaml").write_text("not valid yaml: [[[")
    with pytest.raises(ValueError, match="Failed to load parameters"):
        load_advanced_config(tmp_path / "bad.yaml")
