"""Settings of searches, photometry, plots, downloads and pipelines.

Each class lists its rules as data; values are checked when an object is made and when it is
updated. Unknown names in files are ignored, in ``update`` they are errors.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml

from skyloom.functions.scalars import BAD_FLAGS, BANDS

STAGES = ("query", "download", "processing", "visualization")
# What each stage needs to have run before.
NEEDS = {"query": (), "download": ("query",), "processing": ("download",), "visualization": ("processing",)}
COLORMAPS = ("rainbow", "viridis", "plasma", "inferno", "magma", "cividis", "coolwarm", "jet", "turbo", "gray", "hot", "cool", "spring", "summer", "autumn", "winter", "Spectral", "RdBu", "twilight", "hsv")
_UNIT = r"(px|pix|pixels|arcsec|arcmin|deg|rad)?$"


def is_cutout_size(text: str) -> bool:
    return bool(re.match(r"^\d+\.?\d*(,\d+\.?\d*)?" + _UNIT, text)) and all(float(x) > 0 for x in re.findall(r"\d+\.?\d*", text))


def is_cutout_center(text: str) -> bool:
    if not re.match(r"^-?\d+\.?\d*,-?\d+\.?\d*" + _UNIT, text):
        return False
    return "px" in text or "pix" in text or -90 <= float(re.findall(r"-?\d+\.?\d*", text)[1]) <= 90


def positive(x: Any) -> str | None:
    return None if x > 0 else "must be > 0"


def not_negative(x: Any) -> str | None:
    return None if x >= 0 else "must be >= 0"


def share(x: Any) -> str | None:
    return None if 0 <= x <= 1 else "must be 0-1"


def percent(x: Any) -> str | None:
    return None if 0 <= x <= 100 else "must be 0-100"


def one_of(*allowed: str):
    return lambda x: None if x in allowed else f"must be one of {', '.join(allowed)}"


class Checked:
    """Base of settings: ``RULES`` name -> check, ``ORDERED`` pairs (lower, upper)."""

    RULES: dict = {}
    ORDERED: tuple = ()

    def __post_init__(self) -> None:
        for name, rule in self.RULES.items():
            value = getattr(self, name)
            problem = rule(value) if value is not None else None
            if problem:
                raise ValueError(f"Invalid {name}: {problem}, got {value!r}")
        for low, high in self.ORDERED:
            if not getattr(self, low) < getattr(self, high):
                raise ValueError(f"{low} must be < {high}")

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, data: dict | None):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (data or {}).items() if k in known})


@dataclass
class Source(Checked):
    ra: float
    dec: float
    name: str | None = None

    RULES = {"ra": lambda x: None if 0 <= x <= 360 else "RA must be 0-360", "dec": lambda x: None if -90 <= x <= 90 else "Dec must be -90-90"}


def _window(x: Any) -> str | None:
    sides = (x,) if isinstance(x, int) else tuple(x)
    ok = len(sides) in (1, 2) and all(isinstance(s, int) and s > 0 for s in sides)
    return None if ok else "must be a positive integer or two of them"


@dataclass
class PhotometryConfig(Checked):
    aperture_method: str = "fwhm"
    aperture_diameter: float = 3.0
    fwhm_multiplier: float = 2.5
    max_processing_workers: int = 10
    bad_flags: list[int] = field(default_factory=lambda: list(BAD_FLAGS))
    annulus_inner_offset: float = 1.414
    min_annulus_area: int = 10
    max_outer_radius: float = 5.0
    min_usable_pixels: int = 10
    bg_sigma_clip_sigma: float = 3.0
    bg_sigma_clip_maxiters: int = 3
    subtract_zodi: bool = True
    zodi_scale_min: float = 0.0
    zodi_scale_max: float = 10.0
    pixel_scale_fallback: float = 6.2
    max_annulus_attempts: int = 5
    annulus_expansion_step: float = 0.5
    background_method: str = "annulus"
    window_size: int | tuple[int, int] = 50

    RULES = {
        "aperture_method": one_of("fixed", "fwhm"),
        "background_method": one_of("annulus", "window"),
        "annulus_inner_offset": not_negative,
        "window_size": _window,
        **{n: positive for n in ("aperture_diameter", "fwhm_multiplier", "max_processing_workers", "min_annulus_area", "max_outer_radius", "min_usable_pixels", "bg_sigma_clip_sigma", "bg_sigma_clip_maxiters", "pixel_scale_fallback", "max_annulus_attempts")},
    }
    ORDERED = (("zodi_scale_min", "zodi_scale_max"),)

    def __post_init__(self) -> None:
        if isinstance(self.window_size, list):
            self.window_size = tuple(self.window_size)
        super().__post_init__()


@dataclass
class VisualizationConfig(Checked):
    sigma_threshold: float = 5.0
    use_magnitude: bool = False
    show_errorbars: bool = True
    wavelength_cmap: str = "rainbow"
    date_cmap: str = "viridis"
    sigma_clip_sigma: float = 3.0
    sigma_clip_maxiters: int = 10
    ylim_percentile_min: float = 1.0
    ylim_percentile_max: float = 99.0
    ylim_padding_fraction: float = 0.1
    marker_size_good: float = 1.5
    marker_size_rejected: float = 2.0
    marker_size_upper_limit: float = 3.0
    errorbar_alpha: float = 0.2
    marker_alpha: float = 0.9
    errorbar_linewidth: float = 0.5
    figsize: tuple[float, float] = (10, 8)
    dpi: int = 150

    RULES = {
        "sigma_threshold": positive,
        "wavelength_cmap": one_of(*COLORMAPS),
        "date_cmap": one_of(*COLORMAPS),
        "ylim_percentile_min": percent,
        "ylim_percentile_max": percent,
        "errorbar_alpha": share,
        "marker_alpha": share,
        "dpi": positive,
    }
    ORDERED = (("ylim_percentile_min", "ylim_percentile_max"),)

    def __post_init__(self) -> None:
        self.figsize = tuple(self.figsize)
        super().__post_init__()


@dataclass
class DownloadConfig(Checked):
    max_download_workers: int = 4
    cutout_size: str | None = None
    cutout_center: str | None = None
    chunk_size: int = 8192
    timeout: int = 300
    max_retries: int = 3
    retry_delay: int = 5
    user_agent: str = "skyloom"

    RULES = {
        "max_download_workers": positive,
        "cutout_size": lambda x: None if not x or is_cutout_size(x) else "expected <value>[,<value>][unit]",
        "cutout_center": lambda x: None if not x or is_cutout_center(x) else "expected <x>,<y>[unit]",
        "chunk_size": positive,
        "timeout": positive,
        "max_retries": not_negative,
        "retry_delay": not_negative,
    }


@dataclass
class QueryConfig(Checked):
    source: Source
    output_dir: Path = field(default_factory=Path.cwd)
    bands: list[str] | None = None

    RULES = {"bands": lambda x: None if set(x) <= set(BANDS) else f"bands must be among {', '.join(BANDS)}"}

    def __post_init__(self) -> None:
        if isinstance(self.source, dict):
            self.source = Source.from_dict(self.source)
        self.output_dir = Path(self.output_dir)
        super().__post_init__()

    def to_dict(self) -> dict:
        return {"source": self.source.to_dict(), "output_dir": str(self.output_dir), "bands": self.bands}


_PARTS = {"photometry": PhotometryConfig, "visualization": VisualizationConfig, "download": DownloadConfig}


@dataclass
class AdvancedConfig:
    query: QueryConfig
    photometry: PhotometryConfig = field(default_factory=PhotometryConfig)
    visualization: VisualizationConfig = field(default_factory=VisualizationConfig)
    download: DownloadConfig = field(default_factory=DownloadConfig)
    pipeline_stages: list[str] = field(default_factory=lambda: list(STAGES))

    def to_dict(self) -> dict:
        return {"query": self.query.to_dict(), **{p: getattr(self, p).to_dict() for p in _PARTS}, "pipeline_stages": list(self.pipeline_stages)}

    @classmethod
    def from_dict(cls, data: dict, query: QueryConfig | None = None) -> AdvancedConfig:
        """A tree of settings; ``query`` stands in where the tree has none."""
        q = QueryConfig.from_dict(data["query"]) if data.get("query") else query
        if q is None:
            raise ValueError("no query settings")
        return cls(q, **{p: kind.from_dict(data.get(p)) for p, kind in _PARTS.items()}, pipeline_stages=list(data.get("pipeline_stages") or STAGES))

    def update(self, **values: Any) -> None:
        """Set parameters by name, wherever they belong. ValueError for unknown names;
        nothing changes unless all values are valid."""
        new: dict[str, dict] = {}
        stages = None
        for name, value in values.items():
            if name == "pipeline_stages":
                stages = list(value)
                continue
            home = next((p for p in ("query", *_PARTS) if name in {f.name for f in fields(getattr(self, p))}), None)
            if home is None:
                raise ValueError(f"Unknown parameter: {name}")
            new.setdefault(home, {})[name] = value
        made = {p: replace(getattr(self, p), **v) for p, v in new.items()}
        for p, v in made.items():
            setattr(self, p, v)
        if stages is not None:
            self.pipeline_stages = stages

    def to_yaml_file(self, path: str | Path) -> None:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))

    @classmethod
    def from_yaml_file(cls, path: str | Path, query: QueryConfig | None = None) -> AdvancedConfig:
        """From a tree of settings, bare or below ``config`` (as in a saved state)."""
        data = yaml.safe_load(Path(path).read_text()) or {}
        return cls.from_dict(data.get("config", data), query)

    @classmethod
    def create(cls, ra: float, dec: float, *, name: str | None = None, output_dir: str | Path = ".", params_file: str | Path | None = None, **values: Any) -> AdvancedConfig:
        """Settings for one source: explicit values go before the file's, those before the defaults."""
        query = QueryConfig(Source(ra, dec, name), Path(output_dir))
        base = load_advanced_config(params_file, query) if params_file else cls(query)
        base.query = replace(query, bands=base.query.bands)
        base.update(**{k: v for k, v in values.items() if v is not None})
        return base

    from_saved_state = from_yaml_file


def export_default_parameters(output: str | Path, filename: str = "default_params.yaml") -> Path:
    """Write a template of all settings but the source's; returns its path."""
    at = Path(output)
    if at.suffix not in (".yaml", ".yml"):
        at = at / filename
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(yaml.safe_dump({p: kind().to_dict() for p, kind in _PARTS.items()} | {"pipeline_stages": list(STAGES)}, sort_keys=False))
    return at


def load_advanced_config(path: str | Path, query: QueryConfig | None = None) -> AdvancedConfig:
    """Settings of a file. FileNotFoundError without it, ValueError if it can't be read."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    try:
        return AdvancedConfig.from_yaml_file(path, query)
    except (yaml.YAMLError, AttributeError, TypeError, KeyError) as e:
        raise ValueError(f"Failed to load parameters from {path}: {e}") from e
