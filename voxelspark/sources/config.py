"""Configuration from YAML: typed sections whose missing keys take defaults."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, fields, is_dataclass

from ..functions.strings import resolve


@dataclass
class Map:
    dim: tuple[float, float, float] = (10.0, 10.0, 10.0)
    res: float = 0.1


@dataclass
class Data:
    truncation_boundary_factor: float = 8.0
    max_weight: float = 100.0


@dataclass
class Sensor:
    width: int = 640
    height: int = 480
    fx: float = 525.0
    fy: float = 525.0
    cx: float = 319.5
    cy: float = 239.5
    near_plane: float = 0.1
    far_plane: float = 10.0
    downsampling_factor: int = 1


@dataclass
class Tracker:
    iterations: tuple[int, ...] = (10, 5, 4)
    dist_threshold: float = 0.1
    normal_threshold: float = 0.8
    track_threshold: float = 0.15
    icp_threshold: float = 1e-5


@dataclass
class Reader:
    reader_type: str = "unknown"
    fps: float = 0.0
    drop_frames: bool = False
    inverse_scale: float = 0.0
    sequence_path: str = ""
    ground_truth_file: str = ""


@dataclass
class App:
    enable_ground_truth: bool = True
    integration_rate: int = 1
    rendering_rate: int = 4
    meshing_rate: int = 100
    max_frames: int = -1
    mesh_path: str = ""
    slice_path: str = ""
    log_file: str = ""


@dataclass
class Config:
    map: Map = field(default_factory=Map)
    data: Data = field(default_factory=Data)
    sensor: Sensor = field(default_factory=Sensor)
    tracker: Tracker = field(default_factory=Tracker)
    reader: Reader = field(default_factory=Reader)
    app: App = field(default_factory=App)


def _fill(section, values: dict, name: str):
    for f in fields(section):
        if f.name not in values:
            continue
        old, new = getattr(section, f.name), values[f.name]
        try:
            if isinstance(old, tuple):
                new = tuple(type(old[0])(v) for v in new)
            elif isinstance(old, bool):
                new = new if isinstance(new, bool) else {"true": True, "false": False}[str(new).lower()]
            else:
                new = type(old)(new)
        except (TypeError, ValueError, KeyError):
            warnings.warn(f"{name}.{f.name} is no {type(old).__name__}; its default stays", stacklevel=3)
            continue
        setattr(section, f.name, new)


def load(path: str) -> Config:
    """A YAML file's configuration; paths in it are relative to it, and ~ is expanded."""
    import yaml

    with open(path) as f:
        text = "".join(line for line in f if not line.startswith("%YAML"))
    values = yaml.safe_load(text) or {}
    out = Config()
    for f in fields(out):
        if not isinstance(values.get(f.name), dict):
            warnings.warn(f"no section {f.name}; its defaults stay", stacklevel=2)
            continue
        _fill(getattr(out, f.name), values[f.name], f.name)
    for section in (out.reader, out.app):
        assert is_dataclass(section)
        for f in fields(section):
            value = getattr(section, f.name)
            if f.name.endswith(("_path", "_file")) and value:
                setattr(section, f.name, resolve(value, path))
    return out
