"""Driver-side configuration: typed dataclasses from YAML, templates, safe paths."""

from __future__ import annotations

import dataclasses
import json
import os
import string
import types
import typing
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from skyloom.catalog import configs

def read_mapping(source: dict | str | Path) -> dict:
    """A dictionary as it is, or the mapping in a YAML or JSON file."""
    if isinstance(source, dict):
        return source
    text = Path(source).read_text()
    if str(source).endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{source} holds no mapping")
    return found


def override_paths(config: dict | str | Path, changes: dict[str, str | Path | None]) -> dict:
    """A copy with the given keys replaced by text; None keeps the key."""
    return read_mapping(config) | {k: str(v) for k, v in changes.items() if v is not None}


def merge_folder(folder: str | Path) -> dict:
    """All YAML files of a folder by name; later files win by top-level key."""
    out: dict = {}
    for path in sorted(Path(folder).glob("*.y*ml")):
        out |= read_mapping(path)
    return out


def _named(values: dict):
    """Nested mappings with a ``type`` become what is registered under it; an unknown type raises."""
    if "type" in values:
        if values["type"] not in configs:
            raise ValueError(f"unknown configuration type {values['type']!r}; known: {sorted(configs.entries)}")
        return build(configs.entries[values["type"]], {k: v for k, v in values.items() if k != "type"})
    return {k: _named(v) if isinstance(v, dict) else v for k, v in values.items()}


def _convert(value, kind):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if value is None:
        return None
    if origin in (typing.Union, types.UnionType):
        return _convert(value, next(a for a in args if a is not type(None)))
    if isinstance(value, dict) and "type" in value:
        made = _named(value)
        if dataclasses.is_dataclass(kind) and not isinstance(made, kind):
            raise ValueError(f"{value['type']!r} is no {kind.__name__}")
        return made
    if dataclasses.is_dataclass(kind) and isinstance(value, dict):
        return build(kind, value)
    if kind is Path:
        return Path(value)
    if kind is datetime and isinstance(value, str):
        return datetime.fromisoformat(value)
    if origin is tuple and isinstance(value, list):
        return tuple(_convert(v, args[0]) if args else v for v in value)
    if origin is dict and isinstance(value, dict):
        return {k: _convert(v, args[1]) for k, v in value.items()}
    return _named(value) if isinstance(value, dict) else value


def build(cls: type, values: dict):
    """A dataclass from nested mappings, with paths, times and tuples converted; unknown keys raise."""
    hints = typing.get_type_hints(cls)
    known = {f.name for f in dataclasses.fields(cls)}
    if unknown := set(values) - known:
        raise ValueError(f"{cls.__name__} has no {sorted(unknown)}")
    return cls(**{k: _convert(v, hints[k]) for k, v in values.items()})


def load(cls: type, source: dict | str | Path, changes: dict | None = None):
    return build(cls, override_paths(source, changes or {}))


@dataclass(frozen=True, slots=True)
class DatasetConfig:
    """How samples are stored and read."""

    path: Path
    split: str = "train"
    keys: tuple[str, ...] = ()
    save_batch_size: int = 1
    built_in_batch_size: int = 0
    loader_batch_size: int = 1
    only_saved: bool = False


@dataclass(frozen=True, slots=True)
class LoopConfig:
    epochs: int = 1
    restart_frequency: int | None = None
    memory_limit_gb: float | None = None


@dataclass(frozen=True, slots=True)
class RetentionConfig:
    path: Path | None = None
    pattern: str = "*.pth"
    older_than: float | None = None
    more_than: int | None = None
    must_both_be_true: bool = False
    excludes: tuple[str, ...] = ()


@configs.register("UNet")
@dataclass(frozen=True, slots=True)
class UNetConfig:
    in_channels: int = 2
    out_channels: int = 2
    hidden: int = 64
    depth: int = 3
    reduction_ratio: int | None = None
    resolution_increase_layers: int = 0


@dataclass(frozen=True, slots=True)
class PreprocessingConfig:
    start_datetime: datetime
    end_datetime: datetime
    forecast_hours: tuple[int, ...] = (7, 8, 9, 10, 11, 12)
    window_size: int = 128
    overlap_factor: int = 2
    unmasked_threshold: float = 0.5
    context: dict[str, int] = field(default_factory=dict)
    save_batch_size: int = 16
    max_save_count: int | None = None


@dataclass(frozen=True, slots=True)
class ManagerConfig:
    """Networks by name and where their checkpoints are kept."""

    path: Path
    experiment: str = ""
    networks: dict[str, UNetConfig] = field(default_factory=dict)
    retention: RetentionConfig = field(default_factory=RetentionConfig)


@configs.register("downscaling")
@dataclass(frozen=True, slots=True)
class WorkflowConfig:
    """A run: its dataset, loop, networks and the settings of its steps by name, each with a ``type``."""

    dataset: DatasetConfig
    loop: LoopConfig = field(default_factory=LoopConfig)
    manager: ManagerConfig | None = None
    steps: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True, slots=True)
class InferenceConfig:
    path_models: Path
    path_output: Path
    experiment: str = ""
    networks: dict[str, UNetConfig] = field(default_factory=dict)


@dataclass(frozen=True, slots=True)
class TrainingPlotConfig:
    panels: tuple[str, ...] = ()
    tail_fraction: float | None = None
    tail_number: int | None = None

    def figure_size(self) -> tuple[int, int]:
        return 16, 12 * len(self.panels)


class Templates:
    """Named ``${...}`` templates; time stamp and process id fill themselves, any other missing name raises."""

    def __init__(self, templates: dict[str, str] | None = None, values: dict[str, str] | None = None):
        self.templates, self.values = dict(templates or {}), dict(values or {})

    def add(self, name: str, template: str) -> None:
        self.templates[name] = template

    def add_values(self, **values: str) -> None:
        self.values |= values

    def copy(self) -> Templates:
        return Templates(self.templates, self.values)

    def __contains__(self, name: str) -> bool:
        return name in self.templates

    def complete(self, text: str) -> str:
        own = {"timestamp": datetime.now().strftime("%Y%m%d%H%M%S"), "pid": str(os.getpid())} | self.values
        return string.Template(text).substitute(own)

    def __getitem__(self, name: str) -> str:
        return self.complete(self.templates[name])


def check_safe(path: str | Path, pattern: str) -> None:
    """Refuse relative paths and the pattern that matches everything."""
    if not Path(path).is_absolute():
        raise ValueError("the path is relative")
    if pattern == "*":
        raise ValueError("the pattern matches every file")
