"""Settings: one frozen record for each section, checked as a whole when a file is read.

A key that a section doesn't know, a missing one without a default and a value of another kind are errors that name
the place (``models.a.num_layers``). Sections of model-specific extras stay plain mappings.
"""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field


class SettingsError(ValueError):
    """What is wrong with the settings, and where."""


@dataclass(frozen=True)
class Model:
    num_layers: int
    num_visual_tokens: int | None = None  # None: the image decides
    hf_name: str = ""
    architecture: str = ""
    image_size: int | None = None
    patch_size: int | None = None
    temperature: float = 1.0
    top_p: float = 1.0
    prompt_template: str | None = None
    extras: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Dispersion:
    top_patch_pct: float = 0.1
    connectivity: int = 8
    min_blob_area: int = 3
    top_k_layers: int = 10

    def __post_init__(self) -> None:
        _demand(self.connectivity in (4, 8), "connectivity must be 4 or 8")
        _demand(0 < self.top_patch_pct <= 1, "top_patch_pct must be over 0 and at most 1")


@dataclass(frozen=True)
class Grounding:
    top_k_pct: float = 0.05
    mid_layer_pct: tuple[float, float] = (0.25, 0.75)
    use_attn_weighting: bool = False

    def __post_init__(self) -> None:
        _demand(0 <= self.mid_layer_pct[0] < self.mid_layer_pct[1] <= 1, "mid_layer_pct must rise within 0 and 1")


@dataclass(frozen=True)
class Transport:
    tau: float = 0.07
    transport_top_k: int = 64
    cost_mode: str = "direct"
    lambda_d: float = 1.0
    lambda_s: float = 1.0
    lambda_t: float = 1.0
    lambda_int: float = 1.0
    baseline_layers: int = 10
    risk_start_layer: int = 15
    alpha: float = 2.0
    ot_solver: str = "emd"
    atarget_visual_top_k: int = 32

    def __post_init__(self) -> None:
        _demand(self.tau > 0, "tau must be over 0")
        _demand(self.transport_top_k > 0, "transport_top_k must be over 0")


@dataclass(frozen=True)
class Dataset:
    num_images: int = 4000
    train_ratio: float = 0.9
    seed: int = 42
    coco_root: str = ""
    annotation_file: str = ""
    captions_file: str = ""

    def __post_init__(self) -> None:
        _demand(0 < self.train_ratio < 1, "train_ratio must be between 0 and 1")


@dataclass(frozen=True)
class Questions:
    pope_dir: str = ""
    splits: tuple[str, ...] = ("random", "popular", "adversarial")
    prompt_templates: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    models: dict[str, Model]
    dispersion: Dispersion
    grounding: Grounding
    transport: Transport
    dataset: Dataset
    classifiers: dict[str, dict[str, object]]  # grids by kind, each value a list or a scalar
    questions: Questions

    def model(self, key: str) -> Model:
        if key not in self.models:
            raise SettingsError(f"models.{key} is missing; there are {', '.join(sorted(self.models)) or 'none'}")
        return self.models[key]


def _demand(holds: bool, what: str) -> None:
    if not holds:
        raise SettingsError(what)


def _value(given: object, kind: object, at: str) -> object:
    """``given`` as ``kind``; whole numbers pass for floats, lists for tuples."""
    if isinstance(kind, types.UnionType):
        return None if given is None else _value(given, next(k for k in typing.get_args(kind) if k is not types.NoneType), at)
    outer = typing.get_origin(kind)
    if outer is dict:
        _demand(isinstance(given, dict), f"{at} must be a mapping, not {given!r}")
        inner = typing.get_args(kind)[1]
        return {str(k): _value(v, inner, f"{at}.{k}") for k, v in given.items()}
    if outer is tuple:
        inner = typing.get_args(kind)
        _demand(isinstance(given, (list, tuple)) and (inner[-1] is Ellipsis or len(given) == len(inner)), f"{at} must be a list of {'any length' if inner[-1] is Ellipsis else len(inner)}, not {given!r}")
        return tuple(_value(v, inner[0], f"{at}[{i}]") for i, v in enumerate(given))
    if dataclasses.is_dataclass(kind):
        return _section(kind, given, at)
    if kind is object:
        return given
    if kind is float and isinstance(given, int) and not isinstance(given, bool):
        return float(given)
    _demand(isinstance(given, kind) and (kind is bool or not isinstance(given, bool)), f"{at} must be {kind.__name__}, not {given!r}")
    return given


def _section(kind: type, given: object, at: str) -> object:
    _demand(given is None or isinstance(given, dict), f"{at} must be a mapping, not {given!r}")
    hints = typing.get_type_hints(kind)
    known = {f.name: f for f in dataclasses.fields(kind)}
    values, extras = {}, {}
    for k, v in (given or {}).items():
        if k in known and k != "extras":
            values[k] = _value(v, hints[k], f"{at}.{k}")
        elif "extras" in known:
            extras[k] = v
        else:
            raise SettingsError(f"{at}.{k} is not known; {at} has {', '.join(sorted(known))}")
    for name, f in known.items():
        if name not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            raise SettingsError(f"{at}.{name} is missing")
    try:
        return kind(**values, **({"extras": extras} if extras else {}))
    except SettingsError as wrong:
        raise SettingsError(f"{at}: {wrong}") from None


#: The name of the transport features' section in a file, unless the caller says another.
TRANSPORT_SECTION = "transport"


def settings(given: dict, transport: str = TRANSPORT_SECTION) -> Settings:
    """Settings from a nested mapping; ``transport`` names the section of the transport features."""
    features = _value(given.get("feature_extraction") or {}, dict[str, object], "feature_extraction")
    places = {"ads": ("dispersion", Dispersion), "cgc": ("grounding", Grounding), transport: ("transport", Transport)}
    for k in features:
        _demand(k in places, f"feature_extraction.{k} is not known; it has {', '.join(places)}")
    made = {name: _section(kind, features.get(k), f"feature_extraction.{k}") for k, (name, kind) in places.items()}
    rest = {"models": dict[str, Model], "dataset": Dataset, "classifiers": dict[str, dict[str, object]]}
    made |= {k: _value(given.get(k) or {}, kind, k) for k, kind in rest.items()}
    made["questions"] = _section(Questions, given.get("pope"), "pope")
    known = {*rest, "feature_extraction", "pope"}
    _demand(set(given) <= known, f"{', '.join(sorted(set(given) - known))}: not known; there are {', '.join(sorted(known))}")
    return Settings(**made)


def load(path: str, transport: str = TRANSPORT_SECTION) -> Settings:
    """Settings from a JSON file, or from YAML where a parser is installed."""
    with open(path) as f:
        if path.endswith(".json"):
            return settings(json.load(f), transport)
        import yaml

        return settings(yaml.safe_load(f), transport)
