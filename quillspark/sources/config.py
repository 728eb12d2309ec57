"""Settings, and the stored calibration."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field

from quillspark.functions.classes import parse
from quillspark.operators.calibrate import Calibration, Fit
from quillspark.operators.features import extra_weights

CONFIG_NAME, CACHE_NAME, CACHE_VERSION = ".quillspark.yaml", ".quillspark.cache.json", 3


@dataclass
class Config:
    """The defaults of the model. Features that are registered beside them add their own weights."""

    weights: dict[str, float] = field(
        default_factory=lambda: {"cyclomatic": 1.0, "nesting": 0.8, "coupling": 0.6, "length": 0.5, "duplication": 0.7, "cross_duplication": 0.7} | extra_weights()
    )
    delta_s_max: float = 0.05
    churn_since_days: int = 90
    scaling_class_max: str = "O(k)"
    scaling_bonus_beta: float = 0.5


def _scalar(text: str):
    text = text.strip().strip("'\"")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _plain_yaml(text: str) -> dict:
    """`key: value` lines and one level of nesting, for when no YAML library is present."""
    out: dict = {}
    section = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        key, sep, value = line.strip().partition(":")
        if not sep:
            raise ValueError(f"malformed setting: {raw!r}")
        if line[0] in " \t":
            if section is None:
                raise ValueError(f"malformed setting: {raw!r}")
            section[key.strip()] = _scalar(value)
        elif value.strip():
            out[key.strip()], section = _scalar(value), None
        else:
            section = out[key.strip()] = {}
    return out


def load_config(path: str) -> Config:
    """The defaults overlaid by a YAML file; a missing file is fine, a malformed one is an error."""
    config = Config()
    if not os.path.exists(path):
        return config
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        try:
            data = yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"{path}: {e}") from e
    except ImportError:
        data = _plain_yaml(text)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping expected")
    config.weights |= {str(k): float(v) for k, v in (data.get("weights") or {}).items()}
    for name in ("delta_s_max", "scaling_bonus_beta"):
        if data.get(name) is not None:
            setattr(config, name, float(data[name]))
    if data.get("churn_since_days") is not None:
        config.churn_since_days = int(data["churn_since_days"])
    if data.get("scaling_class_max") is not None:
        parse(str(data["scaling_class_max"]))
        config.scaling_class_max = str(data["scaling_class_max"])
    return config


def weights_hash(weights: dict[str, float]) -> str:
    """Tells sets of weights apart: k is the scale of one of them only."""
    return hashlib.sha256(json.dumps(sorted(weights.items())).encode()).hexdigest()


def save_calibration(path: str, cal: Calibration, weights: dict[str, float]) -> None:
    fits = [[name, fit.mu, fit.sigma, fit.valid] for name, fit in cal.fits.items()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"format": CACHE_VERSION, "weights": weights_hash(weights), "scale": cal.k, "churn_weight": cal.alpha, "fits": fits}, f, indent=1)


def load_calibration(path: str, weights: dict[str, float]) -> Calibration | None:
    """The stored calibration, None if there is none, it is of another format or other weights, or a feature is missing from it."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if held["format"] != CACHE_VERSION or held["weights"] != weights_hash(weights):
            return None
        fits = {name: Fit(float(mu), float(sigma), bool(valid)) for name, mu, sigma, valid in held["fits"]}
        cal = Calibration(fits, float(held["scale"]), float(held["churn_weight"]))
    except (OSError, ValueError, KeyError, TypeError):
        return None
    return cal if all(n in fits for n in weights) else None
