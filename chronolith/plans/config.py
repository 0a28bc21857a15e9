"""Configuration from a text of ``key value`` lines."""

from __future__ import annotations

from chronolith.operators.generator import Settings

#: Keys that are understood, and their defaults.
DEFAULTS = {
    "storage": None, "time_zone": "UTC", "source": [], "source.derived": [], "dimensions": None, "correlation": [], "timestamp_column": 1, "value_column": 2,
    "model_type": [], "error_bound": 0, "length_bound": 50, "maximum_latency": 0, "sampling_interval": None, "batch_size": 50_000, "dynamic_split_fraction": 0,
    "csv.separator": ",", "csv.header": True, "csv.date_format": "yyyy-MM-dd HH:mm:ss", "csv.locale": "en", "spark.streaming": 5, "spark.external": [],
    "engine": "spark", "interface": None, "transfer": None, "ingestors": 1,
}


def typed(text: str):
    """bool, int, float or the text itself."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse(text: str) -> dict:
    """Repeated keys become lists; # begins a comment; keys may be prefixed by a product name and a dot."""
    out: dict = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, _, value = line.partition(" ")
        key = next((k for k in sorted(DEFAULTS, key=len, reverse=True) if key == k or key.endswith("." + k)), None)
        if key is None:
            raise ValueError(f"unknown setting: {line}")
        value = typed(value.strip())
        if isinstance(DEFAULTS[key], list):
            out.setdefault(key, []).append(value)
        elif key in out:
            out[key] = [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
        else:
            out[key] = value
    out = {**{k: (list(v) if isinstance(v, list) else v) for k, v in DEFAULTS.items()}, **out}
    check(out)
    return out


def check(c: dict) -> None:
    for key, ok in (
        ("error_bound", lambda x: 0 <= x <= 100), ("length_bound", lambda x: x > 0), ("maximum_latency", lambda x: x >= 0), ("batch_size", lambda x: x > 0),
        ("dynamic_split_fraction", lambda x: x >= 0), ("spark.streaming", lambda x: x > 0), ("ingestors", lambda x: x >= 0)):
        if isinstance(c[key], (str, list)) or not ok(c[key]):
            raise ValueError(f"{key}: {c[key]}")


def settings(c: dict) -> Settings:
    models = tuple(c["model_type"]) if c["model_type"] else Settings.models
    return Settings(float(c["error_bound"]), c["length_bound"], c["maximum_latency"], float(c["dynamic_split_fraction"]), models)
