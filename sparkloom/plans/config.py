"""Configuration: defaults and checks."""

from __future__ import annotations

import re
from datetime import date

#: Defaults of each section. Paths are the caller's.
DEFAULTS: dict[str, dict] = {
    "data_loading": {
        "base_path": "data/log", "output_path": "data/processed", "start_date": "2024-01-01", "end_date": "2024-02-01",
        "cpu_threshold_seconds": 300, "memory_threshold_gb": 10, "require_non_curated": True,
    },
    "boundary_sampling": {"balance_ratio": 5.0, "boundary_sampling_max_boost": 2.0, "boundary_sampling_min_multiplier": 0.05, "guarantee_close_threshold": 0.5},
    "features": {"base_feature_count": 78, "historical_feature_count": 17, "tfidf_vocab_size": 250, "total_features": 345, "min_df": 100, "max_df": 0.80},
    "model": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "cv_folds": 5, "cost_fn": 100.0, "cost_fp": 1.0},
    "requirements": {"target_heavy_recall": 0.98, "target_fnr": 0.02, "target_f1": 0.85, "target_roc_auc": 0.90},
    "time_splits": {"train_days": 30, "val_days": 7, "test_days": 7},
    "validation": {"parity_tolerance": 1e-6, "parity_samples": 100, "parity_success_threshold": 0.5},
    "spark": {"app_name": "sparkloom", "driver_memory": "16G", "executor_memory": "20G", "executor_cores": 5, "driver_cores": 4, "min_executors": 2, "max_executors": 20},
    "storage": {"container": "data", "artifacts": "artifacts", "models": "models"},
}

_NUMBER = (int, float)
# key -> (types, lower bound, is the bound itself allowed, upper bound)
_RANGES: dict[str, dict[str, tuple]] = {
    "data_loading": {"cpu_threshold_seconds": (_NUMBER, 0, False, None), "memory_threshold_gb": (_NUMBER, 0, False, None)},
    "boundary_sampling": {
        "balance_ratio": (_NUMBER, 0, False, None), "boundary_sampling_max_boost": (_NUMBER, 0, False, None),
        "boundary_sampling_min_multiplier": (_NUMBER, 0, True, None), "guarantee_close_threshold": (_NUMBER, 0, True, None),
    },
    "features": {
        **{k: (int, 1, True, None) for k in ("base_feature_count", "historical_feature_count", "tfidf_vocab_size", "total_features", "min_df")},
        "max_df": (_NUMBER, 0, False, 1.0),
    },
    "model": {
        "n_estimators": (int, 1, True, None), "max_depth": (int, 1, True, None), "learning_rate": (_NUMBER, 0, False, 1.0),
        "subsample": (_NUMBER, 0, False, 1.0), "cv_folds": (int, 2, True, None), "cost_fn": (_NUMBER, 0, False, None), "cost_fp": (_NUMBER, 0, False, None),
    },
    "requirements": {k: (_NUMBER, 0, True, 1.0) for k in ("target_heavy_recall", "target_fnr", "target_f1", "target_roc_auc")},
    "time_splits": {k: (int, 1, True, None) for k in ("train_days", "val_days", "test_days")},
    "spark": {k: (int, 1, True, None) for k in ("executor_cores", "driver_cores", "min_executors", "max_executors")},
    "validation": {"parity_tolerance": (_NUMBER, 0, False, None), "parity_samples": (int, 1, True, None), "parity_success_threshold": (_NUMBER, 0, True, 100.0)},
}
_REQUIRED = {
    "data_loading": ("base_path", "start_date", "end_date"),
    "features": ("base_feature_count", "historical_feature_count", "tfidf_vocab_size"),
    "model": ("n_estimators", "max_depth", "learning_rate"),
    "requirements": ("target_heavy_recall", "target_fnr", "target_f1", "target_roc_auc"),
    "time_splits": ("train_days", "val_days", "test_days"),
    "spark": ("app_name",),
    "storage": ("container",),
}
_MEMORY = re.compile(r"\d+(?:\.\d+)?[kmgtKMGT]?[bB]?")


def _day(value) -> date | None:
    try:
        return date.fromisoformat(str(value))
    except ValueError:
        return None


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration; empty where nothing is."""
    found = [f"missing section: {s}" for s in _REQUIRED if s not in config]
    for section, keys in _REQUIRED.items():
        found += [f"{section}: missing key {k}" for k in keys if section in config and k not in config[section]]
    for section, ranges in _RANGES.items():
        for key, (kind, low, closed, high) in ranges.items():
            if key not in config.get(section, {}):
                continue
            value = config[section][key]
            if isinstance(value, bool) or not isinstance(value, kind):
                found.append(f"{section}: {key} has the wrong type")
            elif value < low or value == low and not closed or high is not None and value > high:
                found.append(f"{section}: {key} is out of range")
    loading = config.get("data_loading", {})
    days = {k: _day(loading[k]) for k in ("start_date", "end_date") if k in loading}
    found += [f"data_loading: {k} is not a date" for k, d in days.items() if d is None]
    if len(days) == 2 and all(days.values()) and days["end_date"] <= days["start_date"]:
        found.append("data_loading: end_date must come after start_date")
    spark = config.get("spark", {})
    for key in ("driver_memory", "executor_memory"):
        if key in spark and not _MEMORY.fullmatch(str(spark[key])):
            found.append(f"spark: {key} is not an amount of memory")
    least, most = spark.get("min_executors"), spark.get("max_executors")
    if isinstance(least, int) and isinstance(most, int) and least > most:
        found.append("spark: min_executors is above max_executors")
    for section, keys in {"spark": ("app_name",), "storage": ("container", "artifacts", "models")}.items():
        values = config.get(section, {})
        found += [f"{section}: {k} must be a text" for k in keys if k in values and not (isinstance(values[k], str) and values[k].strip())]
    pair = config.get("features", {}).get("ngram_range")
    if pair is not None and (not isinstance(pair, list) or len(pair) != 2 or pair[0] < 1 or pair[1] < pair[0]):
        found.append("features: ngram_range must be two growing integers")
    return found


def merged(config: dict) -> dict:
    """The configuration over the defaults; an error where something is wrong with it."""
    out = {s: DEFAULTS.get(s, {}) | config.get(s, {}) for s in {**DEFAULTS, **config}}
    if wrong := problems(out):
        raise ValueError("; ".join(wrong))
    return out
