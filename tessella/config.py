"""Settings of an analysis from one JSON file, with single values put in place by dotted names.

    {"Tasks": ["htautau", ...], "Selections": ["lowMT_VBFJet", ...], "Parameters": {"alpha_bkg": 0.001},
     "Poisson": {"name": {"preselection": "highMT_noVBFJet", "mva_selection": [["ttbar", 0.4, 100]], "ignore": false}},
     "CSI": {"use": true}, "Save": {"n_split": 100}}

Whatever the file does not say keeps the default of tessella.schema.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from tessella.schema import POISSON_REGIONS, PROCESSES, RATE, UNBINNED_REGIONS


def coerced(text: str):
    """true and false, whole numbers, other numbers, null; anything else stays text."""
    word = text.strip()
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    if word.lower() in ("null", "none"):
        return None
    if re.fullmatch(r"[+-]?\d+", word):
        return int(word)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", word):
        return float(word)
    return text


def overridden(config: dict, settings: Iterable[str]) -> dict:
    """A copy of the configuration with each "a.b.c=value" put in place; sections that are missing are made."""
    out = copy.deepcopy(config)
    for setting in settings:
        name, found, value = setting.partition("=")
        if not found or not name:
            raise ValueError(f"{setting!r} is not name=value")
        *path, last = name.split(".")
        at = out
        for key in path:
            at = at.setdefault(key, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name}: {key} is no section")
        at[last] = coerced(value)
    return out


@dataclass(frozen=True)
class Settings:
    processes: tuple[str, ...] = PROCESSES
    regions: tuple[str, ...] = UNBINNED_REGIONS
    poisson: tuple[tuple[str, tuple[str, tuple[tuple[str, float, float], ...]]], ...] = tuple(POISSON_REGIONS.items())
    rates: tuple[tuple[str, float], ...] = tuple(RATE.items())
    use_cubes: bool = False
    n_split: int = 1

    @property
    def poisson_regions(self) -> dict:
        return dict(self.poisson)


#: Names of the normalisations' rates in a file.
_RATES = {"alpha_bkg": "nu_bkg", "alpha_tt": "nu_tt", "alpha_diboson": "nu_diboson"}


def settings(config: dict) -> Settings:
    """The checked settings of a configuration."""
    tasks = tuple(t for t in config.get("Tasks", PROCESSES) if t != "MultiClassifier")
    if unknown := [t for t in tasks if t not in PROCESSES]:
        raise ValueError(f"unknown tasks {unknown}")
    poisson = POISSON_REGIONS
    if "Poisson" in config:
        windows = lambda v: tuple((str(p), float(a), float(b)) for p, a, b in v.get("mva_selection") or ())
        poisson = {n: (v["preselection"], windows(v)) for n, v in config["Poisson"].items() if not v.get("ignore", False)}
    rates = {**RATE, **{_RATES[k]: float(v) for k, v in config.get("Parameters", {}).items() if k in _RATES}}
    return Settings(
        tasks,
        tuple(config.get("Selections", UNBINNED_REGIONS)),
        tuple(poisson.items()),
        tuple(rates.items()),
        bool(config.get("CSI", {}).get("use", False)),
        int(config.get("Save", {}).get("n_split", 1)),
    )


def read_settings(path: str, changes: Iterable[str] = ()) -> Settings:
    """Of a JSON file on the driver."""
    with open(path) as f:
        return settings(overridden(json.load(f), changes))
