"""Settings: defaults, then the layers of TOML files, from the user's to the project's."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    path: str = ""
    title_weight: float = 2.0
    max_source_bytes: int = 2 * 1024 * 1024
    cold_threshold_days: int = 30
    ephemeral_ttl_hours: int = 24
    session_ttl_days: int = 60
    auto_prune: bool = False
    fetch_ttl_hours: int = 24
    timeout: int = 30
    max_output_bytes: int = 102_400
    log_level: str = "info"


#: Where a field stands in a file.
TABLES = {
    "path": ("store",), "title_weight": ("store",), "max_source_bytes": ("store",), "cold_threshold_days": ("store", "cleanup"), "ephemeral_ttl_hours": ("store", "cleanup"),
    "session_ttl_days": ("store", "cleanup"), "auto_prune": ("store", "cleanup"), "fetch_ttl_hours": ("store", "cache"), "timeout": ("executor",), "max_output_bytes": ("executor",), "log_level": ("server",),
}
#: Lifetimes that a file may not set to less than 1.
LIFETIMES = ("ephemeral_ttl_hours", "session_ttl_days")


def overlaid(config: Config, layer: dict) -> Config:
    """``config`` with what a layer says; zeros, empty strings and false say nothing, but for lifetimes, which they may not be."""
    found = {}
    for f in fields(Config):
        at = layer
        for table in TABLES[f.name]:
            at = at.get(table, {})
        value = at.get(f.name)
        if f.name in LIFETIMES and value is not None and value < 1:
            raise ValueError(f"[{'.'.join(TABLES[f.name])}] {f.name} must be 1 or more")
        if value:
            found[f.name] = value
    return replace(config, **found)


def load(paths: list[str]) -> Config:
    """The layers of the files that there are, in order."""
    config = Config()
    for path in paths:
        if os.path.exists(path):
            with open(path, "rb") as f:
                config = overlaid(config, tomllib.load(f))
    return config
