"""Settings from a document, with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from .durations import parse_duration
from .plans.rules import read_document


@dataclass(frozen=True)
class Config:
    """What the pipeline takes from outside. Windows are durations."""

    alert_window: str = "5m"
    dedup_window: str = "5m"
    risk_window: str = "24h"
    risk_threshold: int = 100
    sources: tuple[str, ...] = ()
    year: int = 2024
    blocklist: str | None = None
    geoip: str | None = None
    assets: str | None = None
    alerts_path: str = "alerts"
    notify: tuple[dict, ...] = field(default_factory=tuple)


def load_config(path: str | Path | None = None, default: str | Path = "vigilake.json") -> Config:
    """A named path must exist; without one the default path may be absent. Unknown keys, and windows
    that are no durations, raise ValueError."""
    if path is None and not Path(default).exists():
        return Config()
    doc = read_document(Path(path or default)) or {}
    known = {f.name for f in fields(Config)}
    if unknown := set(doc) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    for key in ("alert_window", "dedup_window", "risk_window"):
        if key in doc:
            parse_duration(doc[key])
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in doc.items()})
