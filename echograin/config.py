"""Options with the reference defaults, validated on construction."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

BLIND_MODES = ("strict", "mild", "aggressive")
GRANULARITIES = ("file", "function")
SEVERITIES = {"hint": "hint", "information": "information", "info": "information", "warning": "warning", "warn": "warning", "off": "off"}
BANDS, ROWS, SLOTS = 32, 4, 128


@dataclass(frozen=True)
class WalkOptions:
    use_default_excludes: bool = True
    excludes: tuple[str, ...] = ()
    respect_ignore_files: bool = True


@dataclass(frozen=True)
class ScanOptions:
    blind: str = "mild"
    granularity: str = "file"
    k: int = 5
    window: int = 4
    use_naive: bool = False
    min_jaccard: float = 0.5
    min_shared: int = 10
    max_bucket: int = 50
    only_lang: str | None = None
    walk: WalkOptions = field(default_factory=WalkOptions)

    def __post_init__(self) -> None:
        if self.blind not in BLIND_MODES:
            raise ValueError(f"blind must be one of {BLIND_MODES}")
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"granularity must be one of {GRANULARITIES}")


@dataclass(frozen=True)
class SearchOptions(ScanOptions):
    """Defaults of the search index: whole functions, identifiers blinded."""

    blind: str = "aggressive"
    granularity: str = "function"
    min_jaccard: float = 0.3
    top: int = 10


@dataclass(frozen=True)
class ServerOptions:
    """Options of the long-lived upkeep service; camelCase keys as clients send them."""

    blind: str = "mild"
    granularity: str = "function"
    min_jaccard: float = 0.8
    highlight_top: int = 20
    highlight_severity: str = "warning"
    tail_severity: str = "hint"
    rescan_on_change: bool = True
    incremental: bool = True
    watch_files: bool = False


def check_bands(bands: int, rows: int, slots: int = SLOTS) -> None:
    if bands * rows != slots:
        raise ValueError(f"bands x rows must be {slots}")


def parse_severity(name: str) -> str:
    try:
        return SEVERITIES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown severity {name!r}") from None


def overlay(given: dict[str, Any] | None) -> tuple[ServerOptions, list[str]]:
    """Server options with the given values laid over; a bad value keeps the default and leaves a warning."""
    options, warnings = ServerOptions(), []
    for f in fields(ServerOptions):
        head, *rest = f.name.split("_")
        key = head + "".join(map(str.capitalize, rest))
        if not given or given.get(key) is None:
            continue
        value, default = given[key], getattr(options, f.name)
        try:
            if f.name.endswith("severity"):
                value = parse_severity(value)
            elif isinstance(default, bool):
                if not isinstance(value, bool):
                    raise ValueError("not a boolean")
            elif isinstance(default, (int, float)):
                if isinstance(value, bool) or value < 0:
                    raise ValueError("not a number of 0 or more")
                value = type(default)(value)
            elif f.name == "blind" and value.lower() in BLIND_MODES or f.name == "granularity" and value.lower() in GRANULARITIES:
                value = value.lower()
            else:
                raise ValueError("unknown value")
            options = replace(options, **{f.name: value})
        except (ValueError, TypeError, AttributeError) as bad:
            warnings.append(f"{key}: {bad}")
    return options, warnings
