"""Thresholds of a run, as one immutable driver-side object."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class RateParams:
    """What to collect and which boxes to keep.

    ``price_selector`` is carried so that existing configuration files load; no
    operator reads it.
    """

    tickers: tuple[str, ...] = ("SPX",)
    expiries_per_ticker: int = 2
    min_volume: int = 0
    min_open_interest: int = 0
    min_strike_gap: float = 0.0
    max_strike_gap: float = math.inf
    price_selector: str = "mid"
    snapshot_storage: str = "data/live_snapshots"
    update_interval_seconds: int = 60
    max_snapshots_retained: int = 200
    surface_history_minutes: int = 30
    max_abs_rate: float = 2.0

    @classmethod
    def from_dict(cls, values: Mapping[str, Any]) -> RateParams:
        """Known keys converted to the type of their default; unknown keys are ignored."""
        known = {}
        for field in fields(cls):
            if field.name in values:
                known[field.name] = type(field.default)(values[field.name])
        return cls(**known)

    @classmethod
    def from_yaml(cls, path: str) -> RateParams:
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML parameters needs PyYAML") from exc
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})

    @property
    def trigger_seconds(self) -> int:
        """Collector cadence; never below five seconds."""
        return max(self.update_interval_seconds, 5)


#: Every ticker and expiry: what a collection takes where no parameters are given.
ALL = RateParams(tickers=(), expiries_per_ticker=0)
