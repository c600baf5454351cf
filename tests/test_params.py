import dataclasses
import math

import pytest

from boxrates import RateParams


def test_defaults():
    params = RateParams()
    assert params.tickers == ("SPX",)
    assert params.expiries_per_ticker == 2
    assert params.max_strike_gap == math.inf
    assert params.max_abs_rate == 2.0


def test_from_dict_converts_and_ignores_unknown_keys():
    params = RateParams.from_dict(
        {"tickers": ["SPX", "VIX"], "min_volume": "3", "max_strike_gap": 400, "color": "red"}
    )
    assert params.tickers == ("SPX", "VIX")
    assert params.min_volume == 3
    assert params.max_strike_gap == 400.0


def test_frozen():
    with pytest.raises(dataclasses.FrozenInstanceError):
        RateParams().min_volume = 5


def test_interval_has_a_floor():
    assert RateParams(update_interval_seconds=1).trigger_seconds == 5
    assert RateParams(update_interval_seconds=90).trigger_seconds == 90


def test_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "config.yaml"
    path.write_text("tickers: [DJX]\nmax_abs_rate: 1.0\n")
    assert RateParams.from_yaml(path) == RateParams(tickers=("DJX",), max_abs_rate=1.0)
