"""Configuration: frozen dataclasses with bounds, from a JSON document or a dictionary."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


def _within(name, value, low, high=float("inf")):
    if not low <= value <= high:
        raise ValueError(f"{name} = {value} is outside [{low}, {high}]")


@dataclass(frozen=True)
class Universe:
    min_market_cap_bn: float = 1.0
    min_dollar_vol_percentile: float = 50.0
    ipo_exclusion_months: float = 12
    dollar_vol_lookback_days: int = 60

    def __post_init__(self):
        _within("min_market_cap_bn", self.min_market_cap_bn, 0)
        _within("min_dollar_vol_percentile", self.min_dollar_vol_percentile, 0, 100)
        _within("ipo_exclusion_months", self.ipo_exclusion_months, 0)
        _within("dollar_vol_lookback_days", self.dollar_vol_lookback_days, 1)


@dataclass(frozen=True)
class Backtest:
    rebalance_frequency: str = "monthly"
    initial_capital: float = 1e7
    max_position_size: float = 0.05
    commission_bps: float = 5.0
    bid_ask_spread_bps: float = 10.0
    long_only: bool = True


@dataclass(frozen=True)
class Regime:
    n_components: int = 4
    covariance_type: str = "full"
    n_iter: int = 100
    random_state: int = 42
    max_bic_components: int = 6

    def __post_init__(self):
        _within("n_components", self.n_components, 2, 10)
        if self.covariance_type not in ("full", "tied", "diag", "spherical"):
            raise ValueError(self.covariance_type)


@dataclass(frozen=True)
class Config:
    stock_universe: list[str] = field(default_factory=list)
    universe: Universe = Universe()
    backtest: Backtest = Backtest()
    regime: Regime = Regime()

    @classmethod
    def of(cls, data: dict) -> Config:
        """Nested dictionaries to a Config; tickers are upper-cased; unknown keys raise TypeError."""
        kinds = {"universe": Universe, "backtest": Backtest, "regime": Regime}
        data = {k: kinds[k](**v) if k in kinds else v for k, v in data.items()}
        if "stock_universe" in data:
            data["stock_universe"] = [t.upper() for t in data["stock_universe"]]
        return cls(**data)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            return cls.of(json.load(f))
