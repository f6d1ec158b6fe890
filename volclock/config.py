"""Settings, passed explicitly; the defaults are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Cleaning:
    min_tick_volume: int = 5
    max_spread_pips: float = 30.0


@dataclass(frozen=True)
class Costs:
    pip_value: float = 0.0001
    spread: float = 0.8
    commission_per_side: float = 0.35
    slippage: float = 0.2

    @property
    def total(self) -> float:
        return self.spread + 2 * self.commission_per_side + self.slippage


@dataclass(frozen=True)
class Features:
    volume_bar_size: int = 1500
    rolling_window: int = 1440
    horizons: tuple[int, ...] = (1, 3, 6, 12, 48)
    h1_horizons: tuple[int, ...] = (1, 4, 24)
    vol_fast: int = 48
    vol_slow: int = 576
    momentum: int = 12
    micro: int = 288
    vpin: int = 48
    #: Hours of sessions: [start, end).
    asian: tuple[int, int] = (0, 7)
    london: tuple[int, int] = (7, 16)
    new_york: tuple[int, int] = (13, 22)


@dataclass(frozen=True)
class Labels:
    pt: float = 0.70
    sl: float = 0.40
    max_hold: int = 24
    min_hold: int = 6
    min_return_pips: float = 3.0
    vol_lookback: int = 264
    dynamic: bool = True
    vol_fast: int = 48
    vol_slow: int = 576


@dataclass(frozen=True)
class Training:
    n_splits: int = 5
    embargo_pct: float = 0.01
    max_hold: int = 24
    max_open_trades: int = 3
    cooldown_minutes: int = 30
    bar_minutes: int = 5
    confidence: float = 0.55
    seed: int = 42


@dataclass(frozen=True)
class Config:
    cleaning: Cleaning = field(default_factory=Cleaning)
    costs: Costs = field(default_factory=Costs)
    features: Features = field(default_factory=Features)
    labels: Labels = field(default_factory=Labels)
    training: Training = field(default_factory=Training)
