"""Screening criteria as a typed value; ``None`` switches an optional limit off."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

# --- fixed values: default thresholds, presets and score weights ---------------------


@dataclass(frozen=True)
class Criteria:
    # price and momentum
    price_52w_low_pct: float = 1.03
    price_52w_high_pct: float = 0.50
    min_history_days: int = 250
    # volume and liquidity
    min_volume: int = 50_000
    min_rvol: float = 2.0
    min_avg_volume_20d: int | None = 50_000
    max_rvol: float | None = 20.0
    # technical indicators
    rsi_enabled: bool = True
    rsi_min: float = 20
    rsi_max: float = 50
    ma_enabled: bool = True
    price_vs_sma50_pct: float = 0.95
    sma50_vs_sma200_pct: float = 0.93
    atr_enabled: bool = True
    atr_min_pct: float = 0.015
    atr_max_pct: float = 0.08
    # fundamentals
    fundamental_enabled: bool = False
    max_debt_to_equity: float = 2.0
    min_current_ratio: float = 1.0
    # patterns
    pattern_enabled: bool = True
    double_bottom_enabled: bool = True
    breakout_enabled: bool = True
    volume_confirmation_required: bool = True
    min_volume_spike_ratio: float = 2.0
    min_days_since_low: int | None = 1
    max_days_since_low: int | None = 30
    # risk limits
    max_price: float | None = 1000.0
    min_price: float | None = 1.0
    # sizes
    mcap_enabled: bool = True


DEFAULT = Criteria()

#: the second, stricter profile
ENHANCED = Criteria(
    price_52w_low_pct=1.01,
    min_volume=100_000,
    rsi_max=40,
    sma50_vs_sma200_pct=0.90,
    atr_min_pct=0.02,
    atr_max_pct=0.10,
    pattern_enabled=False,
)

PRESETS: dict[str, dict] = {
    "conservative": {
        "price_52w_low_pct": 1.03,
        "min_rvol": 3.0,
        "rsi_max": 30,
        "min_avg_volume_20d": 100_000,
    },
    "aggressive": {
        "price_52w_low_pct": 1.05,
        "min_rvol": 1.5,
        "rsi_max": 50,
        "min_avg_volume_20d": 25_000,
    },
    "balanced": {},
    # stricter thresholds from the written screening rules
    "documented": {
        "price_52w_low_pct": 1.01,
        "rsi_max": 45,
        "price_vs_sma50_pct": 1.03,
    },
    # loose limits for synthetic, highly volatile bars
    "wide": {
        "price_52w_low_pct": 10.0,
        "min_avg_volume_20d": None,
        "min_days_since_low": None,
        "max_days_since_low": None,
        "mcap_enabled": False,
        "ma_enabled": False,
        "atr_enabled": False,
        "pattern_enabled": False,
    },
}

SCORE_WEIGHTS = {
    "rvol": 0.30,
    "price_proximity": 0.25,
    "volume": 0.20,
    "rsi": 0.15,
    "momentum": 0.10,
}

#: what the presets mean on top of the second profile where that differs
ENHANCED_PRESETS: dict[str, dict] = {
    "conservative": {**PRESETS["conservative"], "price_52w_low_pct": 1.005},
    "aggressive": PRESETS["aggressive"],
    "balanced": {},
}

# --- overlays -------------------------------------------------------------------------


def apply_preset(criteria: Criteria, name: str, presets: dict[str, dict] = PRESETS) -> Criteria:
    """Overlay a preset; an unknown name leaves the criteria as they are."""
    return replace(criteria, **presets.get(name, {}))


def version(criteria: Criteria) -> str:
    """Short hash that changes whenever any threshold changes."""
    text = json.dumps(asdict(criteria), sort_keys=True)
    return hashlib.md5(text.encode()).hexdigest()[:8]
