"""Model parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RiskConfig:
    # Defaults that results depend on.
    risk_free: float = 0.045
    horizon: int = 20
    drawdown_levels: tuple[float, ...] = (0.05, 0.08, 0.10)
    min_open_interest: int = 100
    max_spread: float = 0.20
    min_mid: float = 0.05
    min_gap: float = 0.03
    crisis_weight: float = 2.0
    bandwidth: float = 1.0
    evt_replace: float = 0.01
    evt_threshold: float = 0.05
    steepness: float = 8.0
    center: float = 0.60
    weights: tuple[float, float, float, float] = (0.35, 0.30, 0.20, 0.15)
    alphas: tuple[float, ...] = (0.20, 0.10, 0.05, 0.025, 0.01, 0.005)


DEFAULT = RiskConfig()
