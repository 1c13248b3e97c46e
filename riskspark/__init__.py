"""Downside-risk analytics on Spark: features, scenarios, options, validation."""

from .config import DEFAULT, RiskConfig
from .engine import Engine, report

__all__ = ["DEFAULT", "Engine", "RiskConfig", "report"]
