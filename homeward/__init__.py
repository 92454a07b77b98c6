"""Homeward: matching missing and found person records with PySpark."""

from homeward.config import ConfidenceConfig, KnnConfig, MatchConfig

__all__ = ["ConfidenceConfig", "KnnConfig", "MatchConfig"]
