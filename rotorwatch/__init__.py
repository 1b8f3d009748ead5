"""Condition monitoring for rotating machines on Spark DataFrames."""

from rotorwatch.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
