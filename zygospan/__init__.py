"""Runs-of-homozygosity analytics as Spark DataFrame operators."""

from zygospan.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
