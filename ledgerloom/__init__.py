"""Retail-deposit warehouse and data-governance jobs written directly on PySpark."""

from ledgerloom.params import Params

__all__ = ["Params"]
