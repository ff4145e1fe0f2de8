"""Explicit run parameters; no job reads the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Values the warehouse jobs take from outside.

    ``as_of`` stands for "now", ``snapshot`` for the weekly snapshot day.
    """

    as_of: date
    snapshot: date
    month_period: str
    advisor_period: int
    week_period: int
    decode_error: str = "error_bdf_voltage"

    @property
    def now(self) -> Column:
        """``as_of`` at midnight, as a zone-free timestamp."""
        return F.lit(self.as_of.isoformat() + " 00:00:00").cast("timestamp_ntz")

    @property
    def today(self) -> Column:
        return F.lit(self.as_of)

    @property
    def snapshot_day(self) -> Column:
        return F.lit(self.snapshot)

    @property
    def snapshot_number(self) -> int:
        """The snapshot day in the raw tables' own ``yyyyMMdd`` form."""
        return int(self.snapshot.strftime("%Y%m%d"))

    @property
    def new_account_floor(self) -> Column:
        return F.lit((self.as_of - timedelta(days=7)).isoformat()).cast("timestamp_ntz")

    @property
    def balance_day(self) -> str:
        """Two-digit day that names the wide balance column."""
        return self.snapshot.strftime("%d")
