"""Calendar steps: one place that knows how a frequency moves along the date axis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Freq:
    """A regular spacing of periods, each named by its first day."""

    name: str
    months: int
    days: int
    season: int

    def floor(self, date: Column) -> Column:
        """First day of the period that holds ``date``."""
        if self.name == "day":
            return F.to_date(date)
        return F.trunc(F.to_date(date), self.name)

    def add(self, date: Column, steps: Column | int) -> Column:
        """``date`` moved by ``steps`` periods."""
        n = F.lit(steps) if isinstance(steps, int) else steps
        if self.months:
            return F.add_months(date, (n * self.months).cast("int"))
        return F.date_add(date, (n * self.days).cast("int"))

    def sequence(self, start: Column, stop: Column) -> Column:
        """Array of period starts from ``start`` to ``stop``, both included."""
        unit = f"interval {self.months} month" if self.months else f"interval {self.days} day"
        return F.sequence(start, stop, F.expr(unit))

    def between(self, start: Column, stop: Column) -> Column:
        """Whole periods from ``start`` to ``stop``, rounded down on either side of zero."""
        if self.months:
            return F.floor(F.months_between(stop, start) / self.months).cast("bigint")
        return F.floor(F.date_diff(stop, start) / self.days).cast("bigint")


DAY = Freq("day", 0, 1, 7)
WEEK = Freq("week", 0, 7, 52)
MONTH = Freq("month", 1, 0, 12)
QUARTER = Freq("quarter", 3, 0, 4)
