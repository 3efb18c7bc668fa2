"""Panel forecasting analytics on Spark DataFrames.

A *panel* is a DataFrame keyed by ``(id, date)`` with a ``value`` column.
Every operator takes and returns DataFrames and leaves the physical plan to
Catalyst; per-series work relies on a panel holding one row per id and period,
so the rows of one id are bounded by the calendar, never by the raw data.
"""
