"""surgecast: demand analytics on Spark DataFrames.

Raw event records -> UTC periods -> gap-filled counts per series -> time-series
features -> forecasts with a capacity band -> forecast log -> scoring and drift.
Every operator is a DataFrame -> DataFrame function that works on one series or a
panel of many series keyed by ``series_cols``.
"""

__version__ = "0.1.0"
