"""Equity analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame, keyed by explicit
group columns (``portfolio``, ``rebalance_date``, ``as_of``, ``window_id`` ...)
so that one Spark job covers every stock, date, portfolio and parameter set.
"""

__version__ = "0.1.0"
