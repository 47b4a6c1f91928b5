"""panelcast - weekly commerce/marketing panel analytics on Spark.

DataFrame-to-DataFrame operators keyed by ``series_id``: weekly rollup and
cleaning, unit economics, recent KPIs, like-for-like growth and elasticity,
monthly health scores, scenario projection, month ledgers, forecasting and
walk-forward backtests.
"""

__version__ = "0.1.0"
