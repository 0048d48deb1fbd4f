"""Declared schemas of the base tables."""

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "BOOLEAN": T.BooleanType(),
}


def _schema(text: str) -> T.StructType:
    """Column list to a schema without needing a session."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


STOCKS = _schema("stock_id BIGINT, symbol STRING, name STRING, sector STRING, market_cap DOUBLE")
PRICES = _schema(
    "stock_id BIGINT, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
)
FUNDAMENTALS = _schema(
    "stock_id BIGINT, quarter STRING, revenue DOUBLE, net_income DOUBLE, eps DOUBLE, roe DOUBLE, "
    "roce DOUBLE, debt_equity DOUBLE, free_cash_flow DOUBLE"
)
FACTORS = _schema(
    "stock_id BIGINT, date DATE, value_score DOUBLE, quality_score DOUBLE, growth_score DOUBLE, "
    "momentum_score DOUBLE, volatility_score DOUBLE"
)
SCORES = _schema("stock_id BIGINT, date DATE, composite_score DOUBLE, rank INT")
PORTFOLIO_ALLOCATIONS = _schema("user_id BIGINT, date DATE, stock_id BIGINT, weight DOUBLE, strategy_type STRING")
USER_PORTFOLIOS = _schema(
    "portfolio_id BIGINT, user_id BIGINT, name STRING, strategy_type STRING, regime_mode STRING, top_n INT"
)
USER_PORTFOLIO_STOCKS = _schema("portfolio_id BIGINT, stock_id BIGINT, symbol STRING")
TRACKER_POSITIONS = _schema(
    "user_id BIGINT, stock_id BIGINT, symbol STRING, invested_amount DOUBLE, quantity DOUBLE"
)
MONTHLY_ALLOCATIONS = _schema(
    "user_id BIGINT, portfolio_type STRING, portfolio_name STRING, rebalance_date DATE, stock_id BIGINT, "
    "weight DOUBLE, optimal_n_used INT, forced BOOLEAN"
)
PORTFOLIO_METRICS = _schema(
    "user_id BIGINT, portfolio_type STRING, portfolio_name STRING, rebalance_date DATE, cagr DOUBLE, "
    "volatility DOUBLE, sharpe DOUBLE, max_drawdown DOUBLE, calmar DOUBLE, sortino DOUBLE, total_return DOUBLE, "
    "stability_score DOUBLE, stability_grade STRING, sharpe_component DOUBLE, drawdown_component DOUBLE, "
    "stability_component DOUBLE, regime_component DOUBLE, diversif_component DOUBLE, composite_rating DOUBLE, "
    "composite_grade STRING, n_stocks INT, expected_volatility DOUBLE, expected_sharpe DOUBLE, "
    "avg_pairwise_corr DOUBLE, forced BOOLEAN"
)
MODEL_CALIBRATION = _schema(
    "calibration_start_date DATE, calibration_end_date DATE, intercept DOUBLE, beta_momentum DOUBLE, "
    "beta_quality DOUBLE, beta_value DOUBLE, beta_volatility DOUBLE, r_squared DOUBLE, adj_r_squared DOUBLE, "
    "n_observations BIGINT, residual_std DOUBLE, mean_error DOUBLE, raw_intercept DOUBLE, raw_beta_momentum DOUBLE, "
    "raw_beta_quality DOUBLE, raw_beta_value DOUBLE, raw_beta_volatility DOUBLE, blend_weight DOUBLE, "
    "prediction_method STRING, triggered_by STRING"
)
