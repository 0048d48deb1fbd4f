"""DuckDB statements for the price, factor, score, weight and backtest queries."""

from __future__ import annotations

from checks.base import backtest_ctes, build, cte, metric_select, r, summary_ctes

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


LAST = "(SELECT max(date) FROM c_scored)"
q("stock_universe", f"SELECT stock_id, symbol, name, sector, {r('market_cap')} AS market_cap FROM c_stocks")
q("sparse_prices", f"SELECT stock_id, date, {r('close + 1e-9')} AS close, {r('volume')} AS volume FROM c_prices")
q("trading_calendar", "SELECT idx, date FROM c_calendar")
q("dense_price_panel", f"SELECT stock_id, idx, date, {r('close + 1e-9')} AS close, {r('ret')} AS ret FROM c_panel")
q("price_movement", f"""SELECT symbol, {r('s', 2)} AS start_price, {r('e', 2)} AS end_price, {r('(e / s - 1) * 100', 2)} AS pct_change,
    {r('h', 2)} AS high, {r('l', 2)} AS low FROM (SELECT stock_id, arg_min(close, idx) s, arg_max(close, idx) e, max(close) h, min(close) l
    FROM c_panel WHERE date >= (SELECT max(date) - 365 FROM c_calendar) GROUP BY 1) JOIN c_stocks USING (stock_id)""")
q("raw_factors", f"""SELECT stock_id, date, {r('momentum_6m')} AS momentum_6m, {r('momentum_12m')} AS momentum_12m,
    {r('volatility')} AS volatility FROM c_raw""")
q("cross_section_stats", f"""SELECT date, count(*) AS n_stocks, {r('avg(momentum_6m)')} AS mean_momentum_6m,
    {r('stddev_samp(momentum_6m)')} AS std_momentum_6m, {r('avg(momentum_12m)')} AS mean_momentum_12m,
    {r('stddev_samp(momentum_12m)')} AS std_momentum_12m, {r('avg(volatility)')} AS mean_volatility,
    {r('stddev_samp(volatility)')} AS std_volatility FROM c_raw GROUP BY date""")
q("normalised_factors", f"""SELECT stock_id, date, CAST(0.0 AS DOUBLE) AS value_score, CAST(0.0 AS DOUBLE) AS quality_score,
    CAST(0.0 AS DOUBLE) AS growth_score, {r('momentum_score')} AS momentum_score, {r('volatility_score')} AS volatility_score FROM c_factors""")
q("factor_engine_validation", f"""SELECT date, count(*) AS n_stocks, {r('avg(momentum_score)')} AS momentum_mean,
    {r('stddev_samp(momentum_score)')} AS momentum_std, {r('avg(volatility_score)')} AS volatility_mean,
    {r('stddev_samp(volatility_score)')} AS volatility_std FROM c_factors WHERE date = (SELECT max(date) FROM c_factors) GROUP BY date""")
q("composite_scores_ranked", f"SELECT stock_id, date, {r('composite_score')} AS composite_score, rank FROM c_scored")
q("score_engine_validation", f"""SELECT date, position, stock_id, {r('composite_score')} AS composite_score, rank, {r('m')} AS mean_score, {r('s')} AS std_score
    FROM (SELECT *, row_number() OVER (ORDER BY rank, stock_id) AS position, avg(composite_score) OVER () AS m,
      stddev_samp(composite_score) OVER () AS s FROM c_scored WHERE date = {LAST}) WHERE position <= 10""")
q("custom_weight_scores", f"""SELECT weighting, date, stock_id, {r('composite_score')} AS composite_score,
    dense_rank() OVER (PARTITION BY weighting, date ORDER BY composite_score DESC) AS rank FROM (
    SELECT w.weighting, date, stock_id, w.q * quality_score + w.g * growth_score + w.m * momentum_score + w.v * value_score AS composite_score
    FROM c_factors CROSS JOIN (VALUES ('base', 0.30, 0.25, 0.25, 0.20), ('momentum_heavy', 0.25, 0.20, 0.40, 0.15)) w(weighting, q, g, m, v))""")
q("latest_scoring_date", "SELECT min(date) AS first_date, max(date) AS last_date FROM c_scored")
SNAP = f"""SELECT s.date, s.rank, s.stock_id, t.symbol, t.name, t.sector, {r('s.composite_score')} AS composite_score,
    {r('s.volatility_score')} AS volatility_score FROM c_scored s JOIN c_stocks t USING (stock_id)"""
q("ranked_snapshot_latest", f"{SNAP} WHERE s.date = {LAST}")
q("ranked_snapshot_sector", f"{SNAP} WHERE s.date IN (SELECT score_date FROM c_reb) AND t.sector ILIKE '%ia%'")
q("ranked_snapshot_symbols", f"{SNAP} WHERE s.date = {LAST} AND t.symbol LIKE '%7'")
q("top_stocks_filtered", f"""SELECT date, symbol, rank, {r('composite_score')} AS composite_score FROM c_scored JOIN c_stocks USING (stock_id)
    WHERE lower(sector) = 'asia' AND composite_score >= 0.1 QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank, stock_id) <= 3""")
q("top_stocks", f"""SELECT symbol, rank, {r('composite_score * 100', 2)} AS score, {r('volatility_score * 100', 2)} AS volatility
    FROM c_scored JOIN c_stocks USING (stock_id) WHERE date = {LAST} AND composite_score >= 0 ORDER BY rank, stock_id LIMIT 10""")
q("score_history", f"""SELECT stock_id, date, {r('composite_score')} AS composite_score, rank FROM c_scored
    QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) <= 126""")
q("month_end_calendar", """SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS reb_date, max(idx) AS reb_idx
    FROM c_calendar GROUP BY 1""")
q("rebalance_calendar", "SELECT reb_no, reb_date, reb_idx, score_date, end_date, end_idx FROM c_reb")
W = f"portfolio, reb_no, reb_date, stock_id, {r('weight')} AS weight"
q("equal_weight_portfolios", f"SELECT {W} FROM c_w_eq")
q("inverse_volatility_portfolios", f"SELECT {W} FROM c_w_iv")
q("custom_weight_portfolio", f"""SELECT 'by_market_cap' AS portfolio, reb_no, reb_date, stock_id,
    {r('market_cap / sum(market_cap) OVER (PARTITION BY reb_no)')} AS weight FROM c_cand JOIN c_stocks USING (stock_id) WHERE market_cap > 0""")
q("research_inverse_vol_portfolios", f"""SELECT 'research' AS portfolio, reb_no, reb_date, stock_id, {r('i / sum(i) OVER (PARTITION BY reb_no)')} AS weight
    FROM (SELECT *, 1.0 / greatest(coalesce(volatility_score, 0) + 2.0, 1e-8) AS i FROM c_top20)""")
cte("c_last20", f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rank, stock_id) AS rn FROM c_scored WHERE date = {LAST}) WHERE rn <= 20""")
cte("c_w_last", """SELECT 'equal_weight' AS portfolio, date AS reb_date, stock_id, 1.0 / count(*) OVER () AS weight FROM c_last20
    UNION ALL SELECT 'inverse_volatility', date, stock_id, (1.0 / greatest(volatility_score + 2.0, 1e-8)) /
      sum(1.0 / greatest(volatility_score + 2.0, 1e-8)) OVER () FROM c_last20""")
q("portfolio_construction_checks", f"""SELECT portfolio, reb_date, count(*) AS n_stocks, {r('sum(weight)')} AS weight_sum,
    {r('min(weight)')} AS min_weight, {r('max(weight)')} AS max_weight, {r('sum(weight) FILTER (WHERE k <= 3)')} AS top3_weight
    FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY weight DESC, stock_id) AS k FROM c_w_last) GROUP BY 1, 2""")
q("current_allocation", f"""SELECT w.portfolio, w.reb_date, w.stock_id, {r('w.weight')} AS weight, t.symbol, t.name, t.sector,
    {r('s.composite_score')} AS composite_score, s.rank FROM c_w_last w JOIN c_scored s ON s.stock_id = w.stock_id AND s.date = w.reb_date
    JOIN c_stocks t ON t.stock_id = w.stock_id""")
cte("c_spec", """SELECT r_name AS portfolio, CASE WHEN r_regionkey % 2 = 0 THEN 'equal_weight' ELSE 'inverse_volatility' END AS strategy,
    CASE WHEN r_regionkey % 2 = 0 THEN 'static' ELSE 'volatility_targeting' END AS regime_mode, 5 AS top_n FROM region""")


def user_top(tag: str, cand: str) -> None:
    cte(tag, f"""SELECT p.portfolio, reb_no, reb_date, stock_id, CASE WHEN strategy = 'equal_weight' THEN 1.0 / count(*) OVER k
        ELSE (1.0 / greatest(volatility_score + 2.0, 1e-8)) / sum(1.0 / greatest(volatility_score + 2.0, 1e-8)) OVER k END AS weight
      FROM (SELECT sector AS portfolio, c.*, row_number() OVER (PARTITION BY sector, reb_no ORDER BY rank, c.stock_id) AS rn
        FROM {cand} c JOIN c_stocks t ON t.stock_id = c.stock_id) x JOIN c_spec p ON p.portfolio = x.portfolio AND rn <= top_n
      WINDOW k AS (PARTITION BY p.portfolio, reb_no)""")


user_top("c_w_user", "c_cand")
cte("c_cand_last", f"SELECT 0 AS reb_no, date AS reb_date, stock_id, rank, composite_score, volatility_score FROM c_scored WHERE date = {LAST}")
user_top("c_w_user_last", "c_cand_last")
q("user_portfolio_allocations", f"""SELECT 'user::' || w.portfolio AS strategy_type, w.reb_date AS date, w.stock_id, t.symbol,
    {r('w.weight')} AS weight, {r('s.composite_score')} AS composite_score, s.rank FROM c_w_user_last w
    JOIN c_scored s ON s.stock_id = w.stock_id AND s.date = w.reb_date JOIN c_stocks t ON t.stock_id = w.stock_id""")
backtest_ctes("bt", "c_w_both")
backtest_ctes("us", "c_w_user", target="SELECT CASE WHEN regime_mode = 'volatility_targeting' THEN 0.15 END FROM c_spec s WHERE s.portfolio = n.portfolio")
summary_ctes("bt", "c_bt_curve")
summary_ctes("us", "c_us_curve")
cte("c_uspop_curve", "SELECT * FROM c_us_curve")
summary_ctes("uspop", "c_us_curve", std="stddev_pop")
q("period_returns", f"SELECT portfolio, reb_no, idx, date, {r('ret')} AS daily_return FROM c_bt_raw")
q("transaction_costs", f"SELECT portfolio, reb_no, seq, {r('turnover')} AS turnover, {r('0.002 * turnover')} AS cost FROM c_bt_turn")
CURVE = f"""portfolio, date, {r('daily_return')} AS daily_return, {r('cumulative_return')} AS cumulative_return, {r('drawdown')} AS drawdown"""
q("backtest_equity_curve", f"SELECT {CURVE} FROM c_bt_curve")
q("volatility_targeted_curve", f"SELECT {CURVE} FROM c_us_curve")
q("strategy_comparison", metric_select("c_bt_sum"))
q("derived_metrics", metric_select("c_uspop_sum"))
q("metric_warnings", """SELECT portfolio, concat_ws(',', CASE WHEN n_days / 252.0 < 1 THEN 'duration_lt_1y' END,
    CASE WHEN sharpe > 3 THEN 'sharpe_unrealistic' END, CASE WHEN abs(max_drawdown) < 0.05 THEN 'maxdd_unrealistic' END) AS warnings FROM c_us_sum""")
q("metric_precedence", f"""SELECT a.portfolio, {r('a.cagr')} AS cagr, {r('a.volatility')} AS volatility, {r('a.sharpe')} AS sharpe,
    {r('a.max_drawdown')} AS max_drawdown, {r('a.total_return')} AS total_return, {r('b.sortino')} AS sortino, {r('b.calmar')} AS calmar,
    b.n_days, {r('a.win_rate')} AS win_rate FROM c_us_sum a JOIN c_uspop_sum b USING (portfolio)""")
cte("c_bt_span", "SELECT portfolio, min(idx) AS lo, max(idx) AS hi FROM c_bt_curve GROUP BY 1")
cte("c_bt_names", "SELECT DISTINCT portfolio, stock_id FROM c_w_both")
cte("c_bt_rows", """SELECT n.portfolio, n.stock_id, x.idx, x.ret FROM c_bt_names n JOIN c_bt_span s USING (portfolio)
    JOIN c_panel x ON x.stock_id = n.stock_id AND x.idx > s.lo AND x.idx <= s.hi WHERE x.ret IS NOT NULL""")
q("held_universe_correlation", f"""SELECT portfolio, {r('avg(c)')} AS avg_pairwise_corr FROM (
    SELECT a.portfolio, corr(a.ret, b.ret) AS c FROM c_bt_rows a JOIN c_bt_rows b
      ON a.portfolio = b.portfolio AND a.idx = b.idx AND a.stock_id < b.stock_id GROUP BY a.portfolio, a.stock_id, b.stock_id) GROUP BY 1""")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
