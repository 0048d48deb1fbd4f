"""DuckDB statements for ingest, storage and streaming queries."""

from __future__ import annotations

import checks.hybrid_sql  # noqa: F401
from checks.base import build, cte, r

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


def back(n: int) -> str:
    return f"(SELECT date FROM c_calendar WHERE idx = (SELECT greatest(max(idx) - {n}, min(idx)) FROM c_calendar))"


q("incremental_append", f"""SELECT stock_id, count(*) FILTER (WHERE date > {back(60)}) AS inserted, count(*) FILTER (WHERE date <= {back(60)}) AS skipped
    FROM c_prices WHERE date > {back(90)} GROUP BY 1""")
q("ingest_watermarks", "SELECT stock_id, max(date) AS last_date FROM c_prices GROUP BY 1")
q("normalised_ohlcv", f"""SELECT stock_id, date, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, {r('close + 1e-9')} AS close, {r('volume')} AS volume FROM c_prices""")
q("normalised_universe", "SELECT DISTINCT upper(s_name) || '.NS' AS symbol FROM supplier")
q("universe_upsert", """SELECT symbol, name, sector, CASE WHEN coalesce(market_cap, 0) <= 0 THEN 'inserted' WHEN market_cap <= 5000 AND sector IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM c_stocks""")
q("sector_enrichment", "SELECT symbol, CASE WHEN market_cap > 0 THEN sector ELSE upper(sector) END AS sector FROM c_stocks")
q("score_upsert", f"SELECT date, count(*) AS rows, {r(f'sum(composite_score + CASE WHEN date > {back(30)} THEN 1 ELSE 0 END)')} AS total FROM c_scored GROUP BY 1")
q("portfolio_replace", """SELECT e.reb_date AS date, 'equal_weight' AS strategy_type, least(count(*), 10) AS inserted, count(*) AS deleted, least(count(*), 10) + (SELECT count(*) FROM c_w_iv v WHERE v.reb_date = e.reb_date) AS rows_after
    FROM c_w_eq e GROUP BY 1""")
q("monthly_allocation_append", """SELECT b.reb_date AS rebalance_date, count(*) FILTER (WHERE grp > last - 8) AS inserted, count(*) FILTER (WHERE grp <= last - 8) AS skipped FROM c_hy_w w JOIN c_reb b ON b.reb_no = w.grp
    CROSS JOIN (SELECT max(reb_no) AS last FROM c_reb) WHERE grp >= last - 13 GROUP BY 1""")
cte("c_snap", "SELECT b.reb_date AS rebalance_date, s.* FROM c_hy_stats s JOIN c_reb b ON b.reb_no = s.grp")
SNAP = f"""'auto_hybrid' AS portfolio_type, rebalance_date, {r('es')} AS cagr, {r('ev')} AS volatility, {r('es')} AS sharpe, CAST(0.0 AS DOUBLE) AS max_drawdown, CAST(0.0 AS DOUBLE) AS calmar, n_stocks,
    {r('ev')} AS expected_volatility, {r('es')} AS expected_sharpe, {r('ac')} AS avg_pairwise_corr"""
q("metrics_snapshot_append", f"SELECT {SNAP} FROM c_snap WHERE rebalance_date > {back(200)}")
q("allocation_history", f"""SELECT b.reb_date AS rebalance_date, stock_id, {r('weight')} AS weight, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, stock_id) AS position
    FROM c_hy_w w JOIN c_reb b ON b.reb_no = w.grp""")
q("latest_metrics_snapshot", f"SELECT {SNAP} FROM c_snap ORDER BY rebalance_date DESC LIMIT 1")
q("saved_portfolios", "SELECT p.portfolio, strategy, regime_mode, top_n, symbol FROM c_spec p LEFT JOIN c_stocks s ON s.sector = p.portfolio")
q("rebalance_state", f"SELECT rebalance_date, n_stocks, {r('ev')} AS expected_volatility, {r('es')} AS expected_sharpe FROM c_snap ORDER BY rebalance_date DESC LIMIT 36")
q("monthly_rebalance_guard", """SELECT 1 AS user_id, date AS call_date, CASE WHEN date = min(date) OVER (PARTITION BY date_trunc('month', date)) THEN 'rebalanced' ELSE 'skipped' END AS status FROM c_calendar""")
q("table_health", """SELECT 'stocks' AS table_name, count(*) AS rows, CAST(NULL AS DATE) AS max_date FROM c_stocks UNION ALL SELECT 'prices', count(*), max(date) FROM c_prices
    UNION ALL SELECT 'scores', count(*), max(date) FROM c_scored UNION ALL SELECT 'orders', count(*), CAST(max(o_orderdate) AS DATE) FROM orders UNION ALL SELECT 'events', count(*), CAST(max(ts) AS DATE) FROM events""")
q("positions_per_user", f"""SELECT user_id, count(*) AS positions, {r('sum(q)')} AS quantity FROM (SELECT o_custkey AS user_id, l_suppkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY 1, 2) GROUP BY 1""")
cte("c_bars", """SELECT user_id AS key, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY 1, 2""")
BARS = f"SELECT key, date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume FROM c_bars"
q("daily_bars", BARS)
q("streamed_daily_bars", f"{BARS} WHERE CAST(date + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
q("streamed_price_ingest", f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS rows, {r('sum(volume)')} AS volume FROM c_prices GROUP BY 1")
q("streamed_rescoring", f"""SELECT date, count(*) AS rows, max(rank) AS worst_rank, {r('sum(abs(composite_score))')} AS total FROM c_scored GROUP BY 1""")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
