"""DuckDB statements for sector, tracker, signal and view queries."""

from __future__ import annotations

import checks.core_sql  # noqa: F401
import checks.risk_sql as rs
from checks.base import build, cte, r

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


LAST = "(SELECT max(date) FROM c_scored)"
q("sector_map", """SELECT stock_id, symbol, sector, row_number() OVER (PARTITION BY sector ORDER BY symbol, stock_id) AS position
    FROM c_stocks WHERE sector IS NOT NULL AND sector <> ''""")


def sector_cte(tag: str, start: str) -> None:
    cte(f"c_{tag}_r", f"""SELECT p.stock_id, t.sector, p.date, CASE WHEN p.idx > (SELECT min(idx) FROM c_calendar WHERE date >= {start}) THEN p.ret END AS ret
        FROM c_panel p JOIN c_stocks t USING (stock_id) WHERE p.date >= {start} AND p.date <= {LAST} AND t.sector IS NOT NULL""")
    cte(f"c_{tag}_d", f"SELECT sector, date, avg(ret) AS x FROM c_{tag}_r WHERE ret IS NOT NULL GROUP BY 1, 2")
    cte(f"c_{tag}_c", f"""SELECT *, (c - max(c) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(c) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS dd
        FROM (SELECT *, product(1 + x) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM c_{tag}_d)""")
    cte(f"c_{tag}_perf", f"""SELECT sector, n_stocks, pow(1 + tr, 252.0 / n) - 1 AS cagr, CASE WHEN v > 0 THEN m * 252 / v ELSE 0 END AS sharpe, mdd AS max_drawdown,
        v AS volatility, avg_score FROM (SELECT sector, count(*) AS n, product(1 + x) - 1 AS tr, avg(x) AS m, stddev_pop(x) * sqrt(252) AS v, min(dd) AS mdd FROM c_{tag}_c GROUP BY 1)
        JOIN (SELECT sector, count(*) AS n_stocks, coalesce(avg(composite_score), 0) AS avg_score FROM (SELECT DISTINCT stock_id, sector FROM c_{tag}_r) d
          LEFT JOIN (SELECT stock_id, composite_score FROM c_scored WHERE date = {LAST}) s USING (stock_id) GROUP BY 1) USING (sector) WHERE n >= 5""")


sector_cte("sa", "DATE '1900-01-01'")
sector_cte("sh", f"({LAST} - 180)")
PERF = ", ".join(f"{r(c)} AS {c}" for c in ("cagr", "sharpe", "max_drawdown", "volatility", "avg_score"))
q("sector_performance", f"SELECT sector, n_stocks, {PERF} FROM c_sa_perf")
q("sector_exposure", f"""SELECT portfolio, reb_no, sector, {r('w')} AS weight, n_stocks, {r('w / sum(w) OVER (PARTITION BY portfolio, reb_no) * 100')} AS pct,
    row_number() OVER (PARTITION BY portfolio, reb_no ORDER BY CASE WHEN sector = 'Unclassified' THEN 1 ELSE 0 END, w DESC, sector) AS position
    FROM (SELECT portfolio, reb_no, coalesce(sector, 'Unclassified') AS sector, sum(weight) AS w, count(*) AS n_stocks FROM c_w_both LEFT JOIN c_stocks USING (stock_id) GROUP BY 1, 2, 3)""")
q("sector_rankings", f"""SELECT p.sector, n_stocks, {PERF}, sector_rank, position, symbol, rank, {r('score')} AS score FROM
    (SELECT *, row_number() OVER (ORDER BY cagr DESC, sector) AS sector_rank FROM c_sh_perf) p LEFT JOIN (
      SELECT t.sector, t.symbol, s.rank, s.composite_score AS score, row_number() OVER (PARTITION BY t.sector ORDER BY s.rank, s.stock_id) AS position
      FROM c_scored s JOIN c_stocks t USING (stock_id) WHERE s.date = {LAST}) x ON x.sector = p.sector AND position <= 3 WHERE sector_rank <= 10""")
cte("c_pos", """SELECT o_custkey AS user_id, upper(s_name) AS symbol, sum(l_extendedprice) AS invested_amount, sum(l_quantity) AS quantity FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
q("tracker_positions", f"SELECT user_id, symbol, {r('round(invested_amount, 2)')} AS invested_amount, {r('quantity')} AS quantity FROM c_pos WHERE quantity >= 20")
cte("c_lastp", "SELECT upper(symbol) AS symbol, arg_max(close, date) AS current_price, max(date) AS price_date FROM c_prices JOIN c_stocks USING (stock_id) GROUP BY 1")
q("latest_prices", f"SELECT symbol, {r('current_price + 1e-9')} AS current_price, price_date FROM c_lastp")


def valued(src: str) -> str:
    return f"""SELECT user_id, symbol, CAST(CAST(invested_amount AS FLOAT) AS DOUBLE) AS invested_amount, CAST(CAST(quantity AS FLOAT) AS DOUBLE) AS quantity, CAST(CAST(current_price AS FLOAT) AS DOUBLE) AS current_price, price_date,
      price_source, CAST(CAST(invested_amount / quantity AS FLOAT) AS DOUBLE) AS average_cost, CAST(CAST(current_price * quantity AS FLOAT) AS DOUBLE) AS current_amount, CAST(CAST(current_price * quantity - invested_amount AS FLOAT) AS DOUBLE) AS pnl,
      CAST(CAST((current_price * quantity - invested_amount) / invested_amount AS FLOAT) AS DOUBLE) AS pnl_pct FROM {src}"""


cte("c_val", "SELECT p.*, l.current_price, l.price_date, 'database' AS price_source FROM c_pos p LEFT JOIN c_lastp l USING (symbol)")
q("tracker_valuation", valued("c_val"))
q("tracker_summary", f"""SELECT user_id, CAST(CAST(ti AS FLOAT) AS DOUBLE) AS total_invested, CAST(CAST(tc AS FLOAT) AS DOUBLE) AS total_current, pp AS priced_positions, tp AS total_positions, d AS latest_price_date,
    CAST(CAST(tc - ti AS FLOAT) AS DOUBLE) AS total_pnl, CAST(CAST((tc - ti) / ti AS FLOAT) AS DOUBLE) AS total_pnl_pct FROM (SELECT user_id, sum(invested_amount) AS ti, sum(coalesce(current_price * quantity, 0)) AS tc,
    count(current_price) AS pp, count(*) AS tp, max(price_date) AS d FROM c_val GROUP BY 1)""")
cte("c_ovl", """SELECT p.*, CASE WHEN t.market_cap > 0 THEN l.current_price * 1.02 ELSE l.current_price END AS current_price,
    CASE WHEN t.market_cap > 0 AND l.current_price IS NOT NULL THEN l.price_date + 1 ELSE l.price_date END AS price_date,
    CASE WHEN t.market_cap > 0 AND l.current_price IS NOT NULL THEN 'live' ELSE 'database' END AS price_source
    FROM c_pos p LEFT JOIN c_lastp l USING (symbol) JOIN c_stocks t ON upper(t.symbol) = p.symbol""")
q("tracker_overlay", valued("c_ovl"))
cte("c_latest", "SELECT * FROM c_scored QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) = 1")
q("latest_scores", f"SELECT stock_id, date, {r('composite_score')} AS composite_score, rank, {r('momentum_score')} AS momentum_score, {r('volatility_score')} AS volatility_score FROM c_latest")
cte("c_trend", """SELECT stock_id, CASE WHEN n < 2 THEN 'stable' WHEN b - a >= 0.15 THEN 'improving' WHEN b - a <= -0.15 THEN 'declining' ELSE 'stable' END AS trend_direction FROM (
    SELECT s.stock_id, count(*) AS n, arg_min(s.composite_score, s.date) AS a, arg_max(s.composite_score, s.date) AS b FROM c_scored s JOIN c_latest l ON l.stock_id = s.stock_id
    AND s.date BETWEEN l.date - 90 AND l.date GROUP BY 1)""")
q("score_trend", "SELECT stock_id, trend_direction FROM c_trend")
rs.spans_cte("c_spans_sig", 403, "SELECT 0 AS grp, max(date) AS as_of FROM c_scored")
cte("c_sig_sets", "SELECT f.stock_id AS grp, f.stock_id, greatest(s.lo, f.f) AS lo, s.hi FROM c_first f CROSS JOIN c_spans_sig s")
rs.grid_ctes("sig", "c_sig_sets")
rs.rrc_ctes("sig")
rs.sls_ctes("sig")
q("single_stock_stop_loss", f"SELECT stock_id, {rs.PROFILE} FROM c_sig_sls")
cte("c_signals", """SELECT *, CASE WHEN signal_strength >= 4 AND trend_direction = 'improving' THEN 'Buy' WHEN signal_strength <= 2 AND trend_direction = 'declining' THEN 'Reduce' ELSE 'Hold' END AS recommendation
    FROM (SELECT l.stock_id, l.date, l.composite_score, l.momentum_score, l.volatility_score, l.rank, n.n_stocks, t.trend_direction,
      CASE WHEN l.volatility_score > 0 THEN 'high_vol' ELSE 'low_vol' END AS regime,
      least(5, greatest(1, 1 + CAST(floor((1.0 - (l.rank - 1.0) / n.n_stocks) * 5) AS INTEGER))) AS signal_strength,
      coalesce(s.s, 50) AS stop_loss_score, coalesce(s.recommended_action, 'Hold') AS stop_loss_action
    FROM c_latest l JOIN (SELECT date, count(DISTINCT stock_id) AS n_stocks FROM c_scored GROUP BY 1) n ON n.date = l.date JOIN c_trend t ON t.stock_id = l.stock_id
    LEFT JOIN c_sig_sls s ON s.stock_id = l.stock_id)""")
q("stock_signals", f"""SELECT stock_id, date, {r('composite_score')} AS composite_score, {r('momentum_score')} AS momentum_score, {r('volatility_score')} AS volatility_score,
    rank, n_stocks, trend_direction, regime, signal_strength, recommendation, {r('stop_loss_score')} AS stop_loss_score, stop_loss_action FROM c_signals""")
cte("c_uns", """SELECT *, 0.25 * mom AS comp, 0.25 * ((q6 - 0.075) / 0.15 + (q12 - 0.15) / 0.20) / 2 AS past FROM (SELECT *, ((m6 - 0.075) / 0.15 + (m12 - 0.15) / 0.20) / 2 AS mom FROM (
    SELECT stock_id, p1 / p126 - 1 AS m6, coalesce(p1 / p252 - 1, p1 / p126 - 1) AS m12, coalesce(p63 / p189 - 1, 0) AS q6, coalesce(p63 / p315 - 1, p63 / p189 - 1, 0) AS q12,
      CASE WHEN n >= 126 THEN -(std * sqrt(252) - 0.25) / 0.15 END AS volatility_score FROM (
      SELECT stock_id, max(close) FILTER (WHERE k = 1) AS p1, max(close) FILTER (WHERE k = 63) AS p63, max(close) FILTER (WHERE k = 126) AS p126, max(close) FILTER (WHERE k = 189) AS p189,
        max(close) FILTER (WHERE k = 252) AS p252, max(close) FILTER (WHERE k = 315) AS p315, count(r) FILTER (WHERE k <= 252) AS n, stddev_samp(r) FILTER (WHERE k <= 252) AS std
      FROM (SELECT *, close / lag(close) OVER (PARTITION BY stock_id ORDER BY date) - 1 AS r, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS k FROM c_prices) GROUP BY 1)
    WHERE p126 IS NOT NULL))""")
q("unscored_stock_signals", f"""SELECT stock_id, {r('comp')} AS composite_score, {r('mom')} AS momentum_score, {r('volatility_score')} AS volatility_score, rank, trend_direction, regime, signal_strength,
    CASE WHEN signal_strength >= 4 AND trend_direction = 'improving' THEN 'Buy' WHEN signal_strength <= 2 AND trend_direction = 'declining' THEN 'Reduce' ELSE 'Hold' END AS recommendation FROM (
    SELECT *, least(5, greatest(1, 1 + CAST(floor((1.0 - (rank - 1) / 500.0) * 5) AS INTEGER))) AS signal_strength FROM (SELECT *,
      CASE WHEN comp > past + 0.1 THEN 'improving' WHEN comp < past - 0.1 THEN 'declining' ELSE 'stable' END AS trend_direction, CASE WHEN volatility_score > 0 THEN 'high_vol' ELSE 'low_vol' END AS regime,
      CAST(floor(round((1 - least(0.99, greatest(0.01, 0.5 + comp / 3.0))) * 500, 9)) AS INTEGER) AS rank FROM c_uns))""")
cte("c_rec", """SELECT *, CASE WHEN s2 >= 4 AND trend_direction = 'improving' AND sls < 40 THEN 'High' WHEN s2 >= 3 AND trend_direction <> 'declining' AND sls < 60 THEN 'Medium' ELSE 'Low' END AS conviction FROM (
    SELECT *, stop_loss_score AS sls, CASE WHEN stop_loss_score > 80 THEN 'Exit' WHEN stop_loss_score > 60 THEN CASE recommendation WHEN 'Buy' THEN 'Hold' WHEN 'Hold' THEN 'Reduce' ELSE recommendation END
      ELSE recommendation END AS rec2, CASE WHEN stop_loss_score > 80 THEN 1 WHEN stop_loss_score > 60 THEN least(signal_strength, 2) ELSE signal_strength END AS s2 FROM c_signals)""")
q("recommendations", f"""SELECT stock_id, risk_profile, rec2 AS recommendation, conviction, CAST(0.0 AS DOUBLE) AS allocation_min,
    {r('CASE WHEN sls > 80 THEN 0.0 ELSE mx * CASE WHEN s2 <= 2 THEN 0.4 WHEN s2 = 3 THEN 0.7 ELSE 1.0 END END')} AS allocation_max,
    {r('0.6 * least(1, greatest(0, coalesce(composite_score, 50) / 100)) - 0.3 * least(1, greatest(0, sls / 100)) + 0.1 * 0.5')} AS final_stock_score, {r('sls')} AS stop_loss_score
    FROM c_rec CROSS JOIN (VALUES ('conservative', 0.05), ('moderate', 0.10), ('aggressive', 0.15)) p(risk_profile, mx)""")
q("recommendation_texts", """SELECT stock_id, risk_profile, conviction, rec2 AS recommendation, 'Place ' || rank || ' by composite score with a trend that is ' || trend_direction || '. Strength ' || s2 || ' of 5, held with '
      || lower(conviction) || ' conviction. The stop-loss score is ' || printf('%.1f', sls) || ' of 100.' || CASE WHEN regime = 'high_vol' THEN ' Hold less while volatility is high.' ELSE '' END AS explanation,
    CASE WHEN c = '' THEN 'No warnings: volatility is low, so the usual size is fine.' ELSE c END AS risk_commentary FROM (SELECT *, concat_ws(' ',
      CASE WHEN regime = 'high_vol' THEN 'Large swings: the stock is in the high-volatility group.' END,
      CASE WHEN sls > 80 THEN 'Stop-loss score ' || printf('%.1f', sls) || ' is over 80, so the position should be closed.'
        WHEN sls > 60 THEN 'Stop-loss score ' || printf('%.1f', sls) || ' is over 60: set a closer stop or hold less.' END) AS c FROM c_rec)
    CROSS JOIN (VALUES ('conservative'), ('moderate'), ('aggressive')) p(risk_profile)""")
cte("c_fund", """SELECT l_suppkey AS stock_id, strftime(l_shipdate, '%Y') || '-Q' || quarter(l_shipdate) AS quarter, sum(l_extendedprice * (1 - l_discount)) AS revenue,
    sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) - sum(l_extendedprice * 0.8) AS net_income FROM lineitem GROUP BY 1, 2""")
q("fundamentals_by_quarter", f"SELECT stock_id, quarter, {r('revenue', 4)} AS revenue, {r('net_income', 4)} AS net_income FROM c_fund")
q("stock_summaries", f"""SELECT symbol, {r('composite_score * 100', 2)} AS composite_score, rank, {r('momentum_score * 100', 2)} AS momentum, {r('volatility_score * 100', 2)} AS volatility,
    CAST(NULL AS DOUBLE) AS quality, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS growth, quarter AS period, {r('revenue', 2)} AS revenue, {r('net_income', 2)} AS net_income,
    CAST(NULL AS DOUBLE) AS eps, CAST(NULL AS DOUBLE) AS roe, regime AS current_regime, trend_direction, recommendation FROM c_signals JOIN c_stocks USING (stock_id)
    LEFT JOIN (SELECT * FROM c_fund QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY quarter DESC) = 1) f USING (stock_id)""")
cte("c_review", "SELECT sector AS portfolio, symbol, composite_score * 100 AS score, recommendation, rank FROM c_signals JOIN c_stocks USING (stock_id)")
q("portfolio_reviews", f"SELECT portfolio, symbol, {r('score', 4)} AS score, recommendation, rank FROM c_review")
q("recommendation_counts", """SELECT portfolio, count(*) FILTER (WHERE recommendation = 'Buy') AS buy, count(*) FILTER (WHERE recommendation = 'Hold') AS hold,
    count(*) FILTER (WHERE recommendation = 'Reduce') AS reduce, count(*) AS stock_count FROM c_review GROUP BY 1""")
cte("c_wanted", "SELECT DISTINCT x AS query FROM (SELECT lower(r_name) AS x FROM region UNION ALL SELECT substr(r_name, 1, 3) FROM region UNION ALL SELECT 'zz' || substr(r_name, 1, 1) FROM region)")
q("portfolio_lookup", """SELECT query, portfolio, CASE WHEN portfolio IS NULL THEN (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) END AS available FROM c_wanted LEFT JOIN (
    SELECT query, arg_min(r_name, (k, r_name)) AS portfolio FROM (SELECT query, r_name, CASE WHEN lower(r_name) = lower(query) THEN 0 WHEN contains(lower(r_name), lower(query)) OR contains(lower(query), lower(r_name)) THEN 1 END AS k
      FROM c_wanted CROSS JOIN region) WHERE k IS NOT NULL GROUP BY 1) USING (query)""")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
