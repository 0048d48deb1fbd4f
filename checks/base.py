"""DuckDB building blocks: the same tables as the Spark plans, written independently as SQL.

``build`` puts the CTEs that a statement mentions (names start with ``c_``) in
front of it, in dependency order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = " ".join(sql.split())


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\bc_\w+\b", sql)) if n in CTES]


def build(sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(CTES[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    sql = " ".join(sql.split())
    for n in _needs(sql):
        visit(n)
    if not order:
        return sql
    heads = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {heads} {sql}"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


cte("c_stocks", """SELECT s_suppkey AS stock_id, s_name AS symbol, s_name AS name, r_name AS sector, s_acctbal AS market_cap
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("c_trades", """SELECT l_suppkey AS stock_id, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) AS v, sum(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2""")
cte("c_prices", """SELECT stock_id, date, close, q AS volume FROM (
    SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS rn,
      sum(v) OVER w60 / sum(q) OVER w60 AS close FROM c_trades
    WINDOW w60 AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE rn >= 60""")
cte("c_calendar", """SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM c_prices)""")
cte("c_panel", """SELECT stock_id, idx, date, close, close / lag(close) OVER (PARTITION BY stock_id ORDER BY idx) - 1 AS ret FROM (
    SELECT s.stock_id, c.idx, c.date,
      last_value(p.close IGNORE NULLS) OVER (PARTITION BY s.stock_id ORDER BY c.idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
    FROM (SELECT DISTINCT stock_id FROM c_prices) s CROSS JOIN c_calendar c
    LEFT JOIN c_prices p ON p.stock_id = s.stock_id AND p.date = c.date) WHERE close IS NOT NULL""")
cte("c_raw", """SELECT * FROM (SELECT stock_id, idx, date,
      close / lag(close, 126) OVER w - 1 AS momentum_6m, close / lag(close, 252) OVER w - 1 AS momentum_12m,
      CASE WHEN count(ret) OVER f >= 252 THEN stddev_samp(ret) OVER f * sqrt(252) END AS volatility FROM c_panel
    WINDOW w AS (PARTITION BY stock_id ORDER BY idx),
      f AS (PARTITION BY stock_id ORDER BY idx ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
  WHERE momentum_6m IS NOT NULL AND momentum_12m IS NOT NULL AND volatility IS NOT NULL""")
cte("c_stats", """SELECT date, count(*) AS n, avg(momentum_6m) AS a6, stddev_samp(momentum_6m) AS s6,
    avg(momentum_12m) AS a12, stddev_samp(momentum_12m) AS s12, avg(volatility) AS av, stddev_samp(volatility) AS sv
  FROM c_raw GROUP BY date HAVING count(*) >= 5""")
cte("c_factors", """SELECT stock_id, date, 0.0 AS value_score, 0.0 AS quality_score, 0.0 AS growth_score,
    ((CASE WHEN s6 > 0 THEN (momentum_6m - a6) / s6 ELSE 0.0 END)
      + (CASE WHEN s12 > 0 THEN (momentum_12m - a12) / s12 ELSE 0.0 END)) / 2 AS momentum_score,
    -(CASE WHEN sv > 0 THEN (volatility - av) / sv ELSE 0.0 END) AS volatility_score
  FROM c_raw JOIN c_stats USING (date)""")
cte("c_scored", """SELECT *, dense_rank() OVER (PARTITION BY date ORDER BY composite_score DESC) AS rank FROM (
    SELECT *, 0.30 * quality_score + 0.25 * growth_score + 0.25 * momentum_score + 0.20 * value_score AS composite_score
    FROM c_factors)""")
cte("c_reb", """SELECT row_number() OVER (ORDER BY reb_date) AS reb_no, reb_date, reb_idx, score_date,
    coalesce(lead(reb_date) OVER (ORDER BY reb_date), (SELECT max(date) FROM c_calendar)) AS end_date,
    coalesce(lead(reb_idx) OVER (ORDER BY reb_date), (SELECT max(idx) FROM c_calendar)) AS end_idx
  FROM (SELECT m.reb_date, m.reb_idx, max(s.date) AS score_date FROM (
      SELECT max(date) AS reb_date, max(idx) AS reb_idx FROM c_calendar GROUP BY date_trunc('month', date)) m
    JOIN c_stats s ON s.date <= m.reb_date GROUP BY 1, 2)""")
cte("c_cand", """SELECT reb_no, reb_date, stock_id, rank, composite_score, volatility_score
  FROM c_scored s JOIN c_reb b ON s.date = b.score_date""")
cte("c_top20", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reb_no ORDER BY rank, stock_id) AS rn FROM c_cand)
  WHERE rn <= 20""")
cte("c_w_eq", """SELECT 'equal_weight' AS portfolio, reb_no, reb_date, stock_id,
    1.0 / count(*) OVER (PARTITION BY reb_no) AS weight FROM c_top20""")
cte("c_w_iv", """SELECT 'inverse_volatility' AS portfolio, reb_no, reb_date, stock_id,
    (1.0 / greatest(volatility_score + 2.0, 1e-8)) / sum(1.0 / greatest(volatility_score + 2.0, 1e-8)) OVER (PARTITION BY reb_no) AS weight
  FROM c_top20 WHERE volatility_score IS NOT NULL""")
cte("c_w_both", "SELECT * FROM c_w_eq UNION ALL SELECT * FROM c_w_iv")


def backtest_ctes(tag: str, weights: str, periods: str = "c_reb", by_portfolio: bool = False, target: str | None = None) -> None:
    """Register c_<tag>_ret (net daily returns) and c_<tag>_curve for a weights CTE."""
    extra = " AND p.portfolio = w.portfolio" if by_portfolio else ""
    cte(f"c_{tag}_held", f"""SELECT w.portfolio, w.reb_no, w.stock_id, w.weight, p.reb_idx, x.idx, x.date, x.ret
      FROM {weights} w JOIN {periods} p ON p.reb_no = w.reb_no{extra}
      JOIN c_panel x ON x.stock_id = w.stock_id AND x.idx BETWEEN p.reb_idx AND p.end_idx""")
    cte(f"c_{tag}_raw", f"""SELECT h.portfolio, h.reb_no, h.idx, h.date,
        sum(h.weight * h.ret) / CASE WHEN any_value(t.total) > 0 THEN any_value(t.total) ELSE 1 END AS ret
      FROM c_{tag}_held h JOIN (SELECT portfolio, reb_no, sum(weight) AS total FROM
          (SELECT DISTINCT portfolio, reb_no, stock_id, weight FROM c_{tag}_held) GROUP BY 1, 2) t
        ON t.portfolio = h.portfolio AND t.reb_no = h.reb_no
      WHERE h.idx > h.reb_idx AND h.ret IS NOT NULL GROUP BY 1, 2, 3, 4""")
    cte(f"c_{tag}_used", f"""SELECT portfolio, reb_no, row_number() OVER (PARTITION BY portfolio ORDER BY reb_no) AS seq
      FROM (SELECT DISTINCT portfolio, reb_no FROM c_{tag}_raw)""")
    cte(f"c_{tag}_seqw", f"""SELECT w.portfolio, u.seq, w.stock_id, w.weight FROM {weights} w
      JOIN c_{tag}_used u ON u.portfolio = w.portfolio AND u.reb_no = w.reb_no""")
    cte(f"c_{tag}_turn", f"""SELECT u.portfolio, u.reb_no, u.seq, sum(abs(coalesce(d.nw, 0) - coalesce(d.ow, 0))) AS turnover
      FROM c_{tag}_used u JOIN (
        SELECT coalesce(n.portfolio, o.portfolio) AS portfolio, coalesce(n.seq, o.seq + 1) AS seq, n.weight AS nw, o.weight AS ow
        FROM c_{tag}_seqw n FULL OUTER JOIN c_{tag}_seqw o
          ON n.portfolio = o.portfolio AND n.seq = o.seq + 1 AND n.stock_id = o.stock_id) d
        ON d.portfolio = u.portfolio AND d.seq = u.seq GROUP BY 1, 2, 3""")
    cte(f"c_{tag}_net", f"""SELECT portfolio, idx, date, reb_no, ret FROM (SELECT r.portfolio, r.idx, r.date, r.reb_no,
        r.ret - CASE WHEN row_number() OVER (PARTITION BY r.portfolio, r.reb_no ORDER BY r.idx) = 1
          THEN 0.002 * t.turnover ELSE 0 END AS ret
      FROM c_{tag}_raw r JOIN c_{tag}_turn t ON t.portfolio = r.portfolio AND t.reb_no = r.reb_no)
      QUALIFY row_number() OVER (PARTITION BY portfolio, date ORDER BY reb_no DESC) = 1""")
    src = f"c_{tag}_net"
    if target:
        cte(f"c_{tag}_vt", f"""SELECT portfolio, idx, date, reb_no, CASE WHEN tv > 0 THEN ret * CASE WHEN vol > 0
            THEN greatest(0.5, least(1.5, tv / vol)) ELSE 1.0 END ELSE ret END AS ret
          FROM (SELECT n.*, ({target}) AS tv, stddev_samp(ret) OVER (PARTITION BY portfolio ORDER BY idx
            ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * sqrt(252) AS vol FROM c_{tag}_net n)""")
        src = f"c_{tag}_vt"
    curve_ctes(tag, src)


def curve_ctes(tag: str, src: str) -> None:
    """Register c_<tag>_curve(portfolio, date, idx, daily_return, cumulative_return, drawdown)."""
    cte(f"c_{tag}_curve", f"""SELECT portfolio, idx, date, reb_no, ret AS daily_return, c - 1 AS cumulative_return, (c - m) / m AS drawdown
      FROM (SELECT *, max(c) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (
        SELECT *, product(1 + ret) OVER (PARTITION BY portfolio ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM {src}))""")


def summary_ctes(tag: str, curve: str, std: str = "stddev_samp", key: str = "portfolio") -> None:
    """Register c_<tag>_sum with the metric columns of a curve."""
    cte(f"c_{tag}_sum", f"""SELECT b.{key}, b.start_date, b.end_date, b.n_days, b.total_return,
        pow(1 + b.total_return, 252.0 / b.n_days) - 1 AS cagr, b.vol AS volatility,
        CASE WHEN b.vol > 0 THEN b.mean * 252 / b.vol ELSE 0.0 END AS sharpe,
        CASE WHEN b.down > 0 THEN b.mean * 252 / (b.down * sqrt(252)) ELSE 0.0 END AS sortino,
        CASE WHEN b.max_drawdown < 0 THEN (pow(1 + b.total_return, 252.0 / b.n_days) - 1) / abs(b.max_drawdown)
          ELSE CAST('inf' AS DOUBLE) END AS calmar, b.max_drawdown, m.win_rate
      FROM (SELECT {key}, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days, product(1 + daily_return) - 1 AS total_return,
          avg(daily_return) AS mean, coalesce({std}(daily_return) * sqrt(252), 0.0) AS vol, min(drawdown) AS max_drawdown,
          sqrt(avg(pow(least(daily_return, 0.0), 2))) AS down FROM {curve} GROUP BY 1) b
      JOIN (SELECT {key}, avg(CASE WHEN g - 1 > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM (
          SELECT {key}, date_trunc('month', date) AS mo, product(1 + daily_return) AS g FROM {curve} GROUP BY 1, 2) GROUP BY 1) m
        ON m.{key} = b.{key}""")


METRICS = ["total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "win_rate"]


def metric_select(src: str, key: str = "portfolio") -> str:
    cols = ", ".join(f"{r(m)} AS {m}" for m in METRICS)
    return f"SELECT {key}, start_date, end_date, n_days, {cols} FROM {src}"
