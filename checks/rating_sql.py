"""DuckDB statements for stability, regime and rating queries."""

from __future__ import annotations

import checks.core_sql  # noqa: F401
from checks.base import build, cte, r

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


def score(raw: str, bad: str) -> str:
    return f"greatest(0, least(100, 100 * (1 - ({raw}) / ({bad}))))"


def stability_ctes(tag: str, curve: str, turn: str | None = None, corr: str | None = None) -> None:
    cte(f"c_{tag}_n", f"""SELECT portfolio, date, daily_return AS r, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS rn,
        count(*) OVER (PARTITION BY portfolio) AS n FROM {curve}""")
    cte(f"c_{tag}_w", f"""SELECT *, CASE WHEN n >= 252 THEN 252 ELSE n // 2 END AS w FROM c_{tag}_n WHERE n >= 63""")
    cte(f"c_{tag}_rx", f"""SELECT a.portfolio, a.date, a.rn, a.w, b.rn AS k, b.r, product(1 + b.r) OVER (PARTITION BY a.portfolio, a.rn ORDER BY b.rn ROWS UNBOUNDED PRECEDING) AS c
        FROM c_{tag}_w a JOIN c_{tag}_w b ON b.portfolio = a.portfolio AND b.rn > a.rn - a.w AND b.rn <= a.rn WHERE a.rn >= a.w // 2""")
    cte(f"c_{tag}_ry", f"""SELECT *, max(c) OVER (PARTITION BY portfolio, rn ORDER BY k ROWS UNBOUNDED PRECEDING) AS pk FROM c_{tag}_rx""")
    cte(f"c_{tag}_roll", f"""SELECT portfolio, date, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS rolling_sharpe,
        pow(arg_max(c, k), 252.0 / any_value(w)) - 1 AS rolling_cagr, min((c - pk) / pk) AS rolling_maxdd FROM c_{tag}_ry GROUP BY portfolio, date""")
    cte(f"c_{tag}_v", f"""SELECT *, CASE WHEN count(r) OVER f >= 10 THEN round(stddev_samp(r) OVER f, 12) END AS v FROM c_{tag}_n
        WINDOW f AS (PARTITION BY portfolio ORDER BY date ROWS 19 PRECEDING)""")
    cte(f"c_{tag}_rg", f"""SELECT v.portfolio, count(*) AS n_days,
        coalesce(avg(r) FILTER (WHERE v >= md) / nullif(stddev_samp(r) FILTER (WHERE v >= md), 0) * sqrt(252), 0) AS sh,
        coalesce(avg(r) FILTER (WHERE v < md) / nullif(stddev_samp(r) FILTER (WHERE v < md), 0) * sqrt(252), 0) AS sl,
        coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sa
        FROM c_{tag}_v v JOIN (SELECT portfolio, median(v) AS md FROM c_{tag}_v GROUP BY 1) t ON t.portfolio = v.portfolio GROUP BY 1""")
    cte(f"c_{tag}_regime", f"""SELECT portfolio, n_days, CASE WHEN n_days < 120 THEN 0 ELSE sh END AS regime_sharpe_high,
        CASE WHEN n_days < 120 THEN 0 ELSE sl END AS regime_sharpe_low, CASE WHEN n_days < 120 THEN 0 ELSE gap END AS regime_sharpe_gap,
        CASE WHEN n_days < 120 THEN 50 ELSE {score('gap', 'greatest(2.0, abs(sa) * 1.5)')} END AS regime_score FROM (SELECT *,
        CASE WHEN least(sh, sl) >= 0 THEN greatest(0, abs(sh - sl) - greatest(sh, sl) * 0.75)
          WHEN least(sh, sl) > -0.5 THEN greatest(0, abs(sh - sl) - greatest(sh, sl) * 0.25) ELSE abs(sh - sl) END AS gap FROM c_{tag}_rg)""")
    t = f"(SELECT portfolio, avg(turnover) / 2 AS x FROM {turn} WHERE seq > 1 GROUP BY 1)" if turn else "(SELECT NULL AS portfolio, NULL AS x)"
    c = (f"""(SELECT portfolio, CASE WHEN count(*) >= 3 THEN avg(d) END AS x FROM (SELECT portfolio, abs(avg_pairwise_corr -
        lag(avg_pairwise_corr) OVER (PARTITION BY portfolio ORDER BY seq)) AS d FROM {corr} WHERE avg_pairwise_corr IS NOT NULL) GROUP BY 1)"""
         if corr else "(SELECT NULL AS portfolio, NULL AS x)")
    cte(f"c_{tag}_parts", f"""SELECT g.portfolio, g.n_days, g.regime_sharpe_high, g.regime_sharpe_low, g.regime_sharpe_gap, g.regime_score AS regime_robustness,
        a.*, t.x AS avg_turnover, d.x AS avg_corr_drift,
        CASE WHEN ks >= 3 THEN {score('rolling_sharpe_std', '2.0')} ELSE 50 END AS sharpe_consistency,
        CASE WHEN km >= 3 THEN {score('mdd_std', '0.20')} ELSE 50 END AS drawdown_stability,
        CASE WHEN t.x IS NOT NULL THEN {score('t.x', '1.0')} ELSE 50 END AS turnover_penalty,
        CASE WHEN d.x IS NOT NULL THEN {score('d.x', '0.30')} ELSE 50 END AS correlation_stability
      FROM c_{tag}_regime g LEFT JOIN (SELECT portfolio AS p, count(rolling_sharpe) AS ks, stddev_samp(rolling_sharpe) AS rolling_sharpe_std,
          avg(rolling_sharpe) AS rolling_sharpe_mean, avg(rolling_cagr) AS rolling_cagr_mean, count(rolling_maxdd) AS km, stddev_samp(rolling_maxdd) AS mdd_std,
          min(rolling_maxdd) AS rolling_maxdd_worst FROM c_{tag}_roll GROUP BY 1) a ON a.p = g.portfolio
      LEFT JOIN {t} t ON t.portfolio = g.portfolio LEFT JOIN {c} d ON d.portfolio = g.portfolio""")
    cte(f"c_{tag}_stab", f"""SELECT *, CASE WHEN n_days < 63 THEN 0 ELSE s END AS stability_score, CASE WHEN n_days < 63 THEN 'N/A' WHEN s >= 80 THEN 'A' WHEN s >= 65 THEN 'B'
        WHEN s >= 50 THEN 'C' WHEN s >= 35 THEN 'D' ELSE 'F' END AS grade,
        CASE WHEN n_days < 63 THEN 'insufficient' WHEN n_days < 252 THEN 'limited' ELSE 'sufficient' END AS data_sufficiency
      FROM (SELECT *, least(100, greatest(0, 0.25 * sharpe_consistency + 0.25 * drawdown_stability + 0.20 * turnover_penalty
        + 0.20 * correlation_stability + 0.10 * regime_robustness)) AS s FROM c_{tag}_parts)""")


STAB = ", ".join(f"{r(c)} AS {c}" for c in (
    "stability_score", "sharpe_consistency", "drawdown_stability", "turnover_penalty", "correlation_stability", "regime_robustness",
    "rolling_sharpe_mean", "rolling_sharpe_std", "rolling_cagr_mean", "rolling_maxdd_worst", "regime_sharpe_high",
    "regime_sharpe_low", "regime_sharpe_gap"))


def stab_select(tag: str) -> str:
    return f"""SELECT portfolio, n_days, grade, data_sufficiency, {STAB}, {r('CAST(avg_turnover AS DOUBLE)')} AS avg_turnover,
        {r('CAST(avg_corr_drift AS DOUBLE)')} AS avg_corr_drift FROM c_{tag}_stab"""


stability_ctes("su", "c_us_curve")
cte("c_ch_ret", """SELECT w.portfolio, w.reb_no, w.stock_id, p.idx, p.ret FROM c_w_both w JOIN c_reb b ON b.reb_no = w.reb_no
    JOIN c_panel p ON p.stock_id = w.stock_id AND p.idx > b.reb_idx AND p.idx <= b.end_idx WHERE p.ret IS NOT NULL""")
cte("c_ch_full", """SELECT r.portfolio, r.reb_no, r.stock_id FROM c_ch_ret r JOIN c_reb b ON b.reb_no = r.reb_no GROUP BY 1, 2, 3
    HAVING count(*) = any_value(b.end_idx - b.reb_idx) AND stddev_samp(ret) > 0 AND count(*) > 2""")
cte("c_ch_days", "SELECT r.* FROM c_ch_ret r JOIN c_ch_full USING (portfolio, reb_no, stock_id)")
cte("c_ch_pair", """SELECT a.portfolio, a.reb_no, covar_samp(a.ret, b.ret) / (stddev_samp(a.ret) * stddev_samp(b.ret)) AS c FROM c_ch_days a
    JOIN c_ch_days b ON b.portfolio = a.portfolio AND b.reb_no = a.reb_no AND b.idx = a.idx AND b.stock_id > a.stock_id GROUP BY a.portfolio, a.reb_no, a.stock_id, b.stock_id""")
cte("c_ch", """SELECT f.portfolio, f.reb_no AS seq, p.c AS avg_pairwise_corr FROM (SELECT DISTINCT portfolio, reb_no FROM c_ch_full) f
    LEFT JOIN (SELECT portfolio, reb_no, avg(c) AS c FROM c_ch_pair GROUP BY 1, 2) p USING (portfolio, reb_no)""")
q("correlation_history", f"SELECT portfolio, seq, {r('avg_pairwise_corr')} AS avg_pairwise_corr FROM c_ch")
stability_ctes("sb", "c_bt_curve", turn="c_bt_turn", corr="c_ch")
q("rolling_portfolio_metrics", f"SELECT portfolio, date, {r('rolling_sharpe')} AS rolling_sharpe, {r('rolling_cagr')} AS rolling_cagr, {r('rolling_maxdd')} AS rolling_maxdd FROM c_su_roll")
q("regime_sharpe_split", f"""SELECT portfolio, n_days, {r('regime_sharpe_high')} AS regime_sharpe_high, {r('regime_sharpe_low')} AS regime_sharpe_low,
    {r('regime_sharpe_gap')} AS regime_sharpe_gap, {r('regime_score')} AS regime_score FROM c_su_regime""")


def regime_cagr_cte(name: str, curve: str) -> None:
    cte(name, f"""SELECT portfolio, CASE WHEN md > 0 THEN CASE WHEN nh >= 2 THEN pow(ph, 252.0 / nh) - 1 ELSE 0 END END AS cagr_high_vol,
        CASE WHEN md > 0 THEN CASE WHEN nl >= 2 THEN pow(pl, 252.0 / nl) - 1 ELSE 0 END END AS cagr_low_vol FROM (
      SELECT portfolio, any_value(md) AS md, count(*) FILTER (WHERE hi) AS nh, count(*) FILTER (WHERE NOT hi) AS nl,
        product(1 + r) FILTER (WHERE hi) AS ph, product(1 + r) FILTER (WHERE NOT hi) AS pl FROM (
        SELECT v.portfolio, daily_return AS r, md, coalesce(v >= md, false) AS hi FROM (
          SELECT *, CASE WHEN count(daily_return) OVER f >= 10 THEN round(stddev_samp(daily_return) OVER f, 12) END AS v FROM {curve}
          WINDOW f AS (PARTITION BY portfolio ORDER BY date ROWS 29 PRECEDING)) v JOIN (SELECT portfolio, median(v) AS md FROM (
          SELECT *, CASE WHEN count(daily_return) OVER f >= 10 THEN round(stddev_samp(daily_return) OVER f, 12) END AS v FROM {curve}
          WINDOW f AS (PARTITION BY portfolio ORDER BY date ROWS 29 PRECEDING)) GROUP BY 1) t ON t.portfolio = v.portfolio) GROUP BY 1)""")


regime_cagr_cte("c_regcagr", "c_bt_curve")
q("regime_cagr_split", f"""SELECT portfolio, {r('cagr_high_vol')} AS cagr_high_vol, {r('cagr_low_vol')} AS cagr_low_vol,
    {r('abs(cagr_high_vol - cagr_low_vol)')} AS regime_difference FROM c_regcagr""")
q("stability_scores", stab_select("su"))
q("stability_with_history", stab_select("sb"))


def portfolio_rrc_ctes(tag: str, curve: str, market: str) -> None:
    cte(f"c_{tag}_a", f"""SELECT c.portfolio, c.date, coalesce(k.m, 0) AS m, row_number() OVER w - 1 AS rw, count(*) OVER (PARTITION BY c.portfolio) AS n,
        product(1 + c.daily_return) OVER (PARTITION BY c.portfolio ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS eq,
        CASE WHEN row_number() OVER w = 1 THEN 0 ELSE c.daily_return END AS p
      FROM {curve} c LEFT JOIN {market} k ON k.date = c.date WINDOW w AS (PARTITION BY c.portfolio ORDER BY c.date)""")
    cte(f"c_{tag}_b", f"""SELECT *, CASE WHEN rw >= 29 THEN round(stddev_samp(m) OVER (PARTITION BY portfolio ORDER BY rw ROWS 29 PRECEDING), 12) END AS v,
        coalesce(CASE WHEN rw >= 59 THEN covar_samp(p, m) OVER g / nullif(var_samp(m) OVER g, 0) END, 1) AS beta FROM c_{tag}_a
      WINDOW g AS (PARTITION BY portfolio ORDER BY rw ROWS 59 PRECEDING)""")
    cte(f"c_{tag}_c", f"""SELECT *, hi AND NOT coalesce(lag(hi) OVER (PARTITION BY portfolio ORDER BY rw), true) AS onset FROM (
        SELECT b.*, coalesce(v > q, false) AS hi FROM c_{tag}_b b JOIN (SELECT portfolio, quantile_cont(v, 0.75) AS q FROM c_{tag}_b GROUP BY 1) t ON t.portfolio = b.portfolio)""")
    cte(f"c_{tag}_s", f"""SELECT portfolio, unnest(s[greatest(len(s) - 2, 1):]) AS si FROM (SELECT portfolio, list_reduce(l, lambda a, x:
        CASE WHEN x[1] - a[len(a)] > 10 THEN list_concat(a, x) ELSE a END) AS s FROM (SELECT portfolio, list([rw] ORDER BY rw) AS l FROM c_{tag}_c WHERE onset GROUP BY 1))""")
    cte(f"c_{tag}_dd", f"""SELECT portfolio, avg(d) AS sd FROM (SELECT portfolio, si, min((eq - pk) / pk) AS d FROM (SELECT c.portfolio, s.si, c.eq,
        max(c.eq) OVER (PARTITION BY c.portfolio, s.si ORDER BY c.rw ROWS UNBOUNDED PRECEDING) AS pk FROM c_{tag}_c c JOIN c_{tag}_s s
        ON s.portfolio = c.portfolio AND c.rw BETWEEN s.si AND s.si + 9) GROUP BY 1, 2) GROUP BY 1""")
    cte(f"c_{tag}_prrc", f"""SELECT portfolio, CASE WHEN n < 126 THEN 50 ELSE 100 * (0.4 * ct + 0.3 * bt + 0.3 * ss) END AS rrc_score,
        CASE WHEN n >= 126 THEN ct END AS containment, CASE WHEN n >= 126 THEN bt END AS beta_compression, CASE WHEN n >= 126 THEN ss END AS sharpe_stability FROM (
      SELECT x.*, least(1, greatest(0, 1 + coalesce(d.sd, 0) / 0.10)) AS ct, least(1, greatest(0, 0.5 + CASE WHEN nh > 5 AND nn > 5 THEN bn - bh ELSE 0 END)) AS bt,
        CASE WHEN sn > 0 THEN least(1, greatest(0, sh / sn)) ELSE 0 END AS ss FROM (
        SELECT portfolio, any_value(n) AS n, count(*) FILTER (WHERE hi) AS nh, count(*) FILTER (WHERE NOT hi) AS nn, avg(beta) FILTER (WHERE hi) AS bh,
          avg(beta) FILTER (WHERE NOT hi) AS bn, coalesce(avg(p) FILTER (WHERE hi) / nullif(stddev_samp(p) FILTER (WHERE hi), 0), 0) AS sh,
          coalesce(avg(p) FILTER (WHERE NOT hi) / nullif(stddev_samp(p) FILTER (WHERE NOT hi), 0), 0) AS sn FROM c_{tag}_c GROUP BY 1) x
      LEFT JOIN c_{tag}_dd d ON d.portfolio = x.portfolio)""")


cte("c_us_mkt", "SELECT date, avg(daily_return) AS m FROM c_us_curve GROUP BY 1")
portfolio_rrc_ctes("pr", "c_us_curve", "c_us_mkt")
q("portfolio_responsiveness", f"SELECT portfolio, {', '.join(f'{r(c)} AS {c}' for c in ('rrc_score', 'containment', 'beta_compression', 'sharpe_stability'))} FROM c_pr_prrc")
cte("c_us_span", "SELECT portfolio, min(idx) AS lo, max(idx) AS hi FROM c_us_curve GROUP BY 1")
cte("c_us_names", "SELECT DISTINCT portfolio, stock_id FROM c_w_user")
cte("c_us_rows", """SELECT n.portfolio, n.stock_id, x.idx, x.ret FROM c_us_names n JOIN c_us_span s USING (portfolio)
    JOIN c_panel x ON x.stock_id = n.stock_id AND x.idx > s.lo AND x.idx <= s.hi WHERE x.ret IS NOT NULL""")
cte("c_us_corr", """SELECT n.portfolio, coalesce(avg(c), 0.5) AS apc FROM (SELECT DISTINCT portfolio FROM c_us_names) n LEFT JOIN (
    SELECT a.portfolio, corr(a.ret, b.ret) AS c FROM c_us_rows a JOIN c_us_rows b
      ON a.portfolio = b.portfolio AND a.idx = b.idx AND a.stock_id < b.stock_id GROUP BY a.portfolio, a.stock_id, b.stock_id) t ON t.portfolio = n.portfolio GROUP BY 1""")
cte("c_rin", """SELECT m.portfolio, m.sharpe, m.cagr, m.max_drawdown, m.volatility, m.calmar, s.stability_score, s.grade AS stability_grade, s.regime_sharpe_gap,
    c.apc AS avg_pairwise_corr, p.rrc_score, m.total_return, m.win_rate, m.n_days FROM c_us_sum m JOIN c_su_stab s USING (portfolio)
    JOIN c_us_corr c USING (portfolio) JOIN c_pr_prrc p USING (portfolio)""")


def rated_cte(name: str, src: str) -> None:
    cte(name, f"""SELECT *, rank() OVER (ORDER BY score DESC) AS rank, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 70 THEN 'B'
        WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM (SELECT *, least(100, greatest(0, 100 * (0.30 * k1 + 0.20 * k2 + 0.15 * k3 + 0.10 * k4 + 0.15 * k5 + 0.10 * k6))) AS score FROM (
        SELECT *, least(1, greatest(0, sharpe / 2.5)) AS k1, least(1, greatest(0, 1 - (abs(max_drawdown) - 0.05) / 0.35)) AS k2, stability_score / 100 AS k3,
        1 - least(1, greatest(0, regime_sharpe_gap / greatest(2.0, abs(sharpe) * 0.75))) AS k4, least(1, greatest(0, 1 - (avg_pairwise_corr - 0.2) / 0.6)) AS k5,
        rrc_score / 100 AS k6 FROM {src}))""")


rated_cte("c_rated", "c_rin")
RIN = ", ".join(f"{r(c)} AS {c}" for c in ("sharpe", "cagr", "max_drawdown", "volatility", "calmar", "stability_score", "regime_sharpe_gap", "avg_pairwise_corr", "rrc_score"))
q("rating_input", f"SELECT portfolio, stability_grade, {RIN} FROM c_rin")
KS = ", ".join(f"{r(f'{k} * 100')} AS {n}_component" for k, n in (("k1", "sharpe"), ("k2", "drawdown"), ("k3", "stability"), ("k4", "regime"), ("k5", "diversif"), ("k6", "rrc")))
q("composite_ratings", f"SELECT portfolio, stability_grade, {RIN}, {r('score')} AS composite_score, grade, rank, {KS} FROM c_rated")
q("top_rated_portfolio", f"SELECT portfolio, {r('score')} AS composite_score, grade FROM c_rated WHERE rank = 1")


def mm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END"


cte("c_norm", f"""SELECT portfolio, {mm('sharpe')} AS sharpe_norm, {mm('cagr')} AS cagr_norm, {mm('abs(max_drawdown)')} AS maxdd_norm, {mm('calmar')} AS calmar_norm FROM c_us_sum""")
q("normalised_ratings", f"""SELECT portfolio, {', '.join(f'{r(c)} AS {c}' for c in ('sharpe_norm', 'cagr_norm', 'maxdd_norm', 'calmar_norm'))},
    {r('0.35 * sharpe_norm + 0.25 * cagr_norm + 0.20 * (1 - maxdd_norm) + 0.20 * calmar_norm')} AS rating_score FROM c_norm""")
q("portfolio_correlation_matrix", f"""SELECT a.portfolio AS portfolio_a, b.portfolio AS portfolio_b, {r('corr(a.daily_return, b.daily_return)')} AS correlation,
    {r('covar_samp(a.daily_return, b.daily_return)')} AS covariance FROM c_us_curve a JOIN c_us_curve b ON a.date = b.date GROUP BY 1, 2""")
WARN = """concat_ws(',', CASE WHEN n_days / 252.0 < 1 THEN 'duration_lt_1y' END,
    CASE WHEN sharpe > 3 THEN 'sharpe_unrealistic' END, CASE WHEN abs(max_drawdown) < 0.05 THEN 'maxdd_unrealistic' END)"""
q("portfolio_comparison", f"""SELECT portfolio, {', '.join(f'{r(c)} AS {c}' for c in ('cagr', 'sharpe', 'max_drawdown', 'stability_score', 'total_return', 'win_rate'))},
    {r('score')} AS composite_score, grade, rank, {WARN} AS warnings FROM c_rated""")
q("research_anomalies", """SELECT portfolio, concat_ws(',', CASE WHEN abs(sharpe) > 5 THEN 'sharpe_out_of_range' END,
    CASE WHEN total_return > 10 THEN 'return_out_of_range' END, CASE WHEN max_drawdown > 0 THEN 'positive_drawdown' END) AS anomalies
    FROM (SELECT * FROM c_us_sum UNION ALL SELECT * FROM c_bt_sum)""")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
