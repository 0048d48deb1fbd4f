"""DuckDB statements for estimator and hybrid queries."""

from __future__ import annotations

import checks.risk_sql as rs
from checks.base import METRICS, backtest_ctes, build, cte, r, summary_ctes

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


rs.spans_cte("c_spans_144", 144)
cte("c_tr_all", """SELECT c.reb_no AS grp, c.stock_id, p.idx, p.ret FROM c_cand c JOIN c_spans_144 s ON s.grp = c.reb_no
    JOIN c_panel p ON p.stock_id = c.stock_id AND p.idx BETWEEN greatest(s.lo + 1, s.hi - 89) AND s.hi WHERE p.ret IS NOT NULL""")
q("trailing_return_windows", f"SELECT grp, stock_id, count(*) AS n, {r('avg(ret)', 8)} AS mean_ret, {r('stddev_samp(ret)', 8)} AS std_ret FROM c_tr_all GROUP BY 1, 2")


def shrink_cte(name: str, src: str, mult: int) -> None:
    cte(name, f"""SELECT m.grp, m.stock_id, m.a AS sample_mean, p.prior, t.lam, (t.lam * m.a + (1 - t.lam) * p.prior) * {mult} AS mu FROM
      (SELECT grp, stock_id, avg(ret) AS a FROM {src} GROUP BY 1, 2) m
      JOIN (SELECT grp, count(DISTINCT idx) / (count(DISTINCT idx) + 60.0) AS lam FROM {src} GROUP BY 1) t ON t.grp = m.grp
      JOIN (SELECT grp, avg(a) AS prior FROM (SELECT grp, stock_id, avg(ret) AS a FROM {src} GROUP BY 1, 2) GROUP BY 1) p ON p.grp = m.grp""")


shrink_cte("c_shr", "c_tr_all", 252)
q("shrunk_returns", f"SELECT grp, stock_id, {r('sample_mean')} AS sample_mean, {r('prior')} AS prior, {r('lam')} AS lambda, {r('mu')} AS mu FROM c_shr")
q("error_corrected_returns", f"""SELECT m.grp, m.stock_id, {r('m.mu - b.error_bias')} AS mu, {r('b.error_bias')} AS bias FROM c_shr m JOIN c_bias b ON b.grp = m.grp AND b.stock_id = m.stock_id""")
cte("c_pool", """SELECT grp, stock_id, score, volatility_score, position FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, stock_id) AS position FROM (
    SELECT c.reb_no AS grp, c.stock_id, c.volatility_score, CASE WHEN x.rrc_score < 30 THEN composite_score * 0.90 WHEN x.rrc_score > 70 THEN composite_score * 1.05 ELSE composite_score END AS score
    FROM c_cand c LEFT JOIN c_s5_rrc x ON x.grp = c.reb_no AND x.stock_id = c.stock_id)) WHERE position <= 50""")
q("hybrid_candidate_pool", f"SELECT grp, stock_id, {r('score')} AS score, {r('volatility_score')} AS volatility_score, position FROM c_pool")


def hybrid_ctes(tag: str, pool: str, n: int, sls_sets: bool = True) -> None:
    """c_<tag>_w0 (before stop-loss) and, with sls_sets, c_<tag>_w."""
    cte(f"c_{tag}_ret", f"SELECT t.* FROM c_tr_all t JOIN {pool} p ON p.grp = t.grp AND p.stock_id = t.stock_id")
    cte(f"c_{tag}_corr", f"""SELECT grp, map_from_entries(list((k, c))) AS m FROM (SELECT a.grp, a.stock_id || '_' || b.stock_id AS k, abs(corr(a.ret, b.ret)) AS c
        FROM c_{tag}_ret a JOIN c_{tag}_ret b ON a.grp = b.grp AND a.idx = b.idx AND a.stock_id < b.stock_id GROUP BY a.grp, a.stock_id, b.stock_id) GROUP BY 1""")
    cte(f"c_{tag}_pick0", f"""SELECT grp, list_reduce(list([stock_id] ORDER BY position), lambda a, x: CASE WHEN len(a) >= {n} OR list_bool_or(list_transform(a, lambda s:
          coalesce(m[least(s, x[1]) || '_' || greatest(s, x[1])], 0) >= 0.8)) THEN a ELSE list_concat(a, x) END) AS picks
        FROM {pool} JOIN c_{tag}_corr USING (grp) GROUP BY grp, m""")
    cte(f"c_{tag}_pick", f"SELECT grp, unnest(picks) AS stock_id, generate_subscripts(picks, 1) AS pick FROM c_{tag}_pick0")
    cte(f"c_{tag}_sel", f"""SELECT k.grp, k.stock_id, k.pick, p.score, v.d * sqrt(252) AS vol FROM c_{tag}_pick k JOIN {pool} p ON p.grp = k.grp AND p.stock_id = k.stock_id
        JOIN (SELECT grp, stock_id, stddev_samp(ret) AS d FROM c_{tag}_ret GROUP BY 1, 2) v ON v.grp = k.grp AND v.stock_id = k.stock_id""")
    cte(f"c_{tag}_w0", f"""SELECT *, t / sum(t) OVER (PARTITION BY grp) AS weight FROM (SELECT *, (1 / vol) / sum(1 / vol) OVER (PARTITION BY grp) * (1 + 0.25 *
          CASE WHEN max(score) OVER (PARTITION BY grp) > min(score) OVER (PARTITION BY grp) THEN (score - min(score) OVER (PARTITION BY grp)) /
            (max(score) OVER (PARTITION BY grp) - min(score) OVER (PARTITION BY grp)) ELSE 0.5 END) AS t FROM c_{tag}_sel)""")
    if sls_sets:
        cte(f"c_{tag}_sets", f"""SELECT w.grp, w.stock_id, greatest(s.lo, min(f.f) OVER (PARTITION BY w.grp)) AS lo, s.hi FROM c_{tag}_w0 w
            JOIN c_spans_403 s ON s.grp = w.grp JOIN c_first f ON f.stock_id = w.stock_id""")
        rs.grid_ctes(tag, f"c_{tag}_sets")
        rs.rrc_ctes(tag)
        rs.sls_ctes(tag)
        layer(tag, f"c_{tag}_sls")


def layer(tag: str, sls: str) -> None:
    cte(f"c_{tag}_w", f"""SELECT grp, stock_id, pick, score, vol, adj, w1 / sum(w1) OVER (PARTITION BY grp) AS weight FROM (
        SELECT w.*, CASE WHEN round(s.s + 1e-9, 2) > 60 THEN 1 ELSE 0 END AS adj,
          weight * CASE WHEN round(s.s + 1e-9, 2) > 75 THEN 0 WHEN round(s.s + 1e-9, 2) > 60 THEN 0.5 ELSE 1 END AS w1
        FROM c_{tag}_w0 w LEFT JOIN {sls} s ON s.grp = w.grp AND s.stock_id = w.stock_id) WHERE w1 > 0""")


hybrid_ctes("hy", "c_pool", 15)
q("hybrid_weights", f"SELECT grp, stock_id, pick, {r('score')} AS score, {r('vol')} AS vol, {r('weight')} AS weight FROM c_hy_w")
cte("c_hy_held", "SELECT t.grp, t.stock_id, t.idx, t.ret, w.weight FROM c_tr_all t JOIN c_hy_w w ON w.grp = t.grp AND w.stock_id = t.stock_id")
shrink_cte("c_hy_shr", "c_hy_held", 252)
cte("c_hy_cov", """SELECT a.grp, a.stock_id AS i, b.stock_id AS j, covar_samp(a.ret, b.ret) AS cv, corr(a.ret, b.ret) AS cr, any_value(a.weight) AS wi, any_value(b.weight) AS wj
    FROM c_hy_held a JOIN c_hy_held b ON a.grp = b.grp AND a.idx = b.idx GROUP BY 1, 2, 3""")
cte("c_hy_stats", """SELECT n.grp, n.n_stocks, n.n_reduced, sqrt(252 * v.pv) AS ev, e.er / sqrt(252 * v.pv) AS es, v.ac FROM
    (SELECT grp, count(*) AS n_stocks, sum(adj) AS n_reduced FROM c_hy_w GROUP BY 1) n JOIN
    (SELECT c.grp, sum(wi * wj * (0.8 * cv + CASE WHEN i = j THEN 0.2 * av ELSE 0 END)) AS pv, avg(abs(cr)) FILTER (WHERE i < j) AS ac FROM c_hy_cov c
      JOIN (SELECT grp, avg(cv) AS av FROM c_hy_cov WHERE i = j GROUP BY 1) a ON a.grp = c.grp GROUP BY 1) v ON v.grp = n.grp JOIN
    (SELECT s.grp, sum(s.mu * w.weight) AS er FROM c_hy_shr s JOIN c_hy_w w ON w.grp = s.grp AND w.stock_id = s.stock_id GROUP BY 1) e ON e.grp = n.grp""")
q("hybrid_expectations", f"""SELECT grp, n_stocks, n_reduced, {r('ev')} AS expected_volatility, {r('es')} AS expected_sharpe, {r('ac')} AS avg_pairwise_corr,
    concat_ws(',', CASE WHEN n_stocks < 8 THEN 'low_diversification' END, CASE WHEN ac > 0.6 THEN 'high_concentration' END) AS warnings FROM c_hy_stats""")
cte("c_hy_mu", """SELECT s.grp, s.stock_id, s.mu - coalesce(a.p_intercept, 0) - coalesce(a.p_bv, 0) * coalesce(f.volatility_score, 0) AS mu FROM c_hy_shr s JOIN c_asof a ON a.grp = s.grp
    LEFT JOIN c_scored f ON f.stock_id = s.stock_id AND f.date = a.score_date""")
q("hybrid_expectations_calibrated", f"""SELECT s.grp, n_stocks, n_reduced, {r('ev')} AS expected_volatility, {r('e.er / ev')} AS expected_sharpe, {r('ac')} AS avg_pairwise_corr,
    concat_ws(',', CASE WHEN n_stocks < 8 THEN 'low_diversification' END, CASE WHEN ac > 0.6 THEN 'high_concentration' END) AS warnings FROM c_hy_stats s
    JOIN (SELECT m.grp, sum(m.mu * w.weight) / sum(w.weight) AS er FROM c_hy_mu m JOIN c_hy_w w ON w.grp = m.grp AND w.stock_id = m.stock_id GROUP BY 1) e ON e.grp = s.grp""")
cte("c_hyp_w", "SELECT 'hybrid' AS portfolio, grp AS reb_no, stock_id, weight FROM c_hy_w")
backtest_ctes("hyp", "c_hyp_w", target="0.15")
summary_ctes("hyp", "c_hyp_curve", std="stddev_pop")
q("hybrid_backtest_curve", f"SELECT portfolio, date, {r('daily_return')} AS daily_return, {r('cumulative_return')} AS cumulative_return, {r('drawdown')} AS drawdown FROM c_hyp_curve")
cte("c_hyp_ps", """SELECT portfolio, count(*) AS periods, stddev_pop(ps) AS sd FROM (SELECT portfolio, reb_no, count(*) AS n,
    CASE WHEN stddev_pop(daily_return) > 0 THEN avg(daily_return) * 252 / (stddev_pop(daily_return) * sqrt(252)) ELSE 0 END AS ps FROM c_hyp_curve GROUP BY 1, 2) WHERE n > 1 GROUP BY 1""")
M = ", ".join(f"{r(f'm.{c}')} AS {c}" for c in METRICS)
q("hybrid_backtest_summary", f"""SELECT m.portfolio, m.start_date, m.end_date, m.n_days, {M}, p.periods, {r('p.sd')} AS sharpe_std, p.periods >= 3 AND p.sd > 2 AS sharpe_unstable,
    {r('(SELECT avg(ac) FROM c_hy_stats)')} AS avg_pairwise_corr FROM c_hyp_sum m JOIN c_hyp_ps p USING (portfolio)""")
cte("c_abl_w", """SELECT 'with_sls' AS portfolio, grp AS reb_no, stock_id, weight FROM c_hy_w UNION ALL SELECT 'without_sls', grp, stock_id, weight FROM c_hy_w0""")
backtest_ctes("abl", "c_abl_w")
summary_ctes("abl", "c_abl_curve", std="stddev_pop")
cte("c_abl_all", "SELECT s.*, t.tc AS turnover_cost FROM c_abl_sum s JOIN (SELECT portfolio, 0.002 * sum(turnover) AS tc FROM c_abl_turn GROUP BY 1) t USING (portfolio)")
COLS = ("cagr", "sharpe", "max_drawdown", "volatility", "turnover_cost")
ABL = ", ".join(f"{r(f'a.{c}')} AS {c}_with_sls, {r(f'b.{c}')} AS {c}_without_sls, {r(f'a.{c} - b.{c}')} AS d_{c}" for c in COLS)
q("stop_loss_ablation", f"""SELECT {ABL}, a.cagr - b.cagr < -0.05 AS alpha_loss, a.turnover_cost > b.turnover_cost * 1.05 AS turnover_up
    FROM c_abl_all a JOIN c_abl_all b ON a.portfolio = 'with_sls' AND b.portfolio = 'without_sls'""")
cte("c_lw_x", "SELECT grp, stock_id, idx, ret - avg(ret) OVER (PARTITION BY grp, stock_id) AS x FROM c_hy_held")
cte("c_lw", """SELECT a.grp, a.p, a.n, a.ss, b.q / a.n AS q, a.tr / a.p AS mu FROM
    (SELECT c.grp, count(*) FILTER (WHERE i = j) AS p, any_value(d.n) AS n, sum(pow(cv * (d.n - 1) / d.n, 2)) AS ss, sum(cv * (d.n - 1) / d.n) FILTER (WHERE i = j) AS tr
      FROM c_hy_cov c JOIN (SELECT grp, count(DISTINCT idx) AS n FROM c_hy_held GROUP BY 1) d ON d.grp = c.grp GROUP BY 1) a
    JOIN (SELECT grp, sum(pow(s, 2)) AS q FROM (SELECT grp, idx, sum(x * x) AS s FROM c_lw_x GROUP BY 1, 2) GROUP BY 1) b ON b.grp = a.grp""")
q("covariance_ledoit_wolf", f"""SELECT grp, p AS n_assets, n AS n_obs, {r('1 - least(beta, delta) / delta')} AS shrinkage FROM (
    SELECT *, (ss - p * mu * mu) / p AS delta, (q - ss) / (p * n) AS beta FROM c_lw)""")
cte("c_cov_e", "SELECT grp, i AS a, j AS b, 0.8 * cv + CASE WHEN i = j THEN 0.2 * avg(cv) FILTER (WHERE i = j) OVER (PARTITION BY grp) ELSE 0 END AS value FROM c_hy_cov")
q("covariance_entries", f"SELECT grp, a, b, {r('value', 12)} AS value FROM c_cov_e")
cte("c_cov_m", "SELECT grp, list(entries ORDER BY a) AS m, list(a ORDER BY a) AS names FROM (SELECT grp, a, list(value ORDER BY b) AS entries FROM c_cov_e GROUP BY 1, 2) GROUP BY 1")
cte("c_piv", """WITH RECURSIVE e AS (SELECT grp, 1 AS position, names, m FROM c_cov_m UNION ALL
    SELECT grp, position + 1, names, list_transform(m[2:], lambda x: list_transform(range(2, len(m) + 1), lambda k: x[k] - x[1] / m[1][1] * m[1][k])) FROM e WHERE len(m) > 1)
    SELECT grp, position, names[position] AS stock_id, m[1][1] AS pv FROM e""")
q("covariance_pivots", f"SELECT grp, position, stock_id, {r('pv', 12)} AS pivot_value FROM c_piv")
q("covariance_summary", f"""SELECT grp, n_assets, {r('trace', 12)} AS trace, {r('ss', 12)} AS sum_squares, {r('mp', 12)} AS min_pivot, {r('ld')} AS log_det, mp > 0 AS is_positive_definite
    FROM (SELECT grp, sum(value) FILTER (WHERE a = b) AS trace, sum(value * value) AS ss FROM c_cov_e GROUP BY 1)
    JOIN (SELECT grp, count(*) AS n_assets, min(pv) AS mp, sum(ln(pv)) FILTER (WHERE pv > 0) AS ld FROM c_piv GROUP BY 1) USING (grp)""")
q("hybrid_correlation_matrix", f"SELECT i AS stock_a, j AS stock_b, {r('cr')} AS correlation FROM c_hy_cov WHERE grp = (SELECT max(grp) FROM c_hy_w)")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
