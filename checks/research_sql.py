"""DuckDB statements for auto-N, meta-portfolio, validation and governance queries."""

from __future__ import annotations

import checks.error_sql  # noqa: F401
import checks.risk_sql as rs
from checks.base import backtest_ctes, build, cte, curve_ctes, metric_select, r, summary_ctes
from checks.hybrid_sql import hybrid_ctes, layer, shrink_cte
from checks.rating_sql import RIN, KS, portfolio_rrc_ctes, rated_cte, regime_cagr_cte, stability_ctes
from quantfold.operators.validation import sensitivity_weightings, single_factor_weightings

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


# --- auto-N ---
cte("c_p60", "SELECT grp, stock_id FROM (SELECT reb_no AS grp, stock_id, row_number() OVER (PARTITION BY reb_no ORDER BY rank, stock_id) AS k FROM c_cand) WHERE k <= 60")
for tag, span in (("n5", "c_spans_1835"), ("n4", "c_spans_403")):
    cte(f"c_{tag}_sets", f"""SELECT p.grp, p.stock_id, greatest(s.lo, min(f.f) OVER (PARTITION BY p.grp)) AS lo, s.hi FROM c_p60 p
        JOIN {span} s ON s.grp = p.grp JOIN c_first f ON f.stock_id = p.stock_id""")
    rs.grid_ctes(tag, f"c_{tag}_sets")
    rs.rrc_ctes(tag)
rs.sls_ctes("n4")
cte("c_npool", """SELECT grp, stock_id, score, volatility_score, position FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, stock_id) AS position FROM (
    SELECT c.reb_no AS grp, c.stock_id, c.volatility_score, CASE WHEN x.rrc_score < 30 THEN composite_score * 0.90 WHEN x.rrc_score > 70 THEN composite_score * 1.05 ELSE composite_score END AS score
    FROM c_cand c LEFT JOIN c_n5_rrc x ON x.grp = c.reb_no AND x.stock_id = c.stock_id)) WHERE position <= 50""")
hybrid_ctes("an", "c_npool", 30, sls_sets=False)
layer("an", "c_n4_sls")
cte("c_an_held", """SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pick) AS position, count(*) OVER (PARTITION BY grp) AS total FROM c_an_w""")
cte("c_an_pre", """SELECT grp, n, stock_id, position, t / sum(t) OVER (PARTITION BY grp, n) AS weight FROM (SELECT *, (1 / vol) / sum(1 / vol) OVER (PARTITION BY grp, n) * (1 + 0.25 *
    CASE WHEN max(score) OVER (PARTITION BY grp, n) > min(score) OVER (PARTITION BY grp, n) THEN (score - min(score) OVER (PARTITION BY grp, n)) /
      (max(score) OVER (PARTITION BY grp, n) - min(score) OVER (PARTITION BY grp, n)) ELSE 0.5 END) AS t FROM (
    SELECT h.*, least(10, total) + 2 * k.k AS n FROM c_an_held h JOIN (SELECT range AS k FROM range(11)) k ON least(10, total) + 2 * k.k <= least(30, total)) WHERE position <= n)""")
cte("c_an_some", "SELECT t.* FROM c_tr_all t JOIN c_an_w w ON w.grp = t.grp AND w.stock_id = t.stock_id")
cte("c_an_rows", """SELECT s.* FROM c_an_some s JOIN (SELECT grp, count(*) AS k FROM c_an_w GROUP BY 1) n ON n.grp = s.grp
    QUALIFY count(*) OVER (PARTITION BY s.grp, s.idx) = any_value(n.k) OVER (PARTITION BY s.grp, s.idx)""")
shrink_cte("c_an_shr", "c_an_rows", 252)
cte("c_an_cov", """SELECT a.grp, a.stock_id AS i, b.stock_id AS j, covar_samp(a.ret, b.ret) AS cv, any_value(p.cr) AS cr
    FROM c_an_rows a JOIN c_an_rows b ON a.grp = b.grp AND a.idx = b.idx JOIN (SELECT a.grp, a.stock_id AS i, b.stock_id AS j, corr(a.ret, b.ret) AS cr
      FROM c_an_some a JOIN c_an_some b ON a.grp = b.grp AND a.idx = b.idx GROUP BY 1, 2, 3) p ON p.grp = a.grp AND p.i = a.stock_id AND p.j = b.stock_id GROUP BY 1, 2, 3""")
cte("c_an_mom", """SELECT c.grp, x.n, sqrt(252 * sum(x.weight * y.weight * (0.8 * cv + CASE WHEN i = j THEN 0.2 * av ELSE 0 END))) AS ev, avg(abs(cr)) FILTER (WHERE i < j) AS ac
    FROM c_an_cov c JOIN (SELECT grp, avg(cv) AS av FROM c_an_cov WHERE i = j GROUP BY 1) a ON a.grp = c.grp
    JOIN c_an_pre x ON x.grp = c.grp AND x.stock_id = c.i JOIN c_an_pre y ON y.grp = c.grp AND y.stock_id = c.j AND y.n = x.n GROUP BY 1, 2""")
cte("c_an_agg", """SELECT p.grp, p.n, sum(p.weight * m.mu) AS er, CASE WHEN count(*) >= 3 THEN sum(p.weight) FILTER (WHERE p.k <= 3) ELSE 1.0 END AS top3,
    coalesce(sum(p.weight * round(s.s + 1e-9, 2)), 50) AS sls_agg, coalesce(sum(p.weight * x.rrc_score), 50) AS rrc_agg
    FROM (SELECT *, row_number() OVER (PARTITION BY grp, n ORDER BY weight DESC, stock_id) AS k FROM c_an_pre) p JOIN c_an_shr m ON m.grp = p.grp AND m.stock_id = p.stock_id
    LEFT JOIN c_n4_sls s ON s.grp = p.grp AND s.stock_id = p.stock_id LEFT JOIN c_n5_rrc x ON x.grp = p.grp AND x.stock_id = p.stock_id GROUP BY 1, 2""")
rs.spans_cte("c_spans_288", 288)
cte("c_an_pc", """SELECT w.grp || '_' || w.n AS portfolio, p.idx AS date, sum(w.weight * p.ret) AS daily_return FROM c_an_pre w JOIN c_spans_288 s ON s.grp = w.grp
    JOIN c_panel p ON p.stock_id = w.stock_id AND p.idx BETWEEN greatest(s.lo + 1, s.hi - 179) AND s.hi WHERE p.ret IS NOT NULL GROUP BY 1, 2""")
stability_ctes("ans", "c_an_pc")
cte("c_an_tab", """SELECT a.grp, a.n, CASE WHEN m.ev IS NULL THEN 1.0 WHEN m.ev > 0 THEN a.er / m.ev ELSE 0 END AS sharpe_raw, coalesce(m.ev, 0.15) AS exp_vol, coalesce(m.ac, 0.5) AS avg_corr,
    a.top3 AS top_3_weight, a.sls_agg, a.rrc_agg, coalesce(s.stability_score, 50) AS stability_score FROM c_an_agg a LEFT JOIN c_an_mom m ON m.grp = a.grp AND m.n = a.n
    LEFT JOIN c_ans_stab s ON s.portfolio = a.grp || '_' || a.n""")
cte("c_an_ben", """SELECT *, 0.30 * sharpe_normalized + 0.25 * diversification_score + 0.25 * (stability_score / 100) + 0.10 * (rrc_agg / 100) + 0.10 * governance_score - 0.10 * concentration_penalty AS portfolio_benefit
    FROM (SELECT *, 1 - overfitting_risk AS governance_score FROM (SELECT *, CASE WHEN max(sharpe_raw) OVER g > min(sharpe_raw) OVER g THEN (sharpe_raw - min(sharpe_raw) OVER g) / (max(sharpe_raw) OVER g - min(sharpe_raw) OVER g) ELSE 0.5 END AS sharpe_normalized,
      greatest(0, 1 - avg_corr) AS diversification_score, least(1, greatest(0, top_3_weight - 0.40) * 2 + greatest(0, avg_corr - 0.50) * 2) AS concentration_penalty,
      CASE WHEN max(sharpe_raw) OVER l > 0 AND sharpe_raw > max(sharpe_raw) OVER l * 1.5 THEN 1.0 ELSE 0.0 END AS overfitting_risk FROM c_an_tab
    WINDOW g AS (PARTITION BY grp), l AS (PARTITION BY grp ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))""")
TAB = ("sharpe_raw", "exp_vol", "avg_corr", "top_3_weight", "sls_agg", "rrc_agg", "stability_score", "sharpe_normalized", "diversification_score", "concentration_penalty", "overfitting_risk", "governance_score", "portfolio_benefit")
q("auto_n_evaluation", f"SELECT grp, n, {', '.join(f'{r(c)} AS {c}' for c in TAB)} FROM c_an_ben")
cte("c_an_a", "SELECT b.*, v.av, n >= CASE WHEN av > 0.25 THEN 7 ELSE 5 END AS ok FROM c_an_ben b JOIN (SELECT grp, avg(exp_vol) AS av FROM c_an_ben GROUP BY 1) v ON v.grp = b.grp")
cte("c_an_b", "SELECT * FROM c_an_a a WHERE ok OR NOT EXISTS (SELECT 1 FROM c_an_a x WHERE x.grp = a.grp AND x.ok)")
cte("c_an_c", """SELECT b.grp, max(b.n) AS n0, any_value(m.mb) AS mb FROM c_an_b b JOIN (SELECT grp, max(portfolio_benefit) AS mb FROM c_an_b GROUP BY 1) m ON m.grp = b.grp WHERE b.portfolio_benefit >= m.mb - 0.02 GROUP BY 1""")
cte("c_an_d", "SELECT c.grp, c.n0, c.mb, s.stability_score AS st FROM c_an_c c JOIN c_an_b s ON s.grp = c.grp AND s.n = c.n0")
q("auto_n_selection", f"""SELECT d.grp, CASE WHEN st < 50 AND nx IS NOT NULL THEN nx ELSE n0 END AS optimal_n, {r('mb')} AS max_benefit, {r('av')} AS avg_vol, av > 0.25 AS high_vol_regime, av < 0.12 AS low_vol_regime,
    cf AS concentration_flag, ofl AS overfit_flag, st < 50 AND nx IS NOT NULL AS stability_guardrail FROM (SELECT d.grp, any_value(d.n0) AS n0, any_value(d.mb) AS mb, any_value(d.st) AS st,
      min(b.n) FILTER (WHERE b.n > d.n0 AND b.stability_score > d.st) AS nx FROM c_an_d d JOIN c_an_b b ON b.grp = d.grp GROUP BY 1) d
    JOIN (SELECT grp, any_value(av) AS av, sum(concentration_penalty) > 0 AS cf, sum(overfitting_risk) > 0 AS ofl FROM c_an_a GROUP BY 1) f ON f.grp = d.grp""")
q("auto_n_due", """SELECT as_of, last_run, last_run IS NULL OR as_of > last_run OR 12 * (year(as_of) - year(last_run)) + month(as_of) - month(last_run) >= 6 AS due FROM (
    SELECT reb_date AS as_of, unnest([lag(reb_date, 2) OVER w, lead(reb_date, 3) OVER w]) AS last_run FROM c_reb WINDOW w AS (ORDER BY reb_date))""")

# --- meta ---
cte("c_mo_g", """SELECT 1 AS grp, p.portfolio AS stock_id, 1 AS lo, d.idx - min(d.idx) OVER () AS rw, max(d.idx) OVER () AS hi, d.idx,
    c.cumulative_return + 1 AS close, CASE WHEN c.date > p.d0 THEN c.daily_return END AS ret
    FROM (SELECT portfolio, min(date) AS d0 FROM c_us_curve GROUP BY 1) p CROSS JOIN (SELECT DISTINCT idx FROM c_us_curve) d
    LEFT JOIN c_us_curve c ON c.portfolio = p.portfolio AND c.idx = d.idx""")
rs.rrc_ctes("mo")
rs.sls_ctes("mo")
cte("c_msc", "SELECT s.stock_id AS portfolio, s.s AS sls, p.rrc_score AS rrc FROM c_mo_sls s JOIN c_pr_prrc p ON p.portfolio = s.stock_id")
q("meta_asset_scores", f"SELECT portfolio, {r('sls')} AS stop_loss_score, {r('rrc')} AS rrc_score FROM c_msc")
# weight grid over the five saved portfolios, names in alphabetical order
cte("c_gs_ret", "SELECT 1 AS grp, portfolio AS stock_id, idx, daily_return AS ret FROM c_us_curve")
shrink_cte("c_gs_shr", "c_gs_ret", 252)
cte("c_gs_cov", """SELECT a.portfolio AS i, b.portfolio AS j, covar_samp(a.daily_return, b.daily_return) AS cv FROM c_us_curve a JOIN c_us_curve b ON a.date = b.date GROUP BY 1, 2""")
cte("c_gs_row", """SELECT i, list(252 * (0.8 * cv + CASE WHEN i = j THEN 0.2 * (SELECT avg(cv) FROM c_gs_cov WHERE i = j) ELSE 0 END) ORDER BY j) AS v FROM c_gs_cov GROUP BY 1""")
cte("c_gs_one", """SELECT (SELECT list(v ORDER BY i) FROM c_gs_row) AS cov, list(m.mu ORDER BY m.stock_id) AS mu, list(pow(s.sls / 100, 2) ORDER BY m.stock_id) AS pen, list(s.rrc / 100 ORDER BY m.stock_id) AS bon,
    list(m.stock_id ORDER BY m.stock_id) AS names FROM c_gs_shr m JOIN c_msc s ON s.portfolio = m.stock_id""")
cte("c_gs_grid", """SELECT [a / 20.0, b / 20.0, c / 20.0, d / 20.0, (20 - a - b - c - d) / 20.0]::DOUBLE[] AS w FROM range(13) x(a), range(13) y(b), range(13) z(c), range(13) u(d)
    WHERE 20 - a - b - c - d BETWEEN 0 AND 12""")
cte("c_gs_best", """SELECT w, names, list_dot_product(w, mu) / sqrt(list_dot_product(w, list_transform(cov, lambda v: list_dot_product(w, v)))) - 0.2 * list_dot_product(w, pen) + 0.1 * list_dot_product(w, bon) AS o
    FROM c_gs_grid CROSS JOIN c_gs_one ORDER BY o DESC LIMIT 1""")
q("meta_weights_search", f"SELECT unnest(names) AS portfolio, (round(unnest(w), 6) + 0.0) AS weight, {r('o')} AS objective FROM c_gs_best")
cte("c_mw", """SELECT portfolio, c / sum(c) OVER () AS weight FROM (SELECT portfolio, least(CASE WHEN sum(greatest(sharpe, 0)) OVER () > 0 THEN greatest(sharpe, 0) / sum(greatest(sharpe, 0)) OVER ()
    ELSE 1.0 / count(*) OVER () END, CASE WHEN count(*) OVER () * 0.6 >= 1 THEN 0.6 ELSE 1.0 END) AS c FROM c_us_sum)""")
q("meta_weights_heuristic", f"SELECT portfolio, {r('weight')} AS weight FROM c_mw")
cte("c_md", """SELECT 'meta' AS portfolio, idx, date, 0 AS reb_no, sum(w.weight * c.daily_return) AS ret FROM c_us_curve c JOIN c_mw w USING (portfolio) GROUP BY idx, date
    HAVING count(*) = (SELECT count(*) FROM c_mw)""")
curve_ctes("mc", "c_md")
summary_ctes("mc", "c_mc_curve", std="stddev_pop")
CURVE = f"portfolio, date, {r('daily_return')} AS daily_return, {r('cumulative_return')} AS cumulative_return, {r('drawdown')} AS drawdown"
q("meta_portfolio_curve", f"SELECT {CURVE} FROM c_mc_curve")
portfolio_rrc_ctes("mp", "c_mc_curve", "c_us_mkt")
q("meta_portfolio_metrics", metric_select("c_mc_sum") + f" JOIN (SELECT {r('rrc_score')} AS rrc_score FROM c_mp_prrc) ON true JOIN (SELECT {r('sum(weight * sls)')} AS meta_stop_loss_score FROM c_msc JOIN c_mw USING (portfolio)) ON true")
SQL["meta_portfolio_metrics"] = SQL["meta_portfolio_metrics"].replace(" FROM c_mc_sum", ", rrc_score, meta_stop_loss_score FROM c_mc_sum", 1)


def mm(v: str, c: str) -> str:
    return f"CASE WHEN (SELECT max({c}) > min({c}) FROM c_us_sum) THEN ({v} - (SELECT min({c}) FROM c_us_sum)) / (SELECT max({c}) - min({c}) FROM c_us_sum) ELSE 0.5 END"


def rel(src: str) -> str:
    return f"""(SELECT portfolio, cagr, sharpe, max_drawdown, total_return, 0.35 * {mm('sharpe', 'sharpe')} + 0.25 * {mm('cagr', 'cagr')} + 0.20 * (1 - {mm('abs(max_drawdown)', 'abs(max_drawdown)')}) + 0.20 * {mm('calmar', 'calmar')} AS ms FROM {src})"""


cte("c_best", "SELECT portfolio AS bn, round(score, 2) / 100 AS bs FROM c_rated ORDER BY round(score, 2) DESC, portfolio DESC LIMIT 1")
WIN = f"portfolio, {r('ms')} AS meta_score, bn AS best_user_name, {r('bs')} AS best_user_score, CASE WHEN ms > bs THEN 'meta' ELSE 'user' END AS winner_type"
q("meta_winner", f"SELECT {WIN} FROM {rel('c_mc_sum')} CROSS JOIN c_best")
stability_ctes("ms", "c_mc_curve")
cte("c_rin2", """SELECT portfolio, sharpe, cagr, max_drawdown, volatility, calmar, stability_score, stability_grade, regime_sharpe_gap, avg_pairwise_corr, rrc_score FROM c_rin UNION ALL
    SELECT m.portfolio, m.sharpe, m.cagr, m.max_drawdown, m.volatility, m.calmar, s.stability_score, s.grade, s.regime_sharpe_gap, 0.5, 50.0 FROM c_mc_sum m JOIN c_ms_stab s USING (portfolio)""")
rated_cte("c_rated2", "c_rin2")
q("full_ratings_with_meta", f"SELECT portfolio, stability_grade, {RIN}, {r('score')} AS composite_score, grade, rank, {KS} FROM c_rated2")
cte("c_blend", """SELECT stock_id, least(w, 0.6) / sum(least(w, 0.6)) OVER () AS weight FROM (SELECT u.stock_id, sum(m.weight * u.weight) AS w FROM c_w_user_last u JOIN c_mw m USING (portfolio) GROUP BY 1)""")
q("meta_stock_blend", f"SELECT stock_id, {r('weight')} AS weight, symbol FROM c_blend LEFT JOIN c_stocks USING (stock_id)")
cte("c_blend_w", "SELECT 'stock_blend' AS portfolio, 1 AS reb_no, stock_id, weight FROM c_blend")
cte("c_blend_p", "SELECT 1 AS reb_no, min(reb_idx) AS reb_idx, max(end_idx) AS end_idx FROM c_reb")
cte("c_blend_d", """SELECT w.portfolio, x.idx, x.date, 1 AS reb_no, sum(w.weight * x.ret) AS ret FROM c_blend_w w CROSS JOIN c_blend_p p JOIN c_panel x ON x.stock_id = w.stock_id AND x.idx > p.reb_idx AND x.idx <= p.end_idx
    WHERE x.ret IS NOT NULL GROUP BY 1, 2, 3""")
curve_ctes("bl", "c_blend_d")
summary_ctes("bl", "c_bl_curve", std="stddev_pop")
q("meta_stock_blend_winner", f"SELECT {WIN}, {r('cagr')} AS cagr, {r('sharpe')} AS sharpe, {r('max_drawdown')} AS max_drawdown, {r('total_return')} AS total_return FROM {rel('c_bl_sum')} CROSS JOIN c_best")
cte("c_eb", "SELECT 'equal_blend' AS portfolio, idx, date, 0 AS reb_no, avg(daily_return) AS ret FROM c_us_curve GROUP BY idx, date")
curve_ctes("eb", "c_eb")
q("equal_blend_curve", f"SELECT {CURVE} FROM c_eb_curve")

# --- validation ---
cte("c_split", """SELECT 0 AS window_id, 'train' AS part, 1 AS lo_no, greatest(1, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT)) AS hi_no FROM (SELECT max(reb_no) AS n FROM c_reb)
    UNION ALL SELECT 0, 'test', greatest(1, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT)) + 1, n FROM (SELECT max(reb_no) AS n FROM c_reb)""")
cte("c_rolling", """SELECT k AS window_id, 'train' AS part, 12 * k + 1 AS lo_no, 12 * k + 36 AS hi_no FROM range(50) t(k) WHERE 12 * k + 48 <= (SELECT max(reb_no) FROM c_reb)
    UNION ALL SELECT k, 'test', 12 * k + 37, 12 * k + 48 FROM range(50) t(k) WHERE 12 * k + 48 <= (SELECT max(reb_no) FROM c_reb)""")
for tag, src in (("wf", "c_split"), ("wr", "c_rolling")):
    cte(f"c_{tag}_p", f"""SELECT w.window_id || ':' || w.part AS portfolio, w.window_id, w.part, b.reb_no, b.reb_date, b.reb_idx,
        CASE WHEN b.reb_no = w.hi_no THEN (SELECT max(idx) FROM c_calendar) ELSE b.end_idx END AS end_idx FROM {src} w JOIN c_reb b ON b.reb_no BETWEEN w.lo_no AND w.hi_no""")
    cte(f"c_{tag}_w", f"SELECT p.portfolio, p.reb_no, w.stock_id, w.weight FROM c_w_eq w JOIN c_{tag}_p p ON p.reb_no = w.reb_no")
    backtest_ctes(tag, f"c_{tag}_w", f"c_{tag}_p", by_portfolio=True)
    summary_ctes(tag, f"c_{tag}_curve")
    cols = ", ".join(f"max({c}) FILTER (WHERE part = '{p}') AS {p}_{n}" for p in ("train", "test") for c, n in (("cagr", "cagr"), ("sharpe", "sharpe"), ("max_drawdown", "maxdd")))
    cte(f"c_{tag}_out", f"""SELECT window_id, min(d0) AS window_start, max(d1) AS window_end, {cols} FROM c_{tag}_sum s JOIN (
        SELECT portfolio, window_id, part, min(reb_date) AS d0, max(reb_date) AS d1 FROM c_{tag}_p GROUP BY 1, 2, 3) x USING (portfolio) GROUP BY 1""")
WF = ", ".join(f"{r(c)} AS {c}" for c in (f"{p}_{n}" for p in ("train", "test") for n in ("cagr", "sharpe", "maxdd")))
q("walk_forward_split", f"SELECT window_id, window_start, window_end, {WF} FROM c_wf_out")
q("walk_forward_rolling", f"SELECT window_id, window_start, window_end, {WF} FROM c_wr_out")
for tag, rows in (("se", sensitivity_weightings()), ("sf", single_factor_weightings())):
    values = ", ".join(f"('{n}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE), CAST({d!r} AS DOUBLE))" for n, a, b, c, d in rows)
    cte(f"c_{tag}_rank", f"""SELECT *, dense_rank() OVER (PARTITION BY weighting, date ORDER BY cs DESC) AS rk FROM (SELECT w.weighting, f.stock_id, f.date,
        w.q * quality_score + w.g * growth_score + w.m * momentum_score + w.v * value_score AS cs FROM c_factors f CROSS JOIN (VALUES {values}) w(weighting, q, g, m, v)
        WHERE f.date IN (SELECT score_date FROM c_reb))""")
    cte(f"c_{tag}_w", f"""SELECT weighting AS portfolio, reb_no, stock_id, 1.0 / count(*) OVER (PARTITION BY weighting, reb_no) AS weight FROM (SELECT x.weighting, b.reb_no, x.stock_id,
        row_number() OVER (PARTITION BY x.weighting, b.reb_no ORDER BY x.rk, x.stock_id) AS k FROM c_{tag}_rank x JOIN c_reb b ON b.score_date = x.date) WHERE k <= 20""")
    backtest_ctes(tag, f"c_{tag}_w")
    summary_ctes(tag, f"c_{tag}_curve")
q("weight_sensitivity", f"SELECT portfolio AS weighting, {r('cagr')} AS cagr, {r('sharpe')} AS sharpe, {r('max_drawdown')} AS max_drawdown FROM c_se_sum")
q("single_factor_tests", f"SELECT portfolio AS weighting, {r('cagr')} AS cagr, {r('sharpe')} AS sharpe, {r('max_drawdown')} AS max_drawdown FROM c_sf_sum")
cte("c_sharpe_ratio", "SELECT b, f, CASE WHEN f > 0 AND b > 0 THEN b / f END AS x FROM (SELECT max(sharpe) AS b FROM c_sf_sum) CROSS JOIN (SELECT sharpe AS f FROM c_bt_sum WHERE portfolio = 'equal_weight')")
q("validation_report", f"""SELECT 'overfitting_gap' AS section, {r('g')} AS value, g > 1 AS flagged FROM (SELECT avg(train_sharpe) - avg(test_sharpe) AS g FROM c_wf_out)
    UNION ALL SELECT 'sensitivity_std', {r('s')}, s > 0.5 FROM (SELECT stddev_samp(sharpe) AS s FROM c_se_sum)
    UNION ALL SELECT 'single_factor_share', {r('x')}, coalesce(x >= 0.8, false) FROM c_sharpe_ratio
    UNION ALL SELECT 'regime_difference', {r('d')}, d > 0.2 FROM (SELECT abs(cagr_high_vol - cagr_low_vol) AS d FROM c_regcagr WHERE portfolio = 'equal_weight')""")

# --- governance ---
regime_cagr_cte("c_regus", "c_us_curve")
cte("c_gov", """SELECT s.portfolio, s.sharpe, s.cagr, s.volatility, t.mt, g.cagr_low_vol AS lv, st.stability_score AS ss,
    (SELECT arg_max(r_squared, window_end) FROM c_fit WHERE n >= 30) AS r2, (SELECT coalesce(sum(flips * n_chunks), 0) FROM c_stabl WHERE window_end = (SELECT max(window_end) FROM c_fit)) AS fl
    FROM c_us_sum s JOIN (SELECT portfolio, avg(turnover) / 2 AS mt FROM c_us_turn WHERE seq > 1 GROUP BY 1) t USING (portfolio) JOIN c_regus g USING (portfolio) JOIN c_su_stab st USING (portfolio)""")
cte("c_gov2", """SELECT *, (CASE WHEN sharpe > 3 THEN 1 ELSE 0 END) + (CASE WHEN mt > 0.6 THEN 1 ELSE 0 END) + (CASE WHEN coalesce(r2, 0) > 0.8 THEN 1 ELSE 0 END) + (CASE WHEN fl > 3 THEN 1 ELSE 0 END) AS o,
    (CASE WHEN volatility > 0 AND volatility < 0.08 THEN 1 ELSE 0 END) + (CASE WHEN sharpe > 0.8 AND cagr < 0.05 THEN 1 ELSE 0 END) + (CASE WHEN lv < 0.08 THEN 1 ELSE 0 END) AS k FROM c_gov""")
q("model_governance", f"""SELECT portfolio, CASE WHEN o / 4.0 >= 0.5 THEN 'High' WHEN o / 4.0 >= 0.2 THEN 'Moderate' ELSE 'Low' END AS overfitting_risk,
    concat_ws(',', CASE WHEN sharpe > 3 THEN 'extreme_sharpe' END, CASE WHEN mt > 0.6 THEN 'excessive_turnover' END, CASE WHEN r2 > 0.8 THEN 'high_error_r2' END, CASE WHEN fl > 3 THEN 'sign_flips' END) AS overfit_flags,
    o * 5 AS overfit_penalty, CASE WHEN k >= 3 THEN 'Overly Conservative Model' WHEN k >= 1 THEN 'Slightly Conservative' ELSE 'Balanced' END AS classification, {r('k / 4.0 * 100')} AS impact_score,
    concat_ws(',', CASE WHEN volatility > 0 AND volatility < 0.08 THEN 'low_volatility' END, CASE WHEN sharpe > 0.8 AND cagr < 0.05 THEN 'suppressed_cagr' END, CASE WHEN lv < 0.08 THEN 'weak_in_calm_regime' END) AS conservative_flags,
    k * 3 AS conservative_penalty, {r('least(100, greatest(0, 100 - (o * 5 + k * 3 + greatest(0, 20 - ss * 0.2))))')} AS governance_score FROM c_gov2""")
q("quality_checks", """SELECT 'stop_loss_in_range' AS "check", count(*) FILTER (WHERE NOT s BETWEEN 0 AND 100) AS violations, count(*) AS rows_checked FROM c_s4_sls
    UNION ALL SELECT 'responsiveness_in_range', count(*) FILTER (WHERE NOT rrc_score BETWEEN 0 AND 100), count(*) FROM c_s5_rrc
    UNION ALL SELECT 'shrinkage_bounded', count(*) FILTER (WHERE mu / 252 < least(sample_mean, prior) - 1e-12 OR mu / 252 > greatest(sample_mean, prior) + 1e-12), count(*) FROM c_shr
    UNION ALL SELECT 'ranks_dense', count(*) FILTER (WHERE t <> k OR l <> 1), count(*) FROM (SELECT date, max(rank) AS t, count(DISTINCT composite_score) AS k, min(rank) AS l FROM c_scored GROUP BY 1)
    UNION ALL SELECT 'weights_sum_to_one', count(*) FILTER (WHERE abs(s - 1) > 1e-9), count(*) FROM (SELECT portfolio, reb_no, sum(weight) AS s FROM c_w_both GROUP BY 1, 2)""")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
