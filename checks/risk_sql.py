"""DuckDB statements for the risk queries."""

from __future__ import annotations

import checks.core_sql  # noqa: F401
from checks.base import build, cte, r

SQL: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    SQL[name] = sql


def grid_ctes(tag: str, sets: str) -> None:
    """sets(grp, stock_id, lo, hi) -> dense observation grid c_<tag>_g."""
    cte(f"c_{tag}_g", f"""SELECT *, close / lag(close) OVER (PARTITION BY grp, stock_id ORDER BY idx) - 1 AS ret FROM (
        SELECT s.grp, s.stock_id, s.lo, s.hi, c.idx, c.idx - s.lo AS rw, p.close FROM {sets} s JOIN c_calendar c ON c.idx BETWEEN s.lo AND s.hi
        LEFT JOIN c_panel p ON p.stock_id = s.stock_id AND p.idx = c.idx)""")


def rank_pct(col: str, desc: bool = False) -> str:
    order = f"{col} DESC" if desc else col
    return (f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY grp ORDER BY {order} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY grp, {col}) - 1) / 2.0) / count({col}) OVER (PARTITION BY grp) END")


def rrc_ctes(tag: str) -> None:
    """c_<tag>_rrc(grp, stock_id, rrc_score, spike_dd, beta_compression, recovery_days, corr_drift)."""
    cte(f"c_{tag}_m", f"SELECT grp, idx, rw, avg(coalesce(ret, 0)) AS m FROM c_{tag}_g GROUP BY 1, 2, 3")
    cte(f"c_{tag}_v", f"""SELECT *, CASE WHEN rw >= 29 THEN round(stddev_samp(m) OVER (PARTITION BY grp ORDER BY idx ROWS 29 PRECEDING), 12) END AS v FROM c_{tag}_m""")
    cte(f"c_{tag}_f", f"""SELECT *, hi AND NOT coalesce(lag(hi) OVER (PARTITION BY grp ORDER BY idx), true) AS onset FROM (
        SELECT v.*, coalesce(v.v > t.q, false) AS hi FROM c_{tag}_v v JOIN (SELECT grp, quantile_cont(v, 0.75) AS q FROM c_{tag}_v GROUP BY 1) t ON t.grp = v.grp)""")
    cte(f"c_{tag}_sp", f"""SELECT grp, unnest(s[greatest(len(s) - 2, 1):]) AS s_idx FROM (SELECT grp, list_reduce(l, lambda a, x:
        CASE WHEN x[1] - a[len(a)] > 10 THEN list_concat(a, x) ELSE a END) AS s FROM (
          SELECT grp, list([idx] ORDER BY idx) AS l FROM c_{tag}_f WHERE onset GROUP BY 1))""")
    cte(f"c_{tag}_sdd", f"""SELECT grp, stock_id, avg(dd) AS spike_dd FROM (SELECT grp, stock_id, s_idx, min((close - pk) / pk) AS dd FROM (
        SELECT g.grp, g.stock_id, s.s_idx, g.close, max(g.close) OVER (PARTITION BY g.grp, g.stock_id, s.s_idx ORDER BY g.idx ROWS UNBOUNDED PRECEDING) AS pk
        FROM c_{tag}_g g JOIN c_{tag}_sp s ON s.grp = g.grp AND g.idx BETWEEN s.s_idx AND s.s_idx + 9 WHERE g.close IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
    cte(f"c_{tag}_roll", f"""SELECT grp, stock_id, idx, CASE WHEN rw >= 59 THEN covar_samp(x, m) OVER w / nullif(var_samp(m) OVER w, 0) END AS b,
          CASE WHEN rw >= 59 THEN covar_samp(x, m) OVER w / nullif(stddev_samp(x) OVER w * stddev_samp(m) OVER w, 0) END AS c
        FROM (SELECT g.grp, g.stock_id, g.idx, g.rw, coalesce(g.ret, 0) AS x, m.m FROM c_{tag}_g g JOIN c_{tag}_m m ON m.grp = g.grp AND m.idx = g.idx)
        WINDOW w AS (PARTITION BY grp, stock_id ORDER BY idx ROWS 59 PRECEDING)""")
    cte(f"c_{tag}_bc", f"""SELECT o.grp, o.stock_id, CASE WHEN count(*) FILTER (WHERE hi) > 5 AND count(*) FILTER (WHERE NOT hi) > 5
          THEN avg(coalesce(b, 1)) FILTER (WHERE NOT hi) - avg(coalesce(b, 1)) FILTER (WHERE hi) ELSE 0 END AS beta_compression,
          CASE WHEN count(*) FILTER (WHERE hi) > 5 AND count(*) FILTER (WHERE NOT hi) > 5
          THEN avg(coalesce(c, 1)) FILTER (WHERE NOT hi) - avg(coalesce(c, 1)) FILTER (WHERE hi) ELSE 0 END AS corr_drift, count(*) AS n_rows
        FROM c_{tag}_roll o JOIN c_{tag}_f f ON f.grp = o.grp AND f.idx = o.idx GROUP BY 1, 2""")
    cte(f"c_{tag}_d", f"""SELECT grp, stock_id, idx, (close - pk) / pk AS dd FROM (SELECT *, max(close) OVER (PARTITION BY grp, stock_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS pk
        FROM c_{tag}_g WHERE idx > hi - 252 AND close IS NOT NULL)""")
    cte(f"c_{tag}_t", f"SELECT grp, stock_id, min(dd) AS worst, arg_min(idx, (dd, idx)) AS trough FROM c_{tag}_d GROUP BY 1, 2")
    cte(f"c_{tag}_rec", f"""SELECT t.grp, t.stock_id, CASE WHEN any_value(t.worst) < -0.05 THEN
        coalesce(min(d.idx) FILTER (WHERE d.idx >= t.trough AND d.dd >= t.worst / 2) - any_value(t.trough) + 1, 252) ELSE 0 END AS rec
        FROM c_{tag}_t t JOIN c_{tag}_d d ON d.grp = t.grp AND d.stock_id = t.stock_id GROUP BY 1, 2""")
    cte(f"c_{tag}_x", f"""SELECT b.grp, b.stock_id, round(b.beta_compression, 12) AS bc, round(b.corr_drift, 12) AS cd, b.n_rows, coalesce(s.spike_dd, 0) AS sd, rec.rec,
        count(*) OVER (PARTITION BY b.grp) AS n FROM c_{tag}_bc b JOIN c_{tag}_rec rec ON rec.grp = b.grp AND rec.stock_id = b.stock_id
        LEFT JOIN c_{tag}_sdd s ON s.grp = b.grp AND s.stock_id = b.stock_id""")
    cte(f"c_{tag}_rrc", f"""SELECT grp, stock_id, CASE WHEN n_rows < 126 THEN 50.0 ELSE least(100, greatest(0, 100 * (0.30 * a + 0.25 * b + 0.25 * d + 0.20 * c))) END AS rrc_score,
        sd AS spike_dd, bc AS beta_compression, rec AS recovery_days, cd AS corr_drift FROM (SELECT *,
          CASE WHEN n > 5 THEN {rank_pct('sd')} ELSE least(1, greatest(0, 1 + sd / 0.10)) END AS a,
          CASE WHEN n > 5 THEN {rank_pct('bc')} ELSE least(1, greatest(0, 0.5 + bc)) END AS b,
          CASE WHEN n > 5 THEN {rank_pct('cd')} ELSE least(1, greatest(0, 0.5 + cd / 0.4)) END AS c,
          CASE WHEN n > 5 THEN {rank_pct('rec', True)} ELSE least(1, greatest(0, 1 - rec / 60.0)) END AS d FROM c_{tag}_x)""")


def sls_ctes(tag: str, bias: str | None = None) -> None:
    """c_<tag>_sls; needs c_<tag>_g and c_<tag>_rrc. bias: CTE (grp, stock_id, error_bias)."""
    out = f"c_{tag}b" if bias else f"c_{tag}"
    cte(f"c_{tag}_mr", f"SELECT grp, idx, avg(ret) AS mr FROM c_{tag}_g WHERE rw >= 1 AND ret IS NOT NULL GROUP BY 1, 2")
    cte(f"c_{tag}_mv", f"""SELECT grp, arg_max(v20, idx) AS v20, median(v126) AS v126, max(rn) AS n_ret FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) AS rn,
          CASE WHEN count(mr) OVER a >= 20 THEN stddev_samp(mr) OVER a END AS v20, CASE WHEN count(mr) OVER b >= 126 THEN stddev_samp(mr) OVER b END AS v126
        FROM c_{tag}_mr WINDOW a AS (PARTITION BY grp ORDER BY idx ROWS 19 PRECEDING), b AS (PARTITION BY grp ORDER BY idx ROWS 125 PRECEDING)) GROUP BY 1""")
    cte(f"{out}_ft", f"""SELECT *, (price - high) / high AS dd, (rnow - mean) / nullif(std, 0) AS z, count(*) OVER (PARTITION BY grp) AS n FROM (
        SELECT grp, stock_id, max(close) FILTER (WHERE idx = hi) AS price, max(close) FILTER (WHERE idx > hi - 126) AS high,
          max(ret) FILTER (WHERE idx = hi) AS rnow, avg(ret) FILTER (WHERE idx > hi - 126 AND rw >= 1) AS mean,
          stddev_samp(ret) FILTER (WHERE idx > hi - 126 AND rw >= 1) AS std,
          max(close) FILTER (WHERE idx = greatest(lo, hi - 125)) AS p6, max(close) FILTER (WHERE idx = greatest(lo, hi - 251)) AS p12
        FROM c_{tag}_g GROUP BY 1, 2) WHERE price IS NOT NULL""")
    join = f"LEFT JOIN {bias} e ON e.grp = f.grp AND e.stock_id = f.stock_id" if bias else ""
    eb = "coalesce(e.error_bias, 0)" if bias else "0.0"
    cte(f"{out}_ft2", f"SELECT f.*, {eb} AS eb, v.v20, v.v126, v.n_ret FROM {out}_ft f JOIN c_{tag}_mv v ON v.grp = f.grp {join}")
    err = (f"CASE WHEN n > 5 THEN {rank_pct('eb')} * 100 ELSE least(100, greatest(0, eb / 0.10 * 100)) END" if bias else "0.0")
    cte(f"{out}_comp", f"""SELECT *, coalesce(CASE WHEN n > 5 THEN {rank_pct('dd', True)} * 100 ELSE least(100, greatest(0, abs(dd) / 0.15 * 100)) END, 0) AS dd_score,
        coalesce(CASE WHEN n > 5 THEN {rank_pct('z', True)} * 100 WHEN z < 0 THEN least(100, greatest(0, abs(z) / 3.0 * 100)) END, 0) AS var_score,
        CASE WHEN price / p6 - 1 < 0 AND price / p12 - 1 < 0 THEN 100.0 ELSE 0.0 END AS mom_score, {err} AS err_score,
        CASE WHEN n_ret >= 21 AND v20 > CASE WHEN n > 5 THEN v126 ELSE 2.0 * v126 END THEN 100.0 ELSE 0.0 END AS regime_score FROM {out}_ft2""")
    cte(f"{out}_sls", f"""SELECT *, CASE WHEN s >= 80 THEN 'Critical' WHEN s >= 70 THEN 'High' WHEN s >= 40 THEN 'Moderate' ELSE 'Low' END AS risk_level,
        CASE WHEN s >= 80 THEN 'Exit' WHEN s >= 70 THEN 'Reduce' ELSE 'Hold' END AS recommended_action FROM (
        SELECT c.*, round(least(100, greatest(0, 0.90 * (0.25 * dd_score + 0.20 * var_score + 0.20 * mom_score + 0.20 * err_score + 0.15 * regime_score)
          + 0.10 * (100 - coalesce(x.rrc_score, 50)))), 9) AS s, high * (1 - least(0.30, greatest(0.05, 2.5 * coalesce(std * sqrt(252), 0.15)))) AS trig
        FROM {out}_comp c LEFT JOIN c_{tag}_rrc x ON x.grp = c.grp AND x.stock_id = c.stock_id)""")


def spans_cte(name: str, days: int, src: str = "SELECT reb_no AS grp, reb_date AS as_of FROM c_reb") -> None:
    cte(name, f"""SELECT a.grp, min(c.idx) AS lo, max(c.idx) AS hi FROM ({src}) a JOIN c_calendar c
        ON c.date BETWEEN a.as_of - {days} AND a.as_of GROUP BY 1""")


cte("c_first", "SELECT stock_id, min(idx) AS f FROM c_panel GROUP BY 1")
spans_cte("c_spans_403", 403)
spans_cte("c_spans_1835", 1835)
for tag, span in (("s4", "c_spans_403"), ("s5", "c_spans_1835")):
    cte(f"c_{tag}_sets", f"SELECT s.grp, f.stock_id, s.lo, s.hi FROM {span} s JOIN c_first f ON f.f <= s.hi")
    grid_ctes(tag, f"c_{tag}_sets")
    rrc_ctes(tag)
sls_ctes("s4")
cte("c_asof", """SELECT r.reb_no AS grp, r.score_date, h.p_intercept, h.p_bm, h.p_bv FROM (SELECT b.reb_no, b.score_date, max(h.window_end) AS we FROM c_reb b
    LEFT JOIN c_hist h ON h.window_end <= b.reb_date GROUP BY 1, 2) r LEFT JOIN c_hist h ON h.window_end = r.we""")
cte("c_bias", """SELECT a.grp, s.stock_id, coalesce(p_intercept, 0) + coalesce(p_bm, 0) * coalesce(momentum_score, 0) + coalesce(p_bv, 0) * coalesce(volatility_score, 0) AS error_bias
    FROM c_scored s JOIN c_asof a ON a.score_date = s.date""")
sls_ctes("s4", "c_bias")

COMP = ("dd_score", "var_score", "mom_score", "err_score", "regime_score")
PROFILE = f"""{r('s')} AS stop_loss_score, risk_level, recommended_action, {r('trig + 1e-9')} AS trigger_threshold, {r('dd')} AS raw_drawdown,
    {', '.join(f"{r(c)} AS {c}" for c in COMP)}"""
q("stop_loss_scores", f"SELECT grp, stock_id, {PROFILE} FROM c_s4_sls")
q("stop_loss_with_error_bias", f"SELECT grp, stock_id, {r('err_score')} AS err_score, {r('s')} AS stop_loss_score, risk_level FROM c_s4b_sls")
q("stop_loss_profiles", f"""SELECT g.grp, t.stock_id, {r('coalesce(s, 0)')} AS stop_loss_score, coalesce(risk_level, 'Unknown') AS risk_level,
    coalesce(recommended_action, 'Hold') AS recommended_action, {r('coalesce(trig, 0) + 1e-9')} AS trigger_threshold, {r('coalesce(dd, 0)')} AS raw_drawdown,
    {', '.join(f"{r(c)} AS {c}" for c in COMP)} FROM c_stocks t CROSS JOIN (SELECT reb_no AS grp FROM c_reb) g
    LEFT JOIN c_s4_sls s ON s.grp = g.grp AND s.stock_id = t.stock_id""")
def set_ctes(tag: str, members: str) -> None:
    """c_<tag>_sls of members(grp, stock_id, reb_no); a window starts at the first day on which a member has a price."""
    cte(f"c_{tag}_sets", f"""SELECT w.grp, w.stock_id, greatest(s.lo, min(f.f) OVER (PARTITION BY w.grp)) AS lo, s.hi FROM ({members}) w
        JOIN c_spans_403 s ON s.grp = w.reb_no JOIN c_first f ON f.stock_id = w.stock_id""")
    grid_ctes(tag, f"c_{tag}_sets")
    rrc_ctes(tag)
    sls_ctes(tag)


set_ctes("sec", "SELECT portfolio || '@' || reb_no AS grp, stock_id, reb_no FROM c_w_user")
q("sector_set_stop_loss", f"SELECT grp, stock_id, {PROFILE} FROM c_sec_sls")
cte("c_ten", """SELECT * FROM (SELECT b.reb_no, b.reb_date, s.stock_id, s.rank, s.composite_score, row_number() OVER (PARTITION BY b.reb_no ORDER BY s.rank, s.stock_id) AS position
    FROM c_scored s JOIN c_reb b ON b.score_date = s.date) WHERE position <= 10""")
set_ctes("ten", "SELECT reb_no AS grp, stock_id, reb_no FROM c_ten")
q("top_stocks_with_risk", f"""SELECT t.stock_id, t.reb_no, t.reb_date, t.rank, t.position, {r('t.composite_score')} AS composite_score, {r('s')} AS stop_loss_score, risk_level, recommended_action,
    {r('trig + 1e-9')} AS trigger_threshold, {r('x.dd')} AS raw_drawdown, symbol, sector FROM c_ten t LEFT JOIN c_ten_sls x ON x.grp = t.reb_no AND x.stock_id = t.stock_id JOIN c_stocks k ON k.stock_id = t.stock_id""")
RRC = ", ".join(f"{r(c)} AS {c}" for c in ("rrc_score", "spike_dd", "beta_compression", "recovery_days", "corr_drift"))
q("stock_responsiveness", f"SELECT grp, stock_id, {RRC} FROM c_s5_rrc")
spans_cte("c_spans_one", 1835, "SELECT 0 AS grp, max(date) AS as_of FROM c_scored")
cte("c_one_sets", "SELECT f.stock_id AS grp, f.stock_id, greatest(s.lo, f.f) AS lo, s.hi FROM c_first f CROSS JOIN c_spans_one s")
grid_ctes("one", "c_one_sets")
rrc_ctes("one")
q("single_stock_responsiveness", f"""SELECT stock_id, {r('rrc_score')} AS rrc_score, {r('spike_dd')} AS spike_dd, {r('recovery_days')} AS recovery_days FROM c_one_rrc""")


def statements() -> dict[str, str]:
    return {k: build(v) for k, v in SQL.items()}
