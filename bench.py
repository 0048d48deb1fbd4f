"""Headline timings: one JSON line. Stages are timed in order and each reads the tables staged before it."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantfold.plans.catalog import all_queries  # noqa: E402
from quantfold.plans.market import market  # noqa: E402
from quantfold.session import local_session  # noqa: E402

HEADLINE = [
    "composite_scores_ranked",  # prices, panel, factors and ranks from the raw trades
    "strategy_comparison",  # both strategies, all rebalances, equity curves and metrics
    "portfolio_comparison",  # five saved portfolios: backtest, stability, responsiveness, correlation, rating
    "stop_loss_scores",  # every stock at every rebalance date
    "stock_responsiveness",  # five-year responsiveness of every stock at every rebalance date
    "hybrid_weights",  # hybrid build at every rebalance date
    "hybrid_backtest_summary",
    "weight_sensitivity",
    "error_coefficients",
    "daily_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = all_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    m = market(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rebalances": m.rebalances.count(),
                "panel_rows": m.panel.count(),
            }
        )
    )


if __name__ == "__main__":
    main()
