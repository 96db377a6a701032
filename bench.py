"""Headline timings: one JSON line. $BENCH_SF_DIR and $BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# the single-book pivot, the measure ladder, decomposition, attribution and model building
HEADLINE = [
    "ag01_net_exposure", "ag03_specific_risk", "vec04_var_ladder", "vec05_expected_shortfall", "vec10_model_vol",
    "vec11_marginal_var", "vec13_marginal_total_var", "vec15_top5_share", "vec16_incremental_var", "vec20_vol_ex_factor",
    "vec23_custom_stress", "ag07_margins", "qry03_book_tile", "qry07_trends", "qry02_whatif", "mod12_hedge_table",
    "mod14_backtest_fhs", "mod15_drawdown", "win02_beta_residual_vol", "win07_ewma_specific_var", "mod16_attribution",
    "mod18_by_factor", "mod22_calibration", "mod21_linkage", "mod24_funnel", "mod25_span", "mod26_drift_attribution",
    "mod28_hidden_betas", "mod29_limits", "mod30_liquidity", "mod36_loadings", "mod01_factor_returns", "mod37_build_frames", "mod31_what_changed", "mod07_whatif_risk",
]


def main() -> None:
    from riskloom.catalog import queries
    from riskloom.session import local_session
    from riskloom.sources import tables

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "riskloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times: dict[str, float] = {}
    t0 = time.time()
    f = tables.frames(spark, sf)
    for n in list(f):
        f[n]
    times["build_frames"] = round(time.time() - t0, 3)
    q = queries()
    for name in HEADLINE:
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        # every row is computed; nothing is brought to the driver
        q[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    if not only:
        from riskloom.plans.pivot import pivot

        t0 = time.time()
        pivot(f, ["Date", "Book", "Position"], ["Net exposure"]).write.format("noop").mode("overwrite").save()
        times["date_position_pivot"] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
