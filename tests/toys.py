"""Small frames with known structure."""

import datetime as dt

import numpy as np
import pandas as pd

from riskloom import schema
from riskloom.frames import Frames
from riskloom.operators import scenarios as sc

D = dt.date


def attribution_frames(spark):
    ends, days = [D(2024, 1, 31), D(2024, 2, 29)], [D(2024, 2, 5), D(2024, 2, 12), D(2024, 3, 4), D(2024, 3, 11)]
    load = {("AAA", "Size"): 0.5, ("AAA", "Market"): 1.0, ("BBB", "Size"): -1.0, ("BBB", "Market"): 1.0}
    mk = lambda rows, name: spark.createDataFrame(rows, schema.SCHEMAS[name])
    return Frames(spark, {
        "exposures": mk([(d, p, f, v) for d in ends for (p, f), v in load.items()], "exposures"),
        "factor_returns": mk([(d, f, r) for d in days for f, r in (("Market", 0.01), ("Size", 0.002))], "factor_returns"),
        "specific_returns": mk([(d, p, e) for d in days for p, e in (("AAA", 0.003), ("BBB", -0.001))], "specific_returns"),
        "positions": mk([(d, "Book", p, w, m, None) for d in ends for p, w, m in (("AAA", 0.6, 60.0), ("BBB", 0.4, 40.0))], "positions"),
        "securities": mk([(p, p.lower(), 1, None, p, "S", "US") for p in ("AAA", "BBB")], "securities"),
        "specific_var": mk([(d, p, 1e-4) for d in ends for p in ("AAA", "BBB")], "specific_var"),
        "factor_meta": mk([("Market", "Market"), ("Size", "Style")], "factor_meta"),
    })


def risk_frames(spark, names=6, days=60, seed=3):
    """Two books over the same names with reversed weights; returns (frames, numpy parts)."""
    rng = np.random.default_rng(seed)
    date = D(2024, 1, 31)
    P = [f"P{i + 1}" for i in range(names)]
    val = rng.normal(size=names)
    w = rng.dirichlet(np.ones(names))
    bd = [x.date() for x in pd.bdate_range("2023-11-01", periods=days)]
    F = rng.normal(0, 0.01, (days, 2))
    sv = 0.0004 + 0.0001 * np.arange(names)
    mk = lambda rows, name: spark.createDataFrame(rows, schema.SCHEMAS[name])
    fr = mk([(d, f, float(F[i, j])) for i, d in enumerate(bd) for j, f in enumerate(("Market", "Value"))], "factor_returns")
    f = Frames(spark, {
        "exposures": mk([(date, p, "Market", 1.0) for p in P] + [(date, p, "Value", float(v)) for p, v in zip(P, val)], "exposures"),
        "positions": mk([(date, "A", p, float(x), float(x) * 1e8, 5e6) for p, x in zip(P, w)]
                        + [(date, "B", p, float(x), float(x) * 5e7, 5e6) for p, x in zip(P, w[::-1])], "positions"),
        "securities": mk([(p, p.lower(), i, None, "I" + p, ("Technology", "Financials")[i % 2], "US") for i, p in enumerate(P)], "securities"),
        "factor_meta": mk([("Market", "Market"), ("Value", "Style")], "factor_meta"),
        "factor_returns": fr,
        "specific_var": mk([(date, p, float(s)) for p, s in zip(P, sv)], "specific_var"),
        "scenarios": sc.scenario_sets(fr, {}, {"Hypo:V": {"Value": 2.0}}),
    })
    return f, {"date": date, "P": P, "L": np.column_stack([np.ones(names), val]), "w": {"A": w, "B": w[::-1]}, "F": F, "sv": sv}
