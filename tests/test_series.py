import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.joins import asof_join, owner_month
from riskloom.functions.quantiles import average_rank_pct, exact_quantiles
from riskloom.operators import attribution as at, timeseries as ts
from toys import attribution_frames

D = dt.date


def series(spark, v):
    d0 = D(2020, 1, 1)
    return spark.createDataFrame([("b", i, d0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(v)], "Book string, i int, d date, r double")


def test_attribution_identity(spark):
    a = at.compute_attribution(attribution_frames(spark)).toPandas()
    c = a[a.Kind == "contribution"].pivot(index="Date", columns="Source", values="Value")
    assert (c["Realized"] - c.drop(columns="Realized").sum(axis=1)).abs().max() < 1e-15
    assert c["Realized"].iloc[0] == pytest.approx(0.6 * (0.01 + 0.001 + 0.003) + 0.4 * (0.01 - 0.002 - 0.001))
    assert (a[a.Kind == "coverage"].Value - 1).abs().max() < 1e-12
    lk = at.carino(at.window_of(at.compute_attribution(attribution_frames(spark)))).toPandas()
    assert lk.linked.sum() == pytest.approx(lk.rg.iloc[0], abs=1e-14)


def test_hysteresis_matches_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(f"n{k}", m, float(rng.uniform(0, 100))) for k in range(40) for m in range(30) if rng.uniform() > 0.15]
    got = {(r.n, r.m): r.inside for r in ts.hysteresis(spark.createDataFrame(rows, "n string, m int, p double"), ["n"], "m", "p", 55, 50).collect()}
    prev: set = set()
    for m in range(30):
        now = {n for n, mm, p in rows if mm == m and (p >= 55 or (n in prev and p >= 50))}
        assert all(got[(n, mm)] == (n in now) for n, mm, _ in rows if mm == m)
        prev = now


def test_thresholds_and_backtest(spark):
    rng = np.random.default_rng(0)
    r = np.concatenate([rng.normal(0, 0.01, 300), rng.normal(0, 0.1, 60)])
    s = series(spark, r)
    thr = {m: [x.thr for x in ts.var_thresholds(s, ["Book"], "i", "r", 250, 0.99, m).orderBy("i").collect()] for m in ("equal", "ewma", "fhs")}
    assert thr["equal"][280] == pytest.approx(np.quantile(r[30:280], 0.01))
    s2 = np.var(r[:250])
    for t in range(1, 306):
        s2 = 0.94 * s2 + 0.06 * r[t - 1] ** 2
    assert thr["ewma"][305] == pytest.approx(-2.3263478740408408 * np.sqrt(s2), rel=1e-9)
    assert thr["ewma"][305] < thr["equal"][305] and thr["fhs"][305] < thr["equal"][305]
    b = ts.backtest(s, ["Book"], "i", "r", 250, 0.99, "equal").collect()[0]
    assert b.tested == 110 and b.status == "ok"
    assert ts.backtest(series(spark, r[:50]), ["Book"], "i", "r").collect()[0].status == "insufficient"


def test_basel_and_kupiec(spark):
    d = spark.createDataFrame([(i, 250) for i in range(13)], "x int, n int")
    r = d.select("x", ts.basel_zone(ts.binomial_cdf(F.col("x"), F.col("n"), 0.01)).alias("z"), ts.kupiec_lr(F.col("x"), F.col("n"), 0.01).alias("lr")).collect()
    assert [x.z for x in r] == ["green"] * 5 + ["amber"] * 5 + ["red"] * 3
    assert r[2].lr < 3.841 and r[3].lr < 3.841 and r[10].lr > 3.841 and np.isfinite(r[0].lr)


def test_drawdown(spark):
    x = ts.drawdown(series(spark, [0.10, 0.10, -0.30, 0.05, 0.40]), ["Book"], "d", "r").collect()[0]
    assert x.max_drawdown == pytest.approx(-0.30) and x.drawdown_obs == 1 and x.recovered and x.longest_underwater_obs == 2
    assert ts.drawdown(series(spark, [0.1]), ["Book"], "d", "r").collect()[0].status == "insufficient"


def test_ewma_and_rolling(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=400)
    s = series(spark, v)
    e = [x.ewma for x in ts.ewma_variance(s, ["Book"], "d", "r").orderBy("i").collect()]
    assert np.allclose(e, pd.Series(v**2).ewm(halflife=63).mean())
    c = [x.s for x in ts.rolling_sums(s, ["Book"], "i", {"s": F.col("r")}, 63).orderBy("i").collect()]
    assert np.allclose(c, pd.Series(v).rolling(63, min_periods=1).sum())


def test_betas_match_numpy(spark):
    rng = np.random.default_rng(5)
    n = 300
    m, x = rng.normal(0, 0.01, n), rng.normal(0, 0.01, n)
    s = 1.3 * m + 0.4 * x + rng.normal(0, 0.005, n)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    ret = spark.createDataFrame([("P", d, float(v) if i else None) for i, (d, v) in enumerate(zip(days, s))], "Position string, Date date, ret double")
    mk = lambda v: spark.createDataFrame([(d, float(y)) for d, y in zip(days, v)], "Date date, ret double")
    r = ts.betas(ret, mk(m), {"RateBeta": mk(x)}).orderBy("Date").collect()
    a, b, c = s[-252:], m[-252:], x[-252:]
    beta = np.cov(a, b)[0, 1] / b.var(ddof=1)
    rr = c - np.cov(c, b)[0, 1] / b.var(ddof=1) * b
    assert r[-1].Beta == pytest.approx(beta, rel=1e-9)
    assert r[-1].ResidVol == pytest.approx((a - beta * b).std(ddof=1) * np.sqrt(252), rel=1e-9)
    assert r[-1].RateBeta == pytest.approx(np.cov(a, rr)[0, 1] / rr.var(ddof=1), rel=1e-9)
    assert r[118].Beta is None and r[119].Beta is not None


def test_exact_quantiles_with_hot_value(spark):
    """A third of all rows share one group and value; results stay exact through the bucketed path."""
    rng = np.random.default_rng(4)
    v = {"hot": np.concatenate([np.full(2000, 1.5), rng.normal(size=3000)]), "b": rng.normal(size=777), "c": np.array([2.0])}
    df = spark.createDataFrame([(g, float(x)) for g, a in v.items() for x in a], "g string, v double")
    for r in exact_quantiles(df, ["g"], "v", {"p01": 0.01, "med": 0.5, "p99": 0.99}).collect():
        assert np.allclose([r.p01, r.med, r.p99], np.quantile(v[r.g], [0.01, 0.5, 0.99]))
    got = average_rank_pct(df, ["g"], "v").toPandas()
    for g, a in v.items():
        x = got[got.g == g].sort_values("v")
        assert np.allclose(x.pct, np.sort(pd.Series(a).rank(pct=True)))


def test_asof_and_owner_month(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 10)), ("b", D(2024, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("a", D(2024, 1, 5), 1), ("a", D(2024, 1, 8), 2)], "k string, s date, v int")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "s").collect()}
    assert got == {("a", D(2024, 1, 5)): 1, ("a", D(2024, 1, 10)): 2, ("b", D(2024, 1, 1)): None}
    strict = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "s", strict=True).collect()}
    assert strict[("a", D(2024, 1, 5))] is None
    ends = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 29),)], "Date date")
    days = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 1),), (D(2024, 2, 29),), (D(2024, 3, 1),)], "Date date")
    own = {r.Date: r.d0 for r in owner_month(days, ends).collect()}
    assert own == {D(2024, 2, 1): D(2024, 1, 31), D(2024, 2, 29): D(2024, 1, 31), D(2024, 3, 1): D(2024, 2, 29)}


@pytest.mark.parametrize("n", [13_000, 100_000])
def test_ewma_of_long_series(spark, n):
    r = np.random.default_rng(8).normal(scale=0.01, size=n)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(n), "r": r}), "k string, i long, r double")
    got = ts.ewma_sigma(df, ["k"], "i", "r", 250, 0.94).orderBy("i").toPandas().sigma.values
    s2 = np.empty(n)
    s2[0] = r[:250].var()
    for t in range(1, n):
        s2[t] = 0.94 * s2[t - 1] + 0.06 * r[t - 1] ** 2
    assert np.isfinite(got).all() and np.allclose(got, np.sqrt(s2), rtol=1e-9)
    got = ts.ewma_variance(df, ["k"], "i", "r", 63).orderBy("i").toPandas().ewma.values
    lam, num, den = 0.5 ** (1 / 63), 0.0, 0.0
    want = np.empty(n)
    for t in range(n):
        num, den = lam * num + r[t] ** 2, lam * den + 1
        want[t] = num / den
    assert np.allclose(got, want, rtol=1e-9)


def test_drawdown_of_a_wiped_out_series(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, -1.0, 0.1])] + [("b", i, v) for i, v in enumerate([-1.5, 0.2])], "k string, i int, r double")
    got = {x.k: x for x in ts.drawdown(df, ["k"], "i", "r").collect()}
    assert got["a"].status == "wiped_out" and got["a"].max_drawdown == -1.0 and got["a"].trough_date == 1 and not got["a"].recovered
    assert got["b"].status == "wiped_out"


def test_comovement_with_staggered_gaps(spark):
    from riskloom.operators.attribution import comovement

    rng = np.random.default_rng(3)
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    common = rng.normal(size=60)
    rows = [(d, f"P{k}", float(common[i] + 0.5 * rng.normal())) for k in range(30) for i, d in enumerate(days) if i not in (2 * k, 2 * k + 1)]
    sr = spark.createDataFrame(rows, "Date date, Position string, SpecificReturn double")
    names = spark.createDataFrame([("B", f"P{k}") for k in range(30)], "Book string, Position string")
    got = comovement(sr, names, D(2023, 1, 1), D(2025, 1, 1)).collect()[0]
    wide = pd.DataFrame(rows, columns=["d", "p", "r"]).pivot(index="d", columns="p", values="r")
    c = wide.corr().values
    assert got.n_names == 30 and got.n_pairs == 435 and got.n_obs == 60 and got.verdict == "common_thread"
    assert got.mean_corr == pytest.approx(c[np.triu_indices(30, 1)].mean(), abs=0.02)


def test_pages_are_complete(spark):
    from riskloom.plans.views import page

    df = spark.createDataFrame([(i % 7, f"n{i:03d}") for i in range(100)], "v int, k string")
    seen, after = [], None
    while rows := page(df, [("v", True), ("k", False)], 13, after).collect():
        seen += [(r.v, r.k) for r in rows]
        after = seen[-1]
    assert seen == sorted(((i % 7, f"n{i:03d}") for i in range(100)), key=lambda x: (-x[0], x[1]))


def test_attribution_over_regimes_of_several_months_and_parts_of_one(spark):
    """Books that change at different days, gaps, names without returns, a null name and repeated rows, against a plain loop."""
    import datetime as dt
    import math
    import random

    from riskloom.operators import attribution as at

    rnd = random.Random(2)
    day = lambda s: dt.date.fromisoformat(s)
    ends = [day("2020-01-31"), day("2020-02-29"), day("2020-03-31")]
    days = [day("2020-02-01") + dt.timedelta(i) for i in range(0, 75, 3)]
    names = ["A", "B", "C", "D"]
    load = {(e, n, f): rnd.uniform(-1, 1) for e in ends for n in names for f in ("Market", "Size") if (n, f) != ("B", "Size")}
    fac = {(d, f): rnd.uniform(-0.02, 0.02) for d in days for f in ("Market", "Size")}
    eps = {(d, n): rnd.uniform(-0.05, 0.05) for d in days for n in names if n != "D" and rnd.random() < 0.8}
    w = {("X", day("2020-01-31")): {"A": 0.5, "B": 0.5}, ("X", day("2020-02-29")): {"A": 0.5, "B": 0.5}, ("X", day("2020-03-31")): {"A": 0.2, "C": 0.8},
         ("Y", day("2020-02-10")): {"A": 0.3, "D": 0.4, None: 0.3}, ("Y", day("2020-03-20")): {"B": 0.6, "C": 0.4}}
    pos = [(d, b, n, v, 1.0, 1.0) for (b, d), m in w.items() for n, v in m.items() if (b, n) != ("Y", "C")]
    pos += [(day("2020-03-20"), "Y", "C", 0.1, 1.0, 1.0), (day("2020-03-20"), "Y", "C", 0.3, 1.0, 1.0)]
    f = {"positions": spark.createDataFrame(pos, "Date date, Book string, Position string, Weight double, MV double, ADV double"),
         "exposures": spark.createDataFrame([(*k, v) for k, v in load.items()], "Date date, Position string, Factor string, Loading double"),
         "factor_returns": spark.createDataFrame([(*k, v) for k, v in fac.items()], "Date date, Factor string, Return double"),
         "specific_returns": spark.createDataFrame([(*k, v) for k, v in eps.items()], "Date date, Position string, SpecificReturn double"),
         "securities": spark.createDataFrame([(n, "t" + n) for n in names], "Position string, Ticker string")}
    regimes = {"X": [(day("2020-01-31"), day("2020-03-31")), (day("2020-03-31"), None)], "Y": [(day("2020-02-10"), day("2020-03-20")), (day("2020-03-20"), None)]}
    want = {}
    for b, spans in regimes.items():
        for a, z in spans:
            held, up, total, seen = w[b, a], {}, sum(w[b, a].values()), set()
            for d in [d for d in days if d > a and (z is None or d <= z)]:
                d0 = max(e for e in ends if e < d)
                gain = spec = priced = 0.0
                x = {"Market": 0.0, "Size": 0.0}
                for n, v0 in held.items():
                    if (d, n) not in eps:
                        continue
                    seen.add(n)
                    v = v0 * up.get(n, 1.0)
                    r = eps[d, n] + sum(load.get((d0, n, g), 0.0) * fac[d, g] for g in x)
                    gain, spec, priced = gain + v * r, spec + v * eps[d, n], priced + v
                    for g in x:
                        x[g] += v * load.get((d0, n, g), 0.0)
                    up[n] = up.get(n, 1.0) * (1 + r)
                rows = {("contribution", "Specific"): spec, ("contribution", "Realized"): gain, ("coverage", "priced_share"): priced,
                        **{("exposure", g): x[g] for g in x}, **{("contribution", g): x[g] * fac[d, g] for g in x}}
                want |= {(b, d, *k): v / total for k, v in rows.items()}
                total += gain
            want |= {(b, a, "unpriced", n and "t" + n): v for n, v in held.items() if n not in seen}
    got = {}
    for r in at.compute_attribution(f).collect():
        k = (r.Book, r.Date, r.Kind, r.Source)
        got[k] = got.get(k, 0.0) + r.Value
    assert set(got) == set(want) and ("Y", day("2020-02-10"), "unpriced", "tD") in got
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_books_meet_one_row_per_name_and_month(spark):
    """A book's name has one row per month, its days ride in it; no row per book, name and day is dealt."""
    from riskloom.operators import attribution as at
    from riskloom.sources import tables

    f = tables.frames(spark, "/root/testdata/sf0.001")
    h = at._held_months(f, at.regime_days(f.positions, f.exposures, f.factor_returns))
    assert h.count() <= f.positions.count() < at._days_of(h).count()
