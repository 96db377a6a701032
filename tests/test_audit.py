"""Windowed audit, breach drivers and residual verdicts against pandas on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import audit, drivers
from riskloom.operators.residuals import CHECKS, residual_checks

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", "2021-06-30")]
FACTORS = ["Market", "Size", "Value"]


@pytest.fixture(scope="module")
def series():
    r = np.random.default_rng(11)
    f = pd.DataFrame(r.normal(0.001, 0.01, (len(DAYS), 3)), index=pd.DatetimeIndex(DAYS), columns=FACTORS)
    f.loc["2021":, "Value"] = 0.9 * f.loc["2021":, "Size"] + r.normal(0, 0.002, len(f.loc["2021":]))  # collinear late only
    u = pd.DataFrame(r.normal(0, 0.01, (len(DAYS), 3)), index=f.index, columns=["A", "B", "C"])
    u["B"] += 0.8 * f["Size"]
    u.loc[r.random(len(u)) < 0.3, "C"] = np.nan
    return f, u


def long(spark, frame, name, value):
    rows = [(d.date(), c, float(v)) for d, row in frame.iterrows() for c, v in row.items() if not np.isnan(v)]
    return spark.createDataFrame(rows, f"Date date, {name} string, {value} double")


def test_rolling_correlations(spark, series):
    f, _ = series
    got = {(r.Date, r.a, r.b): (r.rho, r.n) for r in audit.rolling_correlations(long(spark, f, "Factor", "Return"), 6).collect()}
    ends = sorted({(d + pd.offsets.MonthEnd(0)).date() for d in f.index})
    for e in ends:
        part = f[(f.index <= pd.Timestamp(e)) & (f.index > pd.Timestamp(e) - pd.offsets.MonthEnd(6))]
        for i, a in enumerate(FACTORS):
            for b in FACTORS[i + 1:]:
                assert got.get((e, a, b)) == pytest.approx((part[a].corr(part[b]), len(part)), abs=1e-9) if len(part) >= 20 else (e, a, b) not in got
    pairs = {(r.Date, r.a, r.b) for r in audit.rolling_pairs(long(spark, f, "Factor", "Return"), 0.8, 6).collect()}
    assert pairs and all(x[1:] == ("Size", "Value") and x[0] >= dt.date(2021, 3, 31) for x in pairs)


def test_rolling_hidden_betas(spark, series):
    f, u = series
    held = [(dt.date(2021, 3, 31), "K", "A", 0.5), (dt.date(2021, 3, 31), "K", "B", 0.3), (dt.date(2021, 6, 30), "K", "B", 0.6), (dt.date(2021, 6, 30), "L", "C", 1.0), (dt.date(2021, 6, 30), "L", "none", 1.0)]
    h = spark.createDataFrame(held, "Date date, Book string, Position string, Weight double")
    b = audit.rolling_hidden_betas(long(spark, u, "Position", "SpecificReturn"), long(spark, f, "Factor", "Return"), h, 12, 100)
    got = {(r.Date, r.Book, r.Position, r.Factor): (r.beta, r.t, r.n) for r in b.collect()}
    assert len(got) == 8  # four names with data, two factors
    for e, book, p, _ in held[:4]:
        in_window = (f.index <= pd.Timestamp(e)) & (f.index > pd.Timestamp(e) - pd.offsets.MonthEnd(12)) & u[p].notna() if p in u else None
        for k in ("Size", "Value"):
            x, y = f.loc[in_window, k].to_numpy(), u.loc[in_window, p].to_numpy()
            beta = np.cov(y, x, ddof=1)[0, 1] / x.var(ddof=1)
            se = np.sqrt(np.var(y - beta * x, ddof=1) / (len(x) * x.var(ddof=1)))
            assert got[e, book, p, k] == pytest.approx((beta, beta / se, len(x)), rel=1e-8)
    s = {(r.Date, r.Book, r.Factor): r for r in audit.rolling_beta_summary(b).collect()}
    assert s[dt.date(2021, 6, 30), "K", "Size"].flag == "HIDDEN BETA" and s[dt.date(2021, 6, 30), "L", "Size"].n_names == 1
    assert audit.rolling_hidden_betas(long(spark, u, "Position", "SpecificReturn"), long(spark, f, "Factor", "Return"), h, 1, 100).count() == 0


def test_breach_drivers_and_hidden_betas(spark):
    lo, hi = dt.date(2021, 1, 31), dt.date(2021, 2, 28)
    kind = "Book string, Position string, Weight double, realized double, factor_pnl double, specific_pnl double, z double, verdict string, driver string, dust boolean"
    names = [("K", "A", .5, .1, .09, .01, 3., "investigate", "factor_move", False), ("K", "B", .3, .1, .05, .05, 2.5, "stress", "mixed", False),
             ("K", "C", .2, .1, .01, .09, 4., "investigate", "specific_move", False), ("K", "D", .1, .0, .0, .0, .1, "within", None, False),
             ("K", "E", .0001, .1, .0, .1, 9., "investigate", "specific_move", True)]
    expo = [(lo, p, f, v) for p, x in {"A": (1., 2., 0.), "B": (.1, 0., -3.), "C": (1., 1., 1.), "D": (1., 1., 1.)}.items() for f, v in zip(FACTORS, x)]
    panel = spark.createDataFrame([(dt.date(2021, 2, d), f, v) for d in (1, 2) for f, v in zip(FACTORS, (.001, .01, -.02))] + [(lo, "Size", 9.0)], "Date date, Factor string, Return double")
    link = spark.createDataFrame([("K", "Size", "factor", "within"), ("K", "Value", "factor", "investigate"), ("K", "Market", "factor", "within"), ("K", "Specific", "specific", "stress")],
                                 "Book string, name string, kind string, verdict string")
    out = drivers.breach_drivers(spark.createDataFrame(names, kind), link, spark.createDataFrame(expo, "Date date, Position string, Factor string, Loading double"), panel, lo, hi)
    got = {r.Position: r for r in out.collect()}
    assert set(got) == {"A", "B", "C", "E"}
    assert (got["A"].top_factor, got["A"].factor_verdict, got["A"].hidden_beta) == ("Size", "within", True) and got["A"].top_pnl == pytest.approx(.5 * 2 * .02)
    assert (got["B"].top_factor, got["B"].factor_verdict, got["B"].hidden_beta) == ("Value", "investigate", False) and got["B"].top_pnl == pytest.approx(.3 * 3 * .04)
    assert got["C"].top_factor == "Value" and not got["C"].hidden_beta and got["E"].top_factor is None and not got["E"].hidden_beta

    r = np.random.default_rng(2)
    common = r.normal(size=20)
    sr = [(dt.date(2021, 2, 1) + dt.timedelta(i), p, float(common[i] + 0.2 * r.normal())) for p in "BCE" for i in range(20)]
    frames = {"specific_returns": spark.createDataFrame(sr, "Date date, Position string, SpecificReturn double"),
              "securities": spark.createDataFrame([("B", "Tech"), ("C", "Tech"), ("E", "Energy")], "Position string, Sector string")}
    c = drivers.breach_comovement(out, frames, lo, hi, 5).collect()[0]
    assert (c.n_names, c.n_pairs, c.verdict, c.shared_sector) == (2, 1, "common_thread", "Tech")
    x = {p: np.array([v for _, q, v in sr if q == p]) for p in "BC"}
    assert c.mean_corr == pytest.approx(np.corrcoef(x["B"], x["C"])[0, 1], abs=1e-9)


def test_aggregate_rows_blame_the_forecast(spark):
    rows = [("K", "Size", "factor", 3.0, "investigate", 0.1, "mixed", 1.0), ("K", "Specific", "specific", 2.2, "stress", 0.1, None, None), ("K", "Book total", "book", 0.3, "within", 0.1, None, None)]
    df = spark.createDataFrame(rows, "Book string, name string, kind string, z double, verdict string, sd_base double, driver string, factor_sigma double")
    got = {r.name: (r.driver, r.factor_sigma) for r in drivers.aggregate_drivers(df).collect()}
    assert got == {"Size": ("mixed", 1.0), "Specific": ("vol_underforecast", 2.2), "Book total": (None, None)}


def test_residual_checks(spark, series):
    f, u = series
    lo, hi = DAYS[0], DAYS[-1]
    spec, real = u["B"], u["B"] + f.sum(axis=1)
    art = [("K", d.date(), "contribution", s, float(v), lo, hi) for s, x in (("Specific", spec), ("Realized", real)) for d, v in x.items()]
    ends = [e.date() for e in pd.date_range("2020-01-31", "2021-05-31", freq="ME")]
    vols = [(e, "K", 0.02 + 0.001 * i, 0.008 + 0.0002 * i) for i, e in enumerate([dt.date(2019, 12, 31), *ends])]
    wide = spark.createDataFrame([(d.date(), *map(float, row)) for d, row in zip(f.index, f.to_numpy())], "Date date, Market double, Size double, Value double")
    out = residual_checks(spark.createDataFrame(art, "Book string, Date date, Kind string, Source string, Value double, lo date, hi date"),
                          spark.createDataFrame(vols, "Date date, Book string, book_vol double, specific_vol double"), wide, FACTORS)
    got = {r.name: r for r in out.collect()}
    assert set(got) == {*CHECKS, "overall"}
    m, rm, n = spec.resample("ME").sum(), real.resample("ME").sum(), real.resample("ME").count()
    seen = {e: (b, s) for e, _, b, s in vols if e >= lo}  # the vol of December 2019 lies before the window
    z = {e: ((pd.Timestamp(e) + pd.offsets.MonthEnd(1))) for e in seen}
    zb = [rm[x] / (seen[e][0] * np.sqrt(n[x])) for e, x in z.items()]
    zs = [m[x] / (seen[e][1] * np.sqrt(n[x])) for e, x in z.items()]
    x = np.column_stack([np.ones(len(f)), f.to_numpy()])
    res = spec - x @ np.linalg.lstsq(x, spec, rcond=None)[0]
    want = {"ir": m.mean() / m.std() * np.sqrt(12), "vol_ratio": spec.std() / np.mean([s for _, s in seen.values()]), "autocorr1": np.corrcoef(m[1:], m[:-1])[0, 1],
            "autocorr2": np.corrcoef(m[2:], m[:-2])[0, 1], "r2": 1 - (res @ res) / ((spec - spec.mean()) @ (spec - spec.mean())), "bias_book": np.std(zb, ddof=1), "bias_specific": np.std(zs, ddof=1)}
    for k, v in want.items():
        assert got[k].value == pytest.approx(v, abs=1e-8), k
    assert got["bias_book"].half_width == pytest.approx(np.sqrt(2 / len(zb))) and got["r2"].status == "red" and got["overall"].status == "red"
