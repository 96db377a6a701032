import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans.pivot import PivotError, pivot, register_measure, MEASURES
from toys import risk_frames

HF = {"ScenarioSet": ["HistFull"]}


@pytest.fixture(scope="module")
def toy(spark):
    return risk_frames(spark)


def test_measures_match_numpy(toy):
    f, n = toy
    rows = pivot(f, ["Book"], ["Scenario VaR 99", "Scenario VaR 95", "Scenario ES 97.5", "Scenario PnL vol", "Model vol", "Total VaR 99",
                               "Scenario worst loss", "Exceedance rate 2s", "Scenario n"], filters={"Date": [n["date"]], **HF}).collect()
    for r in rows:
        w = n["w"][r["Book"]]
        p = n["F"] @ (n["L"].T @ w)
        s = float(w**2 @ n["sv"])
        k = int(np.ceil(0.025 * len(p)))
        assert r["Scenario VaR 99"] == pytest.approx(-np.percentile(p, 1), abs=1e-12)
        assert r["Scenario VaR 95"] == pytest.approx(-np.percentile(p, 5), abs=1e-12)
        assert r["Scenario ES 97.5"] == pytest.approx(-np.sort(p)[:k].mean(), abs=1e-12)
        assert r["Scenario PnL vol"] == pytest.approx(p.std(ddof=1), abs=1e-12)
        assert r["Model vol"] == pytest.approx(np.sqrt(p.var(ddof=1) + s), abs=1e-12)
        assert r["Total VaR 99"] == pytest.approx(np.sqrt(np.percentile(p, 1) ** 2 + 2.326**2 * s), abs=1e-12)
        assert r["Scenario worst loss"] == pytest.approx(-p.min(), abs=1e-15)
        assert r["Exceedance rate 2s"] == pytest.approx((np.abs(p) > 2 * p.std(ddof=1)).mean())
        assert r["Scenario n"] == len(p)


def test_marginals_sum_to_totals(toy):
    f, n = toy
    flt = {"Date": [n["date"]], **HF}
    by = pivot(f, ["Book", "Position"], ["Marginal Model vol", "Marginal Scenario VaR 99", "% of Scenario VaR 99", "% of Total VaR 99",
                                         "% of Scenario ES 97.5", "% of Model vol", "Factor variance contribution"], filters=flt)
    s = {r["Book"]: r for r in by.groupBy("Book").agg(*[F.sum(f"`{c}`").alias(c) for c in by.columns[2:]]).collect()}
    tot = {r["Book"]: r for r in pivot(f, ["Book"], ["Model vol", "Scenario PnL vol"], filters=flt).collect()}
    for b in "AB":
        assert s[b]["Marginal Model vol"] == pytest.approx(tot[b]["Model vol"], abs=1e-12)
        assert s[b]["Factor variance contribution"] == pytest.approx(tot[b]["Scenario PnL vol"] ** 2, abs=1e-12)
        for c in ("% of Scenario VaR 99", "% of Total VaR 99", "% of Scenario ES 97.5", "% of Model vol"):
            assert s[b][c] == pytest.approx(1.0, abs=1e-12)
        p = np.sort(n["F"] @ (n["L"].T @ n["w"][b]))
        assert s[b]["Marginal Scenario VaR 99"] == pytest.approx(-p[int(np.floor(0.01 * (len(p) - 1)))], abs=1e-12)


def test_vol_paths_agree(toy):
    """Volatility from the factor covariance equals the one from day vectors."""
    f, n = toy
    flt = {"Date": [n["date"]], **HF}
    a = {(r[0], r[1]): r[2] for r in pivot(f, ["Book", "Sector"], ["Scenario PnL vol"], filters=flt).collect()}
    b = {(r[0], r[1]): r[2] for r in pivot(f, ["Book", "Sector"], ["Scenario PnL vol", "Scenario n"], filters=flt).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_incremental_and_hedge(toy):
    f, n = toy
    flt = {"Date": [n["date"]], **HF}
    rows = pivot(f, ["Book", "Factor"], ["Vol ex factor", "Min-variance hedge ratio", "Vol at min-variance hedge", "Incremental Scenario VaR 99"], filters=flt).collect()
    for r in rows:
        w = n["w"][r["Book"]]
        x = n["L"].T @ w
        j = ("Market", "Value").index(r["Factor"])
        p, s = n["F"] @ x, float(w**2 @ n["sv"])
        ex = p - n["F"][:, j] * x[j]
        c = np.cov(n["F"], rowvar=False)
        h = -(c @ x)[j] / c[j, j]
        i = int(np.floor(0.01 * (len(p) - 1)))
        assert r["Vol ex factor"] == pytest.approx(np.sqrt(ex.var(ddof=1) + s), abs=1e-12)
        assert r["Min-variance hedge ratio"] == pytest.approx(h, abs=1e-9)
        assert r["Vol at min-variance hedge"] == pytest.approx(np.sqrt((p + h * n["F"][:, j]).var(ddof=1) + s), abs=1e-10)
        assert r["Incremental Scenario VaR 99"] == pytest.approx(np.sort(ex)[i] - np.sort(p)[i], abs=1e-12)


def test_hypothetical_set_has_no_vol(toy):
    f, n = toy
    r = pivot(f, ["Book"], ["Scenario PnL vol", "Scenario mean PnL", "Scenario n"], filters={"Date": [n["date"]], "ScenarioSet": ["Hypo:V"]}).collect()
    for x in r:
        e = n["L"][:, 1] @ n["w"][x["Book"]] * 2 * n["F"][:, 1].std(ddof=1)
        assert x["Scenario PnL vol"] is None and x["Scenario n"] == 1
        assert x["Scenario mean PnL"] == pytest.approx(e, abs=1e-12)


def test_stress_defaults_to_model_vol_and_unit_market(toy):
    f, n = toy
    r = pivot(f, ["Book"], ["Stressed model vol", "Model vol", "Net weight"], filters={"Date": [n["date"]], **HF}).collect()
    assert all(x["Stressed model vol"] == pytest.approx(x["Model vol"], abs=1e-12) for x in r)
    m = pivot(f, ["Book", "Factor"], ["Net exposure"], filters={"Date": [n["date"]], "Factor": ["Market"]}).collect()
    assert all(x["Net exposure"] == pytest.approx(1.0) for x in m)


def test_margins_recomputed(toy):
    f, n = toy
    r = pivot(f, ["Book", "Sector"], ["Scenario VaR 99"], filters={"Date": [n["date"]], **HF}, totals=True).collect()
    g = {x["Book"]: x["Scenario VaR 99"] for x in r if x["Margin"] != "cell"}
    for b in "AB":
        assert g[b] == pytest.approx(-np.percentile(n["F"] @ (n["L"].T @ n["w"][b]), 1), abs=1e-12)


def test_whatif_branches(spark, toy):
    f, n = toy
    t = spark.createDataFrame([("X", n["date"], "A", "P1", 0.0), ("X", n["date"], "A", "P2", 0.5)], "Branch string, Date date, Book string, Position string, Weight double")
    r = {(x["Branch"], x["Book"]): x["Net weight"] for x in pivot(f, ["Book"], ["Net weight"], filters={"Date": [n["date"]]}, trades=t).collect()}
    w = n["w"]["A"].copy()
    w[0], w[1] = 0.0, 0.5
    assert r[("X", "A")] == pytest.approx(w.sum()) and r[("Base", "A")] == pytest.approx(1.0) and ("X", "B") not in r


def test_guards(toy):
    f, n = toy
    with pytest.raises(PivotError, match="unknown dimension"):
        pivot(f, ["Nope"], ["Net exposure"])
    with pytest.raises(PivotError, match="unknown measure"):
        pivot(f, ["Book"], ["Nope"], filters={"Date": [n["date"]]})
    with pytest.raises(PivotError, match="Book must"):
        pivot(f, ["Sector"], ["Net exposure"], filters={"Date": [n["date"]]})
    with pytest.raises(PivotError, match="at least one row"):
        pivot(f, [], ["Net exposure"])
    with pytest.warns(UserWarning, match="one ScenarioSet"):
        r = pivot(f, ["Book"], ["Scenario VaR 99", "Net exposure"], filters={"Date": [n["date"]]}).collect()
    assert all(x["Scenario VaR 99"] is None and x["Net exposure"] is not None for x in r)


def test_register_measure(toy):
    f, n = toy
    register_measure("Twice", lambda: F.col("x") * 2)
    try:
        r = pivot(f, ["Book"], ["Twice", "Net exposure"], filters={"Date": [n["date"]]}).collect()
        assert all(x["Twice"] == 2 * x["Net exposure"] for x in r)
    finally:
        del MEASURES["Twice"]


def test_conditional_shock(spark):
    from riskloom.operators.desk import conditional_shocks

    cov = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 4.0)], "Factor string, Factor2 string, cov double")
    sh = spark.createDataFrame([("s", "a", -1.0)], "ShockId string, Factor string, sigma double")
    r = {x["Factor"]: x["implied_return"] for x in conditional_shocks(cov, sh).collect()}
    assert r["a"] == pytest.approx(-1.0) and r["b"] == pytest.approx(-0.5)


def test_unknown_trades_and_shocks_are_refused(spark):
    import datetime as dt

    from riskloom.plans.pivot import PivotError, pivot
    from toys import risk_frames

    f, _ = risk_frames(spark)
    day, book, name = f["positions"].select("Date", "Book", "Position").first()
    row = "Branch string, Date date, Book string, Position string, Weight double"
    for bad in (("w", day, book, "NOBODY", 0.5), ("w", day, "NOBOOK", name, 0.5), ("w", dt.date(1990, 1, 1), book, name, 0.5)):
        with pytest.raises(PivotError):
            pivot(f, ["Book"], ["Net weight"], filters={"Date": [day]}, trades=spark.createDataFrame([bad], row))
    with pytest.raises(PivotError):
        pivot(f, ["Book"], ["Custom stress PnL"], filters={"Date": [day], "ScenarioSet": ["HistFull"]}, shocks={"Nothing": -1.0})
    both = pivot(f, ["Book"], ["Net weight", "Custom stress PnL"], filters={"Date": [day], "ScenarioSet": ["HistFull"]}, shocks={"Market": -1.0},
                 trades=spark.createDataFrame([("w", day, book, name, 0.5)], row))
    assert {r.Branch for r in both.collect()} == {"Base", "w"}
