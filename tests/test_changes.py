"""Two states of a book against numpy: what-if trades and what changed since the previous filing."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.frames import Frames
from riskloom.operators import changes

D = [dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31)]
FACTORS = ["Market", "Size", "Value"]


@pytest.fixture(scope="module")
def model(spark):
    """Three months, two books; N5 has no loadings; book B holds the same names in the first two months."""
    r = np.random.default_rng(7)
    names = [f"N{i}" for i in range(6)]
    load = {(d, p): r.normal(size=3) for d in D for p in names if p != "N5"}
    w = {(D[0], "A"): {"N0": .5, "N1": .3, "N5": .2}, (D[1], "A"): {"N0": .4, "N2": .596, "N1": .004}, (D[2], "A"): {"N2": .6, "N3": .4},
         (D[0], "B"): {"N3": 1.0}, (D[1], "B"): {"N3": 1.0}, (D[2], "B"): {"N3": .7, "N4": .3}}
    sv = {k: abs(r.normal()) * 1e-4 for k in load if k[1] != "N4"}
    rets = r.normal(0, 0.01, (150, 3))
    days = [dt.date(2019, 1, 1) + dt.timedelta(i) for i in range(150)]
    mk = spark.createDataFrame
    f = Frames(spark, {
        "exposures": mk([(d, p, f, float(v)) for (d, p), x in load.items() for f, v in zip(FACTORS, x)], "Date date, Position string, Factor string, Loading double"),
        "positions": mk([(d, b, p, float(x), 1.0, None) for (d, b), h in w.items() for p, x in h.items()], "Date date, Book string, Position string, Weight double, MV double, ADV double"),
        "securities": mk([(p, p.lower(), f"Issuer {p}") for p in names], "Position string, Ticker string, Issuer string"),
        "factor_meta": mk([(f, "Style") for f in FACTORS], "Factor string, FactorGroup string"),
        "specific_var": mk([(d, p, float(v)) for (d, p), v in sv.items()], "Date date, Position string, SpecificVar double"),
        "scenarios": mk([(s, i, days[i], f, float(k * rets[i, j])) for s, k in (("HistFull", 1), ("Other", 2)) for i in range(150) for j, f in enumerate(FACTORS)],
                        "ScenarioSet string, day_idx int, scen_date date, Factor string, shock double")})
    return f, load, w, sv, rets


def risk(weights, d, load, sv, rets, read_off):
    names = [p for p in weights if (d, p) in load]
    w, L = np.array([weights[p] for p in names]), np.array([load[d, p] for p in names])
    s = np.array([sv.get((d, p), 0.0) for p in names])
    pnl = rets @ (L.T @ w)
    n, spec = len(pnl), float(w * w @ s)
    order = np.argsort(pnl)
    tail = order[int(0.01 * (n - 1))]
    var99 = -np.quantile(pnl, 0.01)
    es = lambda a: -np.mean(pnl[order][:int(np.ceil(a * n))])
    m = -(w * (L @ rets[tail])) * (-pnl[tail] if read_off else var99) + 2.326**2 * w * w * s
    return {"model_vol_1d": np.sqrt(pnl.var(ddof=1) + spec), "scenario_var_99": var99, "scenario_var_975": -np.quantile(pnl, 0.025), "es_975": es(0.025),
            "es_99": es(0.01), "specific_vol": np.sqrt(spec), "total_var_99": np.sqrt(var99**2 + 2.326**2 * spec),
            "top5_ctr_share": np.sort(m)[::-1][:5].sum() / m.sum(), "gross": np.abs(w).sum(), "net": w.sum()}


def test_whatif_risk_of_all_branches(spark, model):
    f, load, w, sv, rets = model
    trades = spark.createDataFrame([("cut", D[0], "A", "N0", 0.1), ("cut", D[0], "A", "N3", -0.2), ("drop", D[0], "A", "N1", 0.0), ("drop", D[2], "B", "N4", 0.1)],
                                   "Branch string, Date date, Book string, Position string, Weight double")
    out = changes.whatif(f, trades)
    got = {(r.Branch, r.Date, r.Book, r.metric): (r.before, r.after, r.delta) for r in out["risk"].collect()}
    assert len(got) == 3 * len(changes.RISK)
    for branch, d, b, new in (("cut", D[0], "A", {"N0": .1, "N1": .3, "N5": .2, "N3": -.2}), ("drop", D[0], "A", {"N0": .5, "N5": .2}), ("drop", D[2], "B", {"N3": .7, "N4": .1})):
        x0, x1 = risk(w[d, b], d, load, sv, rets, False), risk(new, d, load, sv, rets, False)
        for k in changes.RISK:
            assert got[branch, d, b, k] == pytest.approx((x0[k], x1[k], x1[k] - x0[k]), abs=1e-10), (branch, k)
    names = {(r.Branch, r.Book, r.Position): (r.old, r.new, r.change, r.priced) for r in out["holdings"].collect()}
    assert names["cut", "A", "N0"] == (.5, .1, "resized", True) and names["cut", "A", "N3"] == (0.0, -.2, "added", True)
    assert names["drop", "A", "N1"] == (.3, 0.0, "dropped", True) and names["cut", "A", "N5"] == (.2, .2, "held", False) and len(names) == 4 + 3 + 2
    assert [(r.Book, r.Position, r.Ticker, r.Weight) for r in out["unpriced"].collect()] == [("A", "N5", "n5", .2)]


def test_trades_that_cannot_be_priced(spark, model):
    kind = "Branch string, Date date, Book string, Position string, Weight double"
    for row, why in ((("x", D[0], "A", "N5", 0.1), "universe"), (("x", D[0], "A", "nobody", 0.1), "universe"), (("x", D[0], "C", "N0", 0.1), "no book")):
        with pytest.raises(changes.TradeError, match=why):
            changes.whatif(model[0], spark.createDataFrame([row], kind))


def test_what_changed(model):
    f, load, w, sv, rets = model
    rows = changes.what_changed(f).collect()
    # B holds the same names in the first two months: no names changed, loadings and risk did
    pairs = (("A", D[1], D[0]), ("A", D[2], D[1]), ("B", D[1], D[0]), ("B", D[2], D[1]))
    assert {(r.Book, r.Date, r.previous) for r in rows} == set(pairs) and not [r for r in rows if (r.Book, r.Date, r.part) == ("B", D[1], "position")]
    names = {(r.Book, r.Date, r.item): (r.change, r.before, r.after, r.label) for r in rows if r.part == "position"}
    assert names["A", D[1], "N5"] == ("exited", .2, None, "Issuer N5") and names["A", D[1], "N2"] == ("entered", None, .596, "Issuer N2")
    assert names["A", D[1], "N1"][0] == "resized" and ("A", D[2], "N2") not in names and names["A", D[2], "N1"][0] == "exited"
    for book, d, p in pairs:
        x0, x1 = risk(w[p, book], p, load, sv, rets, True), risk(w[d, book], d, load, sv, rets, True)
        got = {r.item: r for r in rows if (r.Book, r.Date, r.part) == (book, d, "risk")}
        assert set(got) == set(changes.RISK)
        for k, r in got.items():
            assert (r.before, r.after, r.delta) == pytest.approx((x0[k], x1[k], x1[k] - x0[k]), abs=1e-10), k
        zero = np.zeros(3)
        a, b = w[p, book], w[d, book]
        l0, l1 = (lambda q: load.get((p, q), zero)), (lambda q: load.get((d, q), zero))
        want = {"entered": sum((b[q] * l1(q) for q in set(b) - set(a)), zero), "exited": -sum((a[q] * l0(q) for q in set(a) - set(b)), zero),
                "reweighted": sum(((b[q] - a[q]) * l0(q) for q in set(a) & set(b)), zero), "loading_drift": sum((b[q] * (l1(q) - l0(q)) for q in set(a) & set(b)), zero)}
        for i, k in enumerate(FACTORS):
            r = next(r for r in rows if (r.Book, r.Date, r.part, r.item) == (book, d, "factor", k))
            assert [r[s] for s in changes.SOURCES] == pytest.approx([want[s][i] for s in changes.SOURCES], abs=1e-12)
            assert r.delta == pytest.approx(sum(b[q] * l1(q)[i] for q in b) - sum(a[q] * l0(q)[i] for q in a), abs=1e-12)
            assert r.after - r.before == pytest.approx(r.delta, abs=1e-12)


def test_chosen_pair_and_scans(spark, model):
    f = model[0]
    pair = spark.createDataFrame([("A", D[2], D[0])], "Book string, Date date, previous date")
    rows = changes.what_changed(f, pair).collect()
    assert {(r.Book, r.Date, r.previous) for r in rows} == {("A", D[2], D[0])}
    assert {r.item for r in rows if r.change == "entered"} == {"N2", "N3"} and {r.item for r in rows if r.change == "exited"} == {"N0", "N1", "N5"}
    h = changes.loaded(f.positions.withColumn("Branch", F.lit("Base")), f.exposures, f.specific_var)
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Loading#") >= 1 and h.count() == f.positions.count()


def test_whatif_writes_the_base_and_the_traded_names_alone(spark, model, monkeypatch):
    f, _, w, _, _ = model
    written, real = [], changes.staged
    monkeypatch.setattr(changes, "staged", lambda df, *a: written.append(real(df, *a)) or written[-1])
    # one name halved, one dropped, one bought, one left as it is by a trade without a weight
    trades = spark.createDataFrame([("a", D[0], "A", "N0", .25), ("b", D[0], "A", "N0", 0.0), ("c", D[0], "A", "N3", .1), ("d", D[0], "A", "N1", None)],
                                   "Branch string, Date date, Book string, Position string, Weight double")
    out = changes.whatif(f, trades)
    net = {r.Branch: r.after for r in out["risk"].filter("metric = 'net'").collect()}  # N5 has no loadings
    assert net == pytest.approx({"a": .55, "b": .3, "c": .9, "d": .8})
    assert [d.count() for d in written if "loads" in d.columns] == [len(w[D[0], "A"]) + 3]
    held = {(r.Branch, r.Position): (r.old, r.new, r.change) for r in out["holdings"].collect()}
    assert len(held) == 4 * 3 + 1 and held["d", "N1"] == (.3, .3, "held") and held["c", "N3"] == (0.0, .1, "added") and held["b", "N0"] == (.5, 0.0, "dropped")
