import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom import schema
from riskloom.operators import descriptors as de, desk, quality as qa, regression as rg, universe as un
from riskloom.plans import build
from riskloom.sources import landed

D = dt.date


@pytest.fixture(scope="module")
def market(spark):
    """80 names, 3 styles, 4 sectors (one Unknown), two months; returns by day with gaps."""
    rng = np.random.default_rng(7)
    n, styles, sect = 80, ["Beta", "Size", "Value"], ["Energy", "Tech", "Util", "Unknown"]
    ends = [D(2024, 1, 31), D(2024, 2, 29)]
    days = [D(2024, 2, 6), D(2024, 2, 20), D(2024, 3, 5)]
    L = {e: rng.normal(size=(n, 3)) for e in ends}
    sec = [sect[i % 4] for i in range(n)]
    est = np.arange(n) < 60
    ret = {d: np.where(rng.uniform(size=n) < 0.1, np.nan, rng.normal(0, 0.02, n)) for d in days}
    P = [f"N{i:02d}" for i in range(n)]
    expo = spark.createDataFrame([(e, p, s, float(L[e][i, j])) for e in ends for i, p in enumerate(P) for j, s in enumerate(styles)], schema.SCHEMAS["exposures"])
    secs = spark.createDataFrame([(p, p, i, None, p, sec[i], "US") for i, p in enumerate(P)], schema.SCHEMAS["securities"])
    rets = spark.createDataFrame([(p, d, float(v[i])) for d, v in ret.items() for i, p in enumerate(P) if not np.isnan(v[i])], "Position string, Date date, ret double")
    estd = spark.createDataFrame([(p,) for i, p in enumerate(P) if est[i]], "Position string")
    return dict(P=P, L=L, sec=sec, est=est, ret=ret, ends=ends, days=days, styles=styles, expo=expo, secs=secs, rets=rets, estd=estd)


def numpy_design(m, e):
    sec, est = np.array(m["sec"]), m["est"]
    X = np.column_stack([np.ones(len(sec)), m["L"][e]])
    w2 = np.exp(m["L"][e][:, 1] / 2)
    names = sorted({s for s in sec[est] if s != "Unknown"})
    c = np.array([w2[est & (sec == s)].sum() for s in names])
    r = int(np.argmax(c))
    other = [j for j in range(len(names)) if j != r]
    Dm = np.column_stack([(sec == names[j]) * 1.0 - (c[j] / c[r]) * (sec == names[r]) for j in other])
    return np.hstack([X, Dm]), w2, ["Market", *m["styles"], *[f"Ind:{names[j]}" for j in other]], names[r], c[other] / c[r]


def test_wls_matches_numpy(spark, market):
    m = market
    got = rg.regress_factors(rg.designs(m["expo"], m["secs"], m["estd"]), m["rets"]).toPandas()
    for d in m["days"]:
        e = m["ends"][0] if d.month == 2 else m["ends"][1]
        X, w2, names, ref, ratio = numpy_design(m, e)
        y = m["ret"][d]
        ok = m["est"] & ~np.isnan(y)
        W = np.sqrt(w2[ok])[:, None]
        beta, *_ = np.linalg.lstsq(X[ok] * W, y[ok] * W[:, 0], rcond=None)
        g = got[got.Date == d].set_index("Factor")
        assert set(g.index) == {*names, f"Ind:{ref}"}
        assert np.allclose(g.loc[names, "Return"], beta, atol=1e-12)
        assert g.loc[f"Ind:{ref}", "Return"] == pytest.approx(-float(ratio @ beta[4:]), abs=1e-12)
        res = y[ok] - X[ok] @ beta
        wt = w2[ok]
        ssr, yb = float(wt @ res**2), float(wt @ y[ok] / wt.sum())
        assert g.R2.iloc[0] == pytest.approx(1 - ssr / float(wt @ (y[ok] - yb) ** 2), abs=1e-10)
        se = np.sqrt(np.diag(np.linalg.inv((X[ok] * wt[:, None]).T @ X[ok])) * ssr / (ok.sum() - X.shape[1]))
        assert np.allclose(g.loc[names, "TStat"].astype(float), beta / se, rtol=1e-8)
        assert g.N.iloc[0] == ok.sum()


def test_factor_portfolio_is_pure(market):
    m = market
    p = rg.portfolio_purity(rg.factor_portfolios(rg.designs(m["expo"], m["secs"], m["estd"]))).toPandas()
    assert np.allclose(p.self_exposure, 1.0) and p.max_cross_exposure.max() < 1e-9
    X, w2, names, *_ = numpy_design(m, m["ends"][0])
    e = m["est"]
    P = np.linalg.solve((X[e] * w2[e, None]).T @ X[e], (X[e] * w2[e, None]).T)
    g = p[p.d0 == m["ends"][0]].set_index("Factor")
    assert np.allclose(g.loc[names, "gross_leverage"], np.abs(P).sum(axis=1))


def test_span_matches_numpy(spark, market):
    m = market
    cloud = m["expo"].select("Date", "Position").distinct()
    held = spark.createDataFrame([("B", m["ends"][0], p, 1 / 80) for p in m["P"]], "Book string, Date date, Position string, Weight double")
    got = un.span(m["expo"], m["styles"], cloud, held).toPandas().set_index("Position").loc[m["P"]]
    E = m["L"][m["ends"][0]]
    x = E - E.mean(axis=0)
    d2 = np.einsum("ij,jk,ik->i", x, np.linalg.pinv(np.cov(E, rowvar=False)), x)
    assert np.allclose(got.d2, d2) and got.edge.iloc[0] == pytest.approx(np.quantile(d2, 0.99))
    lo, hi = np.quantile(E, 0.01, axis=0), np.quantile(E, 0.99, axis=0)
    assert (got.n_extreme.to_numpy() == ((E < lo) | (E > hi)).sum(axis=1)).all()


def test_split_z_matches_pandas(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_t(2, 60) * 5
    est = np.arange(60) < 40
    df = spark.createDataFrame([(D(2024, 1, 31), f"n{i}", float(x), bool(est[i])) for i, x in enumerate(v)], "Date date, Position string, v double, ref boolean")
    got = de.split_z(df, ["Date"], "v", "ref").toPandas().sort_values("Position", key=lambda s: s.str[1:].astype(int)).z.to_numpy()
    med = np.median(v[est])
    z = (v - med) / (1.4826 * np.median(np.abs(v[est] - med)))
    c = np.clip(z, -3, 3)
    out = np.where(est, c, np.clip(z, -10, 10))
    assert np.allclose(got, (out - c[est].mean()) / c[est].std(ddof=1))


def test_rolling_factor_betas(spark):
    rng = np.random.default_rng(9)
    n = 200
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    f, y = rng.normal(0, 0.01, n), None
    y = 1.4 * f + rng.normal(0, 0.002, n)
    fac = spark.createDataFrame([(d, float(v)) for d, v in zip(days, f)], "Date date, Market double")
    ret = spark.createDataFrame([("P", d, float(v)) for d, v in zip(days, y)], "Position string, Date date, ret double")
    r = rg.rolling_factor_betas(ret, fac, ["Market"], [days[100], days[150]]).collect()
    assert len(r) == 1
    b = np.polyfit(f[:151], y[:151], 1)[0]
    assert r[0].Loading == pytest.approx(0.75 * b + 0.25, rel=1e-9)


def test_residual_regression(spark):
    rng = np.random.default_rng(11)
    n = 120
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    X = rng.normal(size=(n, 2))
    u = 0.5 * X[:, 0] + rng.normal(0, 0.1, n)
    fac = spark.createDataFrame([(d, float(a), float(b)) for d, (a, b) in zip(days, X)], "Date date, a double, b double")
    r = {x.Factor: x for x in rg.residual_regression(spark.createDataFrame([("B", d, float(v)) for d, v in zip(days, u)], "Book string, Date date, u double"), fac, ["a", "b"]).collect()}
    assert r["a"].beta == pytest.approx(0.5, abs=0.05) and abs(r["a"].t_stat) > 20 > abs(r["b"].t_stat)
    Z = np.column_stack([np.ones(n), X])
    e = u - Z @ np.linalg.lstsq(Z, u, rcond=None)[0]
    assert r["a"].r2 == pytest.approx(1 - e @ e / ((u - u.mean()) ** 2).sum())


def test_audit_finds_planted_beta(spark):
    rng = np.random.default_rng(13)
    n = 300
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    f = rng.normal(0, 0.01, n)
    panel = spark.createDataFrame([(d, "X", float(v)) for d, v in zip(days, f)], "Date date, Factor string, Return double")
    sr = spark.createDataFrame([(d, p, float(b * v + e)) for p, b in (("hit", 1.5), ("noise", 0.0)) for d, v, e in zip(days, f, rng.normal(0, 0.01, n))], "Date date, Position string, SpecificReturn double")
    held = spark.createDataFrame([("B", "hit", 0.5), ("B", "noise", 0.5)], "Book string, Position string, Weight double")
    r = {x.Position: x for x in qa.hidden_betas(sr, panel, held).collect()}
    assert r["hit"].beta == pytest.approx(1.5, abs=0.2) and abs(r["hit"].t) > 2


def test_names_tickers_and_filters(spark):
    d = spark.createDataFrame([("Hologic, Inc.",), ("Sealed Air Corp New",), ("LINDE PLC",)], "s string")
    assert [r[0] for r in d.select(un.norm_name(F.col("s"))).collect()] == ["HOLOGIC", "SEALED AIR", "LINDE"]
    t = spark.createDataFrame([("BRK.B",), ("brk b ",), (None,)], "s string")
    assert [r[0] for r in t.select(un.canon_ticker(F.col("s"))).collect()] == ["BRK-B", "BRK-B", ""]
    names = ["NETFLIX INC", "MEDICAL PROPERTIES TRUST INC", "INVESCO LTD", "ISHARES TR", "INVESCO QQQ TRUST"]
    p = spark.createDataFrame([(n,) for n in names], "s string").select(un.is_pooled(F.col("s"))).collect()
    assert [r[0] for r in p] == [False, False, False, True, True]


def test_pit_membership(spark):
    log = spark.createDataFrame([(D(2020, 1, 1), "AAA,BBB"), (D(2020, 6, 1), "AAA,CCC")], "date date, tickers string")
    q = [("AAA", D(2020, 3, 1), True), ("BBB", D(2020, 9, 1), False), ("CCC", D(2020, 9, 1), True), ("CCC", D(2019, 12, 1), False), ("BBB", D(2020, 1, 1), True)]
    rows = spark.createDataFrame([(t, d) for t, d, _ in q], "t string, d date")
    got = {(r.t, r.d): r.m for r in un.member_asof(rows, landed.change_log(log), "d", "t", "m").collect()}
    assert got == {(t, d): v for t, d, v in q}


def test_funnel_stages(spark):
    ok = ("Common", 5e9, 600, 0.99, 5e7, 9)
    cases = [(ok, None), (("ETF", *ok[1:]), "listing"), ((ok[0], 9e7, *ok[2:]), "size"), ((ok[0], 1e8, *ok[2:]), None), ((*ok[:2], 251, *ok[3:]), "history"),
             ((*ok[:2], 252, *ok[3:]), None), ((*ok[:3], 0.89, *ok[4:]), "trading frequency"), ((*ok[:4], 9e5, ok[5]), "liquidity"), ((*ok[:5], 5), "completeness"),
             ((ok[0], None, *ok[2:]), "data unavailable"), ((*ok[:2], 0, *ok[3:]), "data unavailable")]
    d = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, sec_type string, mcap double, hist_days int, trade_freq double, adv double, n_descriptors int")
    assert [r.s for r in d.select("i", un.first_failing_stage().alias("s")).orderBy("i").collect()] == [s for _, s in cases]


def test_liquidity_and_drift(spark):
    p = spark.createDataFrame([(D(2024, 1, 31), "B", x, 0.25, mv, adv) for x, mv, adv in (("a", 10e6, 5e6), ("b", 10e6, 1e6), ("c", 5e6, 0.0), ("d", 1e6, None))], schema.SCHEMAS["positions"])
    r = desk.liquidity(p).collect()[0]
    assert r.max_days == 50 and r.n_no_adv == 2 and r.weighted_avg_days == 30
    pos = spark.createDataFrame([(D(2024, 1, 31), "B", "A", 0.5, 1.0, None), (D(2024, 1, 31), "B", "B", 0.5, 1.0, None), (D(2024, 2, 29), "B", "A", 0.7, 1.0, None), (D(2024, 2, 29), "B", "C", 0.3, 1.0, None)], schema.SCHEMAS["positions"])
    e = spark.createDataFrame([(D(2024, 1, 31), "A", "f", 2.0), (D(2024, 1, 31), "B", "f", 0.0), (D(2024, 2, 29), "A", "f", 1.0), (D(2024, 2, 29), "C", "f", -3.0)], schema.SCHEMAS["exposures"])
    x = un.drift_attribution(pos, e, "2024-01-31", "2024-02-29").collect()[0]
    assert x.entered == pytest.approx(-0.9) and x.loading_drift == pytest.approx(-0.7)
    assert x.delta == pytest.approx((0.7 - 0.9) - 1.0)


def test_filings_asof(spark):
    h = spark.createDataFrame([("A", D(2016, 2, 1), "X", 60.0), ("A", D(2016, 2, 1), "Y", 40.0), ("A", D(2016, 5, 1), "X", 100.0), ("B", D(2016, 4, 1), "Z", 30.0), ("B", D(2016, 4, 1), "X", 70.0)], "Book string, filing_date date, Position string, MV double")
    p = build.positions_on_calendar(build.filing_weights(h), F.lit(D(2016, 6, 30))).toPandas()
    assert np.allclose(p.groupby(["Book", "Date"]).Weight.sum(), 1.0)
    a = p[p.Book == "A"]
    assert a.Date.min() == D(2016, 2, 29) and a[(a.Date == D(2016, 3, 31)) & (a.Position == "X")].Weight.iloc[0] == 0.6
    assert "Y" not in set(a[a.Date >= D(2016, 5, 31)].Position) and p[p.Book == "B"].Date.min() == D(2016, 4, 30)


def test_crosswalk_never_loses_a_resolution(spark):
    s = "cusip string, figi string, ticker string, name string"
    old = spark.createDataFrame([("1", "F1", "a", "A"), ("2", None, None, None)], s)
    new = spark.createDataFrame([("1", None, None, None), ("2", "F2", "b", "B"), ("3", None, None, None)], s)
    r = {x.cusip: x.figi for x in landed.upsert_crosswalk(old, new).collect()}
    assert r == {"1": "F1", "2": "F2", "3": None}


def test_landed_documents(spark, tmp_path):
    xml = ('<n1:informationTable xmlns:n1="http://x"><n1:infoTable><n1:nameOfIssuer>ACME</n1:nameOfIssuer><n1:cusip> ab1 </n1:cusip><n1:value>5</n1:value>'
           '<n1:shrsOrPrnAmt><n1:sshPrnamt>7</n1:sshPrnamt><n1:sshPrnamtType>SH</n1:sshPrnamtType></n1:shrsOrPrnAmt></n1:infoTable>'
           '<n1:infoTable><n1:nameOfIssuer>OPT</n1:nameOfIssuer><n1:cusip>x</n1:cusip><n1:putCall>Put</n1:putCall></n1:infoTable></n1:informationTable>')
    (tmp_path / "acc1.xml").write_text(xml)
    r = landed.information_table(spark, str(tmp_path / "acc1.xml")).collect()
    assert [(x.accession, x.issuer, x.cusip, x.value, x.shares) for x in r] == [("acc1", "ACME", "AB1", 5.0, 7.0)]
    col = {"form": ["13F-HR", "10-K"], "accessionNumber": ["a", "b"], "filingDate": ["2020-02-14"] * 2, "reportDate": ["2019-12-31"] * 2, "primaryDocument": ["p"] * 2}
    (tmp_path / "sub.json").write_text(json.dumps({"cik": "1", "filings": {"recent": col}}, indent=1))
    (tmp_path / "page.json").write_text(json.dumps({"cik": "1", **{k: ["13F-HR" if k == "form" else "c", v[1]] if k != "form" else ["13F-HR", "13F-HR"] for k, v in col.items()}}, indent=1))
    got = landed.filing_index(spark, str(tmp_path / "sub.json"), str(tmp_path / "page.json")).collect()
    assert sorted(x.accessionNumber for x in got) == ["a", "b", "c"]
    facts = {"cik": 9, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"filed": "2020-02-01", "end": "2019-12-31", "val": 10}]}},
                                             "StockholdersEquity": {"units": {"USD": [{"filed": "2020-03-01", "end": "2019-12-31", "val": 4}]}}},
                                 "dei": {landed.COVER_SHARES: {"units": {"shares": [{"filed": "2020-01-01", "end": "2019-12-31", "val": 100}]}}}}}
    (tmp_path / "facts.json").write_text(json.dumps(facts, indent=1))
    f = landed.stitch_fundamentals(landed.company_facts(spark, str(tmp_path / "facts.json")), ["cik"]).collect()
    assert [(x.Equity, x.Assets, x.Shares, x.Liabilities) for x in f] == [(4.0, 10.0, 100.0, None)]
    (tmp_path / "px").mkdir()
    (tmp_path / "px" / "aaa.csv").write_text("Date,Close,Volume\n2020-01-02,10,100\n2020-01-03,,5\n")
    (tmp_path / "px" / "bad.csv").write_text("<html><body>no data</body></html>\n")
    p = landed.price_csv(spark, str(tmp_path / "px" / "*.csv")).collect()
    assert [(x.symbol, x.Close) for x in p] == [("aaa", 10.0)]


def test_limits_rag(spark):
    m = spark.createDataFrame([("A", "m", 0.5, None), ("B", "m", 0.5, None)], "Book string, metric string, value double, detail string")
    lim = spark.createDataFrame([("*", "m", 0.4, 0.6), ("B", "m", 0.1, 0.2)], "Book string, metric string, warn double, limit double")
    r = {x.Book: x for x in desk.check_limits(m, lim, "B").collect()}
    assert r["A"].status == "amber" and r["A"].cross_book and r["B"].status == "breach" and r["B"].headroom == pytest.approx(-0.3)
