"""Scenario measures, decomposition and pivot presets (additive, vector and query-surface rows)."""

from __future__ import annotations

import datetime as dt

from riskloom.catalog.oracle import sql
from riskloom.catalog.registry import query, tidy_sql
from riskloom.operators import measures as ms, scenarios as sc
from riskloom.plans.pivot import pivot
from riskloom.sources import tables

ASOF = dt.date(2000, 6, 30)
AS = "DATE '2000-06-30'"
HF = {"ScenarioSet": ["HistFull"]}


def cells(dims: str = "", date: bool = False, sets: str = "'HistFull'") -> dict:
    """SQL twins of the pivot blocks for cells (date, book, dims). ``dims`` lists sec/factor columns."""
    d = [x for x in dims.split() if x]
    fac = [x for x in d if x in ("factor", "factorgroup")]
    sd = [x for x in d if x not in fac]
    pos_w = f"WHERE p.date = {AS}" if date else ""
    scn_w = f"WHERE scenarioset IN ({sets})" if sets else ""
    cell = ", ".join(["date", "book", *d])
    key = ", ".join(["date", "book", "scenarioset"])
    secq = "".join(f", s.{x}" for x in sd if x != "position") + (", p.position" if "position" in sd else "")
    facq = "".join(f", {'e.factor AS cfac' if x == 'factor' else 'f.factorgroup'}" for x in fac)
    cellx = ", ".join(["date", "book", *["cfac" if x == "factor" else x for x in d]])
    out_fac = ", ".join(["date", "book", *["cfac AS factor" if x == "factor" else x for x in d]])
    j = "JOIN sec s ON s.position = p.position JOIN fm f ON f.factor = e.factor"
    x0 = f"""SELECT p.date, p.book{secq}{facq}, e.factor AS k, sum(p.weight * e.loading) AS x, count(*) AS n
        FROM pos p JOIN expo e ON p.date = e.date AND p.position = e.position {j} {pos_w} GROUP BY ALL"""
    sj = "".join(f" AND a.{x} = b.{x}" for x in d)
    ex = {
        "scs": (("scn",), f"SELECT * FROM scn {scn_w}"),
        "xc0": (("pos", "expo", "sec", "fm"), x0),
        "xc": (("xc0",), f"SELECT {out_fac}, k, x, n FROM xc0"),
        "cx": (("xc",), f"SELECT {cell}, sum(x) AS x, CAST(sum(n) AS BIGINT) AS n FROM xc GROUP BY {cell}"),
        "bx": (("xc",), "SELECT date, book, k, sum(x) AS x FROM xc GROUP BY ALL"),
        "pc": (("xc", "scs"), f"""SELECT {cell}, scenarioset, day_idx, scen_date, sum(x * shock) AS p FROM xc
            JOIN scs ON k = scs.factor GROUP BY {cell}, scenarioset, day_idx, scen_date""" if "factor" not in d else
               f"""SELECT date, book, {', '.join('xc.' + x for x in d)}, scenarioset, day_idx, scen_date, sum(x * shock) AS p
            FROM xc JOIN scs ON k = scs.factor GROUP BY ALL"""),
        "pcr": (("pc",), f"""SELECT *, row_number() OVER (PARTITION BY {cell}, scenarioset ORDER BY p, day_idx) AS rk,
            count(*) OVER (PARTITION BY {cell}, scenarioset) AS n FROM pc"""),
        "lad": (("pcr",), f"""SELECT {cell}, scenarioset, avg(p) AS mean, stddev_samp(p) AS vol,
            -quantile_cont(p, 0.01) AS var99, -quantile_cont(p, 0.025) AS var975, -quantile_cont(p, 0.05) AS var95,
            -min(p) AS worst, count(*) AS n, -avg(CASE WHEN rk <= ceil(0.025 * n) THEN p END) AS es975,
            -avg(CASE WHEN rk <= ceil(0.01 * n) THEN p END) AS es99,
            max(CASE WHEN rk = 1 THEN scen_date END) AS worst_date FROM pcr GROUP BY {cell}, scenarioset"""),
        "bk": (("bx", "scs"), """SELECT date, book, scenarioset, day_idx, scen_date, sum(x * shock) AS b FROM bx
            JOIN scs ON k = factor GROUP BY ALL"""),
        "bkr": (("bk",), f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY b, day_idx) AS rk,
            count(*) OVER (PARTITION BY {key}) AS n FROM bk"""),
        "bs": (("bkr",), f"""SELECT {key}, var_samp(b) AS bvar, -quantile_cont(b, 0.01) AS bvar99,
            -max(CASE WHEN rk = floor(0.01 * (n - 1)) + 1 THEN b END) AS bread,
            max(CASE WHEN rk = floor(0.01 * (n - 1)) + 1 THEN day_idx END) AS tday,
            -avg(CASE WHEN rk <= ceil(0.025 * n) THEN b END) AS bes FROM bkr GROUP BY {key}"""),
        "pb2": (("pc", "bkr", "bs"), f"""SELECT pc.*, b.b, b.rk, b.n, s.bvar, s.bvar99, s.bread, s.tday, s.bes FROM pc
            JOIN bkr b USING ({key}, day_idx) JOIN bs s USING ({key})"""),
        "mg": (("pb2",), f"""SELECT {cell}, scenarioset, -max(CASE WHEN day_idx = tday THEN p END) AS m_var,
            -avg(CASE WHEN rk <= ceil(0.025 * n) THEN p END) AS m_es, covar_samp(p, b) AS m_cov,
            var_samp(b - p) AS ex_var, any_value(bvar) AS bvar, any_value(bvar99) AS bvar99,
            any_value(bread) AS bread, any_value(bes) AS bes FROM pb2 GROUP BY {cell}, scenarioset"""),
        "exr": (("pb2",), f"""SELECT {cell}, scenarioset, -max(CASE WHEN rr = floor(0.01 * (n - 1)) + 1 THEN r END) AS ex_read
            FROM (SELECT {cell}, scenarioset, b - p AS r, n, row_number() OVER (PARTITION BY {cell}, scenarioset
            ORDER BY b - p) AS rr FROM pb2) GROUP BY {cell}, scenarioset"""),
        # the same contributions without days at cell grain: linear in the exposures, from the book's tail and the covariance
        "gk": (("bkr", "scs"), f"""SELECT date, book, scenarioset, factor AS k, -max(CASE WHEN rk = floor(0.01 * (n - 1)) + 1 THEN shock END) AS gv,
            -avg(CASE WHEN rk <= ceil(0.025 * n) THEN shock END) AS ge, covar_samp(shock, b) AS gc FROM bkr JOIN scs USING (scenarioset, day_idx) GROUP BY ALL"""),
        "mgx": (("xc", "gk", "bs"), f"""SELECT m.*, bvar, bvar99, bread, bes FROM (SELECT {", ".join("xc." + c.strip() for c in cell.split(","))}, scenarioset, sum(x * gv) AS m_var, sum(x * ge) AS m_es, sum(x * gc) AS m_cov
            FROM xc JOIN gk ON gk.date = xc.date AND gk.book = xc.book AND gk.k = xc.k GROUP BY ALL) m JOIN bs USING ({key})"""),
        "cvk": (("scs",), "SELECT scenarioset, a.factor AS k, b.factor AS k2, covar_samp(a.shock, b.shock) AS cov FROM scs a JOIN scs b USING (scenarioset, day_idx) GROUP BY ALL"),
        "vpx": (("xc", "cvk"), f"""SELECT {", ".join("a." + c.strip() for c in cell.split(","))}, scenarioset, sum(a.x * b.x * cov) AS vp FROM xc a JOIN cvk ON cvk.k = a.k
            JOIN xc b ON b.k = k2 AND a.date = b.date AND a.book = b.book{sj} GROUP BY ALL"""),
        "fvs": (("scs",), "SELECT scenarioset, factor AS vf, stddev_samp(shock) AS fvol FROM scs GROUP BY ALL"),
    }
    secj = "JOIN sec s ON s.position = p.position" if [x for x in sd if x != "position"] else ""
    scell = ", ".join(["p.date", "p.book"]) + secq
    ex["sp"] = (("pos", "sv", "sec"), f"""SELECT {scell}, sum(p.weight * p.weight * v.sv) AS svar, sum(p.weight) AS nw,
        sum(abs(p.weight)) AS gw FROM pos p {secj} LEFT JOIN sv v ON v.date = p.date AND v.position = p.position
        {pos_w} GROUP BY ALL""")
    ex["sb"] = (("pos", "sv"), f"""SELECT p.date, p.book, sum(p.weight * p.weight * v.sv) AS S FROM pos p
        JOIN sv v ON v.date = p.date AND v.position = p.position {pos_w} GROUP BY ALL""")
    return ex


def psql(body: str, doubles: str, ex: dict, *need: str) -> str:
    local = {}

    def add(n):
        if n in ex and n not in local:
            for dep in ex[n][0]:
                add(dep)
            local[n] = ex[n]

    for n in need:
        add(n)
    base = [n for n in need if n not in ex]
    return sql(tidy_sql(body, doubles), *base, **local)


def fr(spark, sf):
    return tables.frames(spark, sf)


# ---- additive layer --------------------------------------------------------------------------
C0 = cells("", sets="")


@query("ag01_net_exposure", psql("SELECT date, book, factor, x AS net_exposure FROM cx", "net_exposure",
                                 cells("factor"), "cx"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Factor"], ["Net exposure"])


@query("ag02_weights", psql("SELECT date, book, sector, nw AS net_weight, gw AS gross_weight FROM sp",
                            "net_weight gross_weight", cells("sector"), "sp"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Net weight", "Gross weight"])


@query("ag03_specific_risk", psql(
    "SELECT date, book, country, svar AS specific_variance, sqrt(svar) AS specific_vol FROM sp",
    "specific_variance specific_vol", cells("country"), "sp"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Country"], ["Specific variance", "Specific vol"])


@query("ag25_leaf_count", psql("SELECT date, book, factorgroup, n AS contributors_count FROM cx", "",
                               cells("factorgroup"), "cx"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "FactorGroup"], ["contributors.COUNT"])


# margins under an event set: every sector and factor on every date meets each of its days
EV = "Evt:1998H2"
CM = cells("sector factor", sets=f"'{EV}'")


@query("ag07_margins", psql(
    """SELECT date, book, coalesce(sector, 'TOTAL') AS sector, coalesce(factor, 'TOTAL') AS factor,
       CASE WHEN gs = 1 AND gf = 1 THEN 'grand' WHEN gf = 1 THEN 'per_row' WHEN gs = 1 THEN 'per_col' ELSE 'cell' END AS margin,
       max(net_exposure) AS net_exposure, -quantile_cont(p, 0.01) AS scenario_var_99 FROM (
         SELECT date, book, sector, factor, grouping(sector) AS gs, grouping(factor) AS gf, day_idx, sum(p) AS p,
         sum(x) AS net_exposure FROM (SELECT pc.*, cx.x FROM pc JOIN cx USING (date, book, sector, factor))
         GROUP BY GROUPING SETS ((date, book, day_idx, sector, factor), (date, book, day_idx, sector),
         (date, book, day_idx, factor), (date, book, day_idx)))
       GROUP BY ALL""", "net_exposure scenario_var_99", CM, "pc", "cx"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Net exposure", "Scenario VaR 99"], cols=["Factor"],
                 filters={"ScenarioSet": [EV]}, totals=True)


@query("ag16_manager_attrs", sql(
    """SELECT x.date, x.book, m.firmtype, m.n_filings AS manager_n_filings, m.n_positions_distinct AS manager_n_positions
       FROM (SELECT DISTINCT date, book FROM xb) x JOIN mgr m USING (book)""", "xb", "mgr"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "FirmType"], ["Manager n filings", "Manager n positions"])


# ---- vector measures -------------------------------------------------------------------------
@query("vec02_scenario_axis", sql(
    """SELECT DISTINCT scenarioset, CAST(day_idx AS BIGINT) AS day_idx, CAST(scen_date - DATE '1970-01-01' AS BIGINT) AS epoch
       FROM scn""", "scn"))
def _(s, d):
    from pyspark.sql import functions as F

    ax = sc.scenario_axis(fr(s, d).scenarios)
    return ax.select("ScenarioSet", F.posexplode("DateVec").alias("day_idx", "epoch"))


@query("vec03_pnl_vector", psql(
    "SELECT date, book, scenarioset, CAST(day_idx AS BIGINT) AS day_idx, scen_date, b AS pnl FROM pb", "pnl", {}, "pb"))
def _(s, d):
    f = fr(s, d)
    from pyspark.sql import functions as F

    x = f.positions.join(f.exposures, ["Date", "Position"]).groupBy("Date", "Book", "Factor").agg(
        F.sum(F.col("Weight") * F.col("Loading")).alias("x"))
    return ms.day_rows(x, f.scenarios, ["Date", "Book"]).withColumnRenamed("p", "pnl")


@query("vec04_var_ladder", psql(
    """SELECT date, book, scenarioset, mean AS scenario_mean_pnl, var99 AS scenario_var_99, var975 AS scenario_var_97_5,
       var95 AS scenario_var_95, worst AS scenario_worst_loss, n AS scenario_n FROM lad""",
    "scenario_mean_pnl scenario_var_99 scenario_var_97_5 scenario_var_95 scenario_worst_loss",
    cells("", sets=""), "lad"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "ScenarioSet"],
                 ["Scenario mean PnL", "Scenario VaR 99", "Scenario VaR 97.5", "Scenario VaR 95",
                  "Scenario worst loss", "Scenario n"])


@query("vec05_expected_shortfall", psql(
    "SELECT date, book, country, es975 AS scenario_es_97_5, es99 AS scenario_es_99 FROM lad",
    "scenario_es_97_5 scenario_es_99", cells("country"), "lad"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Country"], ["Scenario ES 97.5", "Scenario ES 99"], filters=HF)


@query("vec06_pnl_vol", psql("SELECT date, book, sector, vol AS scenario_pnl_vol FROM lad", "scenario_pnl_vol",
                             cells("sector"), "lad"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Scenario PnL vol"], filters=HF)


@query("vec07_exceedance", psql(
    """SELECT date, book, scenarioset, CASE WHEN any_value(vol) IS NOT NULL THEN
       avg(CASE WHEN abs(p) > 2 * vol THEN 1.0::DOUBLE ELSE 0.0 END) END AS exceedance_rate_2s
       FROM pc JOIN (SELECT date, book, scenarioset, vol FROM lad) USING (date, book, scenarioset) GROUP BY ALL""",
    "exceedance_rate_2s", cells("", sets=""), "pc", "lad"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "ScenarioSet"], ["Exceedance rate 2s"])


@query("vec08_worst_date", psql(
    """SELECT date, book, scenarioset, CAST(worst_date - DATE '1970-01-01' AS BIGINT) AS scenario_worst_date_epoch,
       worst AS scenario_worst_loss FROM lad""", "scenario_worst_loss", cells("", sets=""), "lad"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "ScenarioSet"], ["Scenario worst date (epoch)", "Scenario worst loss"])


@query("vec08_sorted_pnl", psql(
    "SELECT date, book, scenarioset, CAST(rk - 1 AS BIGINT) AS i, p AS pnl FROM pcr", "pnl",
    cells("", sets=""), "pcr"))
def _(s, d):
    from pyspark.sql import functions as F

    p = pivot(fr(s, d), ["Date", "Book", "ScenarioSet"], ["Scenario PnL sorted"])
    return p.select("Date", "Book", "ScenarioSet", F.posexplode("Scenario PnL sorted").alias("i", "pnl"))


@query("vec09_per_day", psql(
    """SELECT bk.date, bk.book, bk.scenarioset, CAST(bk.day_idx AS BIGINT) AS scenarioday, b AS scenario_pnl_at_day,
       CAST(scen_date - DATE '1970-01-01' AS BIGINT) AS scenario_date_at_day_epoch, -bs.bvar99 AS scenario_var_line_at_day,
       bw.w AS scenario_worst_pnl_at_day, CAST(bw.d - DATE '1970-01-01' AS BIGINT) AS scenario_worst_date_at_day_epoch
       FROM bk JOIN bs USING (date, book, scenarioset)
       JOIN (SELECT date, book, scenarioset, min(b) AS w, max(CASE WHEN rk = 1 THEN scen_date END) AS d FROM bkr GROUP BY ALL) bw USING (date, book, scenarioset)""",
    "scenario_pnl_at_day scenario_var_line_at_day scenario_worst_pnl_at_day",
    cells("", sets=""), "bs", "bk", "bkr"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "ScenarioSet", "ScenarioDay"],
                 ["Scenario PnL at day", "Scenario date at day (epoch)", "Scenario VaR line at day",
                  "Scenario worst pnl at day", "Scenario worst date at day (epoch)"])


@query("vec10_model_vol", psql(
    """SELECT date, book, scenarioset, sqrt(vol * vol + svar) AS model_vol,
       sqrt(var99 * var99 + 2.326 * 2.326 * svar) AS total_var_99,
       sqrt(es975 * es975 + 2.338 * 2.338 * svar) AS total_es_97_5 FROM lad JOIN sp USING (date, book)""",
    "model_vol total_var_99 total_es_97_5", cells("", sets=""), "lad", "sp"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "ScenarioSet"], ["Model vol", "Total VaR 99", "Total ES 97.5"])


@query("vec11_marginal_var", psql(
    """SELECT date, book, factor, m_var AS marginal_scenario_var_99, m_var / x AS var_sensitivity,
       m_var / bread AS pct_of_scenario_var_99 FROM mg JOIN cx USING (date, book, factor)""",
    "marginal_scenario_var_99 var_sensitivity pct_of_scenario_var_99", cells("factor"), "mg", "cx"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Factor"],
                 ["Marginal Scenario VaR 99", "VaR sensitivity", "% of Scenario VaR 99"], filters=HF)


@query("vec12_marginal_es", psql(
    """SELECT date, book, position, m_es AS marginal_scenario_es_97_5, m_es / bes AS pct_of_scenario_es_97_5 FROM mgx""",
    "marginal_scenario_es_97_5 pct_of_scenario_es_97_5", cells("position"), "mgx"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Position"],
                 ["Marginal Scenario ES 97.5", "% of Scenario ES 97.5"], filters=HF)


_T = "sqrt(bvar99 * bvar99 + 2.326 * 2.326 * S)"
_MT = f"(m_var * bvar99 + 2.326 * 2.326 * coalesce(svar, 0)) / {_T}"


@query("vec13_marginal_total_var", psql(
    f"""SELECT date, book, sector, {_MT} AS marginal_total_var_99,
       ({_MT}) / ((bread * bvar99 + 2.326 * 2.326 * S) / {_T}) AS pct_of_total_var_99
       FROM mg JOIN sp USING (date, book, sector) JOIN sb USING (date, book)""",
    "marginal_total_var_99 pct_of_total_var_99", cells("sector"), "mg", "sp", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Marginal Total VaR 99", "% of Total VaR 99"], filters=HF)


_SHARES = f"""SELECT date, book, country, position, ({_MT}) / ((bread * bvar99 + 2.326 * 2.326 * S) / {_T}) AS share
       FROM mgx JOIN sp USING (date, book, country, position) JOIN sb USING (date, book)"""
CP = cells("country position")


@query("vec14_risk_hhi", psql(
    f"SELECT date, book, country, sum(share * share) AS risk_hhi FROM ({_SHARES}) GROUP BY ALL", "risk_hhi",
    CP, "mgx", "sp", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Country"], ["Risk HHI"], filters=HF)


@query("vec15_top5_share", psql(
    f"""SELECT date, book, sum(share) AS top_5_risk_share FROM (SELECT *, rank() OVER (PARTITION BY date, book ORDER BY share DESC)
       AS r FROM ({_SHARES})) WHERE r <= 5 GROUP BY ALL""", "top_5_risk_share", CP, "mgx", "sp", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book"], ["Top-5 risk share"], filters=HF)


@query("vec16_incremental_var", psql(
    f"""SELECT date, book, country, bread - ex_read AS incremental_scenario_var_99,
       (bread * bvar99 + 2.326 * 2.326 * S) / {_T} - sqrt(ex_read * ex_read + 2.326 * 2.326 * (S - coalesce(svar, 0))) AS incremental_total_var_99
       FROM mg JOIN exr USING (date, book, country, scenarioset) JOIN sp USING (date, book, country) JOIN sb USING (date, book)""",
    "incremental_scenario_var_99 incremental_total_var_99", cells("country"), "mg", "exr", "sp", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Country"],
                 ["Incremental Scenario VaR 99", "Incremental Total VaR 99"], filters=HF)


@query("vec17_marginal_model_vol", psql(
    """SELECT date, book, position, (m_cov + coalesce(svar, 0)) / sqrt(bvar + S) AS marginal_model_vol,
       (m_cov + coalesce(svar, 0)) / (bvar + S) AS pct_of_model_vol, m_cov AS factor_variance_contribution
       FROM mgx JOIN sp USING (date, book, position) JOIN sb USING (date, book)""",
    "marginal_model_vol pct_of_model_vol factor_variance_contribution", cells("position"), "mgx", "sp", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Position"],
                 ["Marginal Model vol", "% of Model vol", "Factor variance contribution"], filters=HF)


@query("vec18_incremental_model_vol", psql(
    """SELECT date, book, sector, sqrt(bvar + S) - sqrt(bvar - 2 * m_cov + vp + S - coalesce(svar, 0)) AS incremental_model_vol
       FROM mgx JOIN vpx USING (date, book, sector, scenarioset) JOIN sp USING (date, book, sector) JOIN sb USING (date, book)""",
    "incremental_model_vol", cells("sector"), "mgx", "vpx", "sp", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Incremental Model vol"], filters=HF)


@query("vec19_factor_vol", sql(tidy_sql(
    "SELECT scenarioset, factor, stddev_samp(shock) AS fvol FROM scn GROUP BY ALL", "fvol", 9), "scn"), 9)
def _(s, d):
    return ms.factor_vol(fr(s, d).scenarios)


@query("vec20_vol_ex_factor", psql(
    "SELECT date, book, factor, sqrt(ex_var + S) AS vol_ex_factor FROM mg JOIN sb USING (date, book)",
    "vol_ex_factor", cells("factor"), "mg", "sb"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Factor"], ["Vol ex factor"], filters=HF)


@query("vec21_min_variance_hedge", psql(
    """SELECT h.date, h.book, h.factor, any_value(h.h) AS min_variance_hedge_ratio,
       sqrt(var_samp(bk.b + h.h * scs.shock) + any_value(S)) AS vol_at_min_variance_hedge FROM
       (SELECT date, book, factor, S, -m_cov / (x * fvol * fvol) AS h FROM mg JOIN cx USING (date, book, factor)
        JOIN fvs ON vf = factor JOIN sb USING (date, book)) h
       JOIN bk ON bk.date = h.date AND bk.book = h.book JOIN scs ON scs.factor = h.factor AND scs.day_idx = bk.day_idx
       GROUP BY h.date, h.book, h.factor""", "min_variance_hedge_ratio vol_at_min_variance_hedge",
    cells("factor"), "mg", "cx", "fvs", "sb", "bk", "scs"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Factor"], ["Min-variance hedge ratio", "Vol at min-variance hedge"], filters=HF)


@query("vec22_stressed_model_vol", psql(
    """SELECT date, book, sector, 1.25 * sqrt(0.25 * vp + 0.75 * sxs * sxs + coalesce(svar, 0)) AS stressed_model_vol
       FROM vpx JOIN sp USING (date, book, sector) JOIN (SELECT date, book, sector, sum(x * fvol) AS sxs
       FROM xc JOIN fvs ON vf = k GROUP BY ALL) USING (date, book, sector)""",
    "stressed_model_vol", cells("sector"), "vpx", "sp", "xc", "fvs"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Stressed model vol"], filters=HF,
                 vol_mult=1.25, rho_blend=0.75)


@query("vec23_custom_stress", psql(
    """SELECT date, book, sector, sum(x * (CASE k WHEN 'Market' THEN -2.0 WHEN 'SMALL' THEN 1.5 ELSE 0 END) * fvol) AS custom_stress_pnl
       FROM xc JOIN fvs ON vf = k GROUP BY ALL""", "custom_stress_pnl", cells("sector"), "xc", "fvs"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Custom stress PnL"], filters=HF,
                 shocks={"Market": -2.0, "SMALL": 1.5})


@query("vec01_pit_sets", sql(tidy_sql(f"""SELECT 'PIT:' || strftime(e, '%Y-%m-%d') AS scenarioset, row_number() OVER (PARTITION BY e, factor ORDER BY date) - 1 AS day_idx, date AS scen_date, factor, ret AS shock
    FROM panel JOIN (SELECT e FROM (SELECT DISTINCT last_day(date) AS e FROM panel) JOIN (SELECT DISTINCT date AS d FROM panel) ON d <= e WHERE e <= (SELECT max(date) FROM panel) GROUP BY e HAVING count(*) >= {sc.MIN_PIT_OBS}) ON date <= e""", "shock", 12), "panel"), 12)
def _(s, d):
    return sc.pit_sets(fr(s, d).factor_returns)


@query("mod22_pit_model_vol", psql("""SELECT x.book, sqrt(v.vol * v.vol + x.svar) AS model_vol FROM spec x JOIN (SELECT b.book, stddev_samp(b) AS vol FROM (SELECT x.book, p.date, sum(x.x * p.ret) AS b
    FROM xb x JOIN panel p ON p.factor = x.factor WHERE x.date = DATE '2000-06-30' AND p.date <= DATE '2000-06-30' GROUP BY ALL) b GROUP BY b.book) v ON v.book = x.book WHERE x.date = DATE '2000-06-30'""", "model_vol", {}, "spec", "xb", "panel"))
def _(s, d):
    f = fr(s, d)
    return pivot(f, ["Book"], ["Model vol"], filters={"Date": [ASOF], "ScenarioSet": ["PIT:2000-06-30"]}, scenarios=sc.pit_sets(f.factor_returns, ["2000-06-30"]))
