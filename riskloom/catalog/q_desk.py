"""Desk queries: pivot presets, what-if, stress, hedges, limits, liquidity, filing changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_attr import artifact, asql
from riskloom.catalog.q_risk import AS, ASOF, HF, cells, fr, psql
from riskloom.catalog.q_series import book_series
from riskloom.catalog.registry import query, tidy_sql
from riskloom.functions.quantiles import top_k
from riskloom.operators import attribution as at, desk, exposure as ex, measures as ms, timeseries as ts, universe as un
from riskloom.plans import views
from riskloom.plans.pivot import pivot

PREV = dt.date(2000, 5, 31)
C0 = cells("", date=True, sets="")
CH = cells("", date=True)


# ---- query surface ---------------------------------------------------------------------------
@query("qry01_pivot", psql("SELECT sector, factor, x AS net_exposure FROM cx WHERE book = 'BUILDING'", "net_exposure", cells("sector factor", date=True), "cx"))
def _(s, d):
    return pivot(fr(s, d), ["Sector"], ["Net exposure"], cols=["Factor"], filters={"Date": [ASOF], "Book": ["BUILDING"]})


TR = [("Trim", "BUILDING", "P1", 0.0), ("Trim", "BUILDING", "P2", 0.05), ("Add", "BUILDING", "P3", 0.08), ("Add", "MACHINERY", "P4", 0.02)]


def trades(s):
    return s.createDataFrame([(b, ASOF, k, p, w) for b, k, p, w in TR], "Branch string, Date date, Book string, Position string, Weight double")


_TRV = ", ".join(f"('{b}', {AS}, '{k}', '{p}', {w}::DOUBLE)" for b, k, p, w in TR)
WPOS = (("pos",), f"""SELECT 'Base' AS branch, date, book, position, weight FROM pos WHERE date = {AS} UNION ALL
    SELECT coalesce(c.branch, t.branch), {AS}, coalesce(c.book, t.book), coalesce(c.position, t.position), coalesce(t.weight, c.weight) FROM
    (SELECT s.branch, p.* FROM pos p JOIN (SELECT DISTINCT branch, date, book FROM (VALUES {_TRV}) v(branch, date, book, position, weight)) s ON s.date = p.date AND s.book = p.book) c
    FULL OUTER JOIN (SELECT * FROM (VALUES {_TRV}) v(branch, date, book, position, weight)) t ON t.branch = c.branch AND t.book = c.book AND t.position = c.position
    WHERE coalesce(t.weight, c.weight) <> 0""")


@query("jn13_branch_override", sql(tidy_sql("SELECT branch, date, book, position, weight FROM wpos", "weight", 9), wpos=WPOS), 9)
def _(s, d):
    p = ex.with_branches(fr(s, d).positions.filter(F.col("Date") == F.lit(ASOF)), trades(s))
    return p.select("Branch", "Date", "Book", "Position", "Weight")


WRISK = {"wpos": WPOS, "wx": (("wpos", "expo"), "SELECT branch, book, factor, sum(weight * loading) AS x FROM wpos p JOIN expo e ON e.date = p.date AND e.position = p.position GROUP BY ALL"),
         "wp": (("wx", "scn"), "SELECT branch, book, day_idx, sum(x * shock) AS p FROM wx JOIN scn ON scn.factor = wx.factor AND scenarioset = 'HistFull' GROUP BY ALL"),
         "wr": (("wp", "wpos", "sv"), """SELECT a.*, b.svar, b.nw, b.gw FROM (SELECT branch, book, stddev_samp(p) AS vol, -quantile_cont(p, 0.01) AS var99 FROM wp GROUP BY ALL) a
             JOIN (SELECT branch, book, sum(weight * weight * sv) AS svar, sum(weight) AS nw, sum(abs(weight)) AS gw FROM wpos p LEFT JOIN sv ON sv.date = p.date AND sv.position = p.position GROUP BY ALL) b USING (branch, book)""")}


@query("qry02_whatif", sql(tidy_sql("SELECT branch, book, var99 AS scenario_var_99, sqrt(vol * vol + svar) AS model_vol, nw AS net_weight, gw AS gross_weight FROM wr",
                                    "scenario_var_99 model_vol net_weight gross_weight"), **WRISK))
def _(s, d):
    return pivot(fr(s, d), ["Book"], ["Scenario VaR 99", "Model vol", "Net weight", "Gross weight"],
                 filters={"Date": [ASOF], **HF}, trades=trades(s))


@query("mod07_whatif_delta", sql(tidy_sql("""SELECT a.branch, a.book, b.var99 AS var_before, a.var99 AS var_after, a.var99 - b.var99 AS var_delta,
    sqrt(a.vol * a.vol + a.svar) - sqrt(b.vol * b.vol + b.svar) AS vol_delta FROM wr a JOIN wr b ON a.book = b.book AND b.branch = 'Base' WHERE a.branch <> 'Base'""",
    "var_before var_after var_delta vol_delta"), **WRISK))
def _(s, d):
    r = pivot(fr(s, d), ["Book"], ["Scenario VaR 99", "Model vol"], filters={"Date": [ASOF], **HF}, trades=trades(s))
    r = r.select("Branch", "Book", F.col("Scenario VaR 99").alias("v"), F.col("Model vol").alias("m"))
    b = r.filter("Branch = 'Base'").select("Book", F.col("v").alias("v0"), F.col("m").alias("m0"))
    return r.filter("Branch <> 'Base'").join(b, "Book").select(
        "Branch", "Book", F.col("v0").alias("var_before"), F.col("v").alias("var_after"), (F.col("v") - F.col("v0")).alias("var_delta"),
        (F.col("m") - F.col("m0")).alias("vol_delta"))


@query("qry03_book_tile", psql("""SELECT book, sqrt(var99 * var99 + 2.326 * 2.326 * svar) AS total_var_99, var99 AS scenario_var_99, worst AS scenario_worst_loss, sqrt(svar) AS specific_vol
    FROM lad JOIN sp USING (date, book)""", "total_var_99 scenario_var_99 scenario_worst_loss specific_vol", CH, "lad", "sp"))
def _(s, d):
    return views.book_tile(fr(s, d), ASOF, "HistFull")


@query("qry04_scenario_board", psql("""SELECT scenarioset, var99 AS scenario_var_99, worst AS scenario_worst_loss, sqrt(var99 * var99 + 2.326 * 2.326 * svar) AS total_var_99
    FROM lad JOIN sp USING (date, book) WHERE book = 'BUILDING'""", "total_var_99 scenario_var_99 scenario_worst_loss", C0, "lad", "sp"))
def _(s, d):
    return views.scenario_board(fr(s, d), ASOF, "BUILDING")


@query("qry05_exposures", psql("SELECT f.factorgroup, c.factor, c.x AS net_exposure FROM cx c JOIN fm f ON f.factor = c.factor WHERE book = 'BUILDING'", "net_exposure", cells("factor", date=True), "cx", "fm"))
def _(s, d):
    return views.exposures(fr(s, d), ASOF, "BUILDING")


@query("qry06_breakdown_position", psql("""SELECT c.position, 't' || substring(c.position, 2) AS ticker, c.x AS net_exposure, l.var99 AS scenario_var_99, l.worst AS scenario_worst_loss
    FROM cx c JOIN lad l USING (date, book, position) WHERE book = 'BUILDING'""", "net_exposure scenario_var_99 scenario_worst_loss", cells("position", date=True), "cx", "lad"))
def _(s, d):
    return views.breakdown(fr(s, d), ASOF, "HistFull", "BUILDING", "position")


@query("qry07_trends", psql("SELECT date, book, var99 AS scenario_var_99, es975 AS scenario_es_97_5 FROM lad", "scenario_var_99 scenario_es_97_5", cells(""), "lad"))
def _(s, d):
    return views.trends(fr(s, d), "HistFull", ["Scenario VaR 99", "Scenario ES 97.5"])


@query("qry08_position_detail", sql(tidy_sql(f"""SELECT p.position, s.ticker, s.issuer, s.sector, s.country, w.book, w.weight, v.sv AS specificvar, e.factor, e.loading
    FROM (SELECT 'P7' AS position) p JOIN sec s USING (position) LEFT JOIN (SELECT position, book, arg_max(weight, date) AS weight FROM pos WHERE date <= {AS} GROUP BY ALL) w USING (position)
    LEFT JOIN (SELECT position, arg_max(sv, date) AS sv FROM sv WHERE date <= {AS} GROUP BY ALL) v USING (position) LEFT JOIN expo e ON e.position = p.position AND e.date = {AS}""",
    "weight specificvar loading", 9), "sec", "pos", "sv", "expo"), 9)
def _(s, d):
    return views.position_detail(fr(s, d), ASOF, "P7")


@query("qry09_lazy_drill", psql("SELECT sector, x AS net_exposure FROM cx WHERE book = 'BUILDING' AND country = 'ASIA'", "net_exposure", cells("country sector", date=True), "cx"))
def _(s, d):
    return views.drill(fr(s, d), ["Country", "Sector", "Issuer", "Position"], ["ASIA"], ["Net exposure"], {"Date": [ASOF], "Book": ["BUILDING"]})


@query("qry10_page", psql("""SELECT book, position, factor, x AS net_exposure, abs(x) AS size FROM cx
    QUALIFY row_number() OVER (ORDER BY abs(x) DESC, book, position, factor) BETWEEN 251 AND 500""", "net_exposure size", cells("position factor", date=True), "cx"))
def _(s, d):
    """The second page of the leaf slice, opened by the key of the first page's last row."""
    p = pivot(fr(s, d), ["Book", "Position", "Factor"], ["Net exposure"], filters={"Date": [ASOF]}).withColumn("size", F.abs("Net exposure"))
    order = [("size", True), ("Book", False), ("Position", False), ("Factor", False)]
    first = views.page(p, order, 250)
    last = first.orderBy("size", F.desc("Book"), F.desc("Position"), F.desc("Factor")).first()
    return views.page(p, order, 250, (last["size"], last["Book"], last["Position"], last["Factor"])).select("Book", "Position", "Factor", "Net exposure", "size")


@query("qry11_contribution_view", psql("SELECT factor, m_var AS marginal_scenario_var_99, m_var / bread AS pct_of_scenario_var_99 FROM mg WHERE book = 'FURNITURE'",
                                       "marginal_scenario_var_99 pct_of_scenario_var_99", cells("factor", date=True), "mg"))
def _(s, d):
    return views.contributions(fr(s, d), ASOF, "HistFull", "FURNITURE")


@query("qry11_tail_ladder", psql("""SELECT scenarioset, var95 AS scenario_var_95, var975 AS scenario_var_97_5, var99 AS scenario_var_99, es975 AS scenario_es_97_5, es99 AS scenario_es_99, vol AS scenario_pnl_vol
    FROM lad WHERE book = 'FURNITURE'""", "scenario_var_95 scenario_var_97_5 scenario_var_99 scenario_es_97_5 scenario_es_99 scenario_pnl_vol", C0, "lad"))
def _(s, d):
    return views.tail_ladder(fr(s, d), ASOF, "FURNITURE")


@query("qry12_rest_rollup", psql("""SELECT book, CASE WHEN rk <= 8 THEN position ELSE 'rest' END AS name, sum(x) AS value, count(*) AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY book ORDER BY abs(x) DESC, position) AS rk FROM cx) GROUP BY ALL""", "value", cells("position", date=True), "cx"))
def _(s, d):
    p = pivot(fr(s, d), ["Book", "Position"], ["Net exposure"], filters={"Date": [ASOF]})
    return views.top_and_rest(p, ["Book"], "Position", "Net exposure", 8)


@query("qry12_effective_bets", psql("SELECT book, 1 / sum(share * share) AS effective_bets FROM (SELECT book, nw / sum(nw) OVER (PARTITION BY book) AS share FROM sp) GROUP BY book", "effective_bets", cells("position", date=True), "sp"))
def _(s, d):
    p = pivot(fr(s, d), ["Book", "Position"], ["Net weight"], filters={"Date": [ASOF]})
    return at.concentration(p, ["Book"], "Net weight").select("Book", F.try_divide(F.lit(1.0), "hhi").alias("effective_bets"))


@query("vec24_path_report", psql("""SELECT b.book, CAST(b.day_idx AS BIGINT) AS day_idx, b.scen_date, b.b AS pnl, CAST(b.rk - 1 AS BIGINT) AS rank, CASE WHEN b.n > 1 THEN (b.rk - 1) / (b.n - 1) END AS pctile, p.country, p.p AS country_pnl
    FROM bkr b JOIN pc p USING (date, book, scenarioset, day_idx)""", "pnl pctile country_pnl", cells("country", date=True, sets="'Evt:1998H2'"), "bkr", "pc"))
def _(s, d):
    return views.path_report(fr(s, d), ASOF, "Evt:1998H2", "Country")


@query("src16_saved_view", psql("SELECT book, sector, x AS net_exposure, gw AS gross_weight FROM cx JOIN sp USING (date, book, sector) WHERE book IN ('BUILDING', 'FURNITURE')",
                                "net_exposure gross_weight", cells("sector", date=True), "cx", "sp"))
def _(s, d):
    v = {"state": {"rows": ["Book", "Sector"], "cols": [], "measures": ["Net exposure", "Gross weight"], "filters": {"Date": ["1999-01-31"], "Book": ["MACHINERY"]}}}
    return views.run_view(fr(s, d), v, {"Date": [ASOF], "Book": ["BUILDING", "FURNITURE"]})["view"]


@query("prj21_grid", psql("""SELECT * FROM (SELECT book, coalesce(factor, 'TOTAL') AS factor, sum(x) AS x FROM cx WHERE factor IN ('Market', 'LARGE', 'SMALL') GROUP BY GROUPING SETS ((book, factor), (book)))
    PIVOT (sum(x) FOR factor IN ('LARGE' AS large, 'Market' AS market, 'SMALL' AS small, 'TOTAL' AS total) GROUP BY book)""", "large market small total", cells("factor", date=True), "cx"))
def _(s, d):
    p = pivot(fr(s, d), ["Book"], ["Net exposure"], cols=["Factor"], filters={"Date": [ASOF], "Factor": ["Market", "LARGE", "SMALL"]}, totals=True)
    return views.grid(p, ["Book"], "Factor", "Net exposure", ["LARGE", "Market", "SMALL", ex.TOTAL])


# ---- desk analytics ---------------------------------------------------------------------------
@query("mod06_euler_contributions", psql("""SELECT book, position, nw AS weight, ctr / nw AS mcr, ctr, ctr / sqrt(bvar + S) AS share FROM (SELECT book, position, nw, (m_cov + svar) / sqrt(bvar + S) AS ctr, bvar, S
    FROM mg JOIN sp USING (date, book, position) JOIN sb USING (date, book))""", "weight mcr ctr share", cells("position", date=True), "mg", "sp", "sb"))
def _(s, d):
    p = pivot(fr(s, d), ["Book", "Position"], ["Net weight", "Marginal Model vol", "% of Model vol"], filters={"Date": [ASOF], **HF})
    return p.select("Book", "Position", F.col("Net weight").alias("weight"), F.try_divide("Marginal Model vol", "Net weight").alias("mcr"),
                    F.col("Marginal Model vol").alias("ctr"), F.col("% of Model vol").alias("share"))


def as_of_x(f, *by):
    p = f.positions.filter(F.col("Date") == F.lit(ASOF))
    return ex.net_exposure(p, f.exposures, ["Book", "Factor"])


def vols(f):
    return ms.factor_vol(f.scenarios.filter(F.col("ScenarioSet") == "HistFull")).drop("ScenarioSet")


XA = {"xa": (("xb",), f"SELECT book, factor, x FROM xb WHERE date = {AS}")}


@query("mod08_custom_stress", sql(tidy_sql("""SELECT v.shockid, x.book, x.factor, x.x AS exposure, v.sigma, f.vol, v.sigma * f.vol AS shock_return, x.x * v.sigma * f.vol AS pnl FROM xa x JOIN fvol f USING (factor)
    JOIN (VALUES ('A', 'Market', -2.0::DOUBLE), ('A', 'SMALL', 1.0), ('B', 'LARGE', -3.0)) v(shockid, factor, sigma) ON v.factor = x.factor""", "exposure sigma vol shock_return pnl"), "fvol", **XA))
def _(s, d):
    f = fr(s, d)
    sh = s.createDataFrame([("A", "Market", -2.0), ("A", "SMALL", 1.0), ("B", "LARGE", -3.0)], "ShockId string, Factor string, sigma double")
    return desk.factor_stress(as_of_x(f), vols(f), sh).select("ShockId", "Book", "Factor", F.col("x").alias("exposure"), "sigma", F.col("fvol").alias("vol"), "shock_return", "pnl")


_PAIR = ("Market", "SMALL")
_COV = "(SELECT a.factor AS f, b.factor AS g, covar_samp(a.ret, b.ret) AS c FROM panel a JOIN panel b ON a.date = b.date GROUP BY ALL)"


@query("mod09_conditional_stress", sql(tidy_sql(f"""SELECT shockid, x.book, x.factor, x.x AS exposure, i.implied AS implied_return, x.x * i.implied AS pnl FROM xa x JOIN
    (SELECT 'M2' AS shockid, c.f, c.c / s11 * -2 * sqrt(s11) AS implied FROM {_COV} c, m WHERE c.g = '{_PAIR[0]}'
     UNION ALL SELECT 'PAIR', p.f, (p.c * (-sqrt(s11) * s22 - 1.5 * sqrt(s22) * s12) + q.c * (1.5 * sqrt(s22) * s11 + sqrt(s11) * s12)) / (s11 * s22 - s12 * s12)
     FROM {_COV} p JOIN {_COV} q ON p.f = q.f, m WHERE p.g = '{_PAIR[0]}' AND q.g = '{_PAIR[1]}') i ON i.f = x.factor""", "exposure implied_return pnl"),
    "panel", m=(("panel",), f"""SELECT max(c) FILTER (WHERE f = '{_PAIR[0]}' AND g = '{_PAIR[0]}') AS s11, max(c) FILTER (WHERE f = '{_PAIR[1]}' AND g = '{_PAIR[1]}') AS s22,
     max(c) FILTER (WHERE f = '{_PAIR[0]}' AND g = '{_PAIR[1]}') AS s12 FROM {_COV}"""), **XA))
def _(s, d):
    """One shocked factor, and two at once (a real solve)."""
    f = fr(s, d)
    cov = ms.factor_cov(f.scenarios.filter(F.col("ScenarioSet") == "HistFull")).drop("ScenarioSet")
    sh = s.createDataFrame([("M2", "Market", -2.0), ("PAIR", _PAIR[0], -1.0), ("PAIR", _PAIR[1], 1.5)], "ShockId string, Factor string, sigma double")
    c = desk.conditional_shocks(cov, sh)
    return as_of_x(f).join(F.broadcast(c), "Factor").select("ShockId", "Book", "Factor", F.col("x").alias("exposure"), "implied_return", (F.col("x") * F.col("implied_return")).alias("pnl"))


@query("mod10_correlation_stress", psql("""SELECT book, sqrt(vol * vol + svar) AS base_vol_1d, 1.5 * sqrt(0.5 * vol * vol + 0.5 * sxs * sxs + svar) AS stressed_vol_1d,
    2.326 * sqrt(vol * vol + svar) AS base_var99_normal, 2.326 * 1.5 * sqrt(0.5 * vol * vol + 0.5 * sxs * sxs + svar) AS stressed_var99_normal FROM lad JOIN sp USING (date, book)
    JOIN (SELECT date, book, sum(x * fvol) AS sxs FROM xc JOIN fvs ON vf = k GROUP BY ALL) USING (date, book)""", "base_vol_1d stressed_vol_1d base_var99_normal stressed_var99_normal", CH, "lad", "sp", "xc", "fvs"))
def _(s, d):
    p = pivot(fr(s, d), ["Book"], ["Model vol", "Stressed model vol"], filters={"Date": [ASOF], **HF}, vol_mult=1.5, rho_blend=0.5)
    b, t = F.col("Model vol"), F.col("Stressed model vol")
    return p.select("Book", b.alias("base_vol_1d"), t.alias("stressed_vol_1d"), (ms.Z99 * b).alias("base_var99_normal"), (ms.Z99 * t).alias("stressed_var99_normal"))


@query("mod11_reverse_stress", sql(tidy_sql("""SELECT book, factor, x AS exposure, vol, CASE WHEN abs(x * vol) > 1e-12 THEN -0.05 / (x * vol) END AS sigma_to_breach, rank() OVER (PARTITION BY book ORDER BY abs(-0.05 / (x * vol))) AS rank
    FROM xa JOIN fvol USING (factor)""", "exposure vol sigma_to_breach", 4), "fvol", **XA), 4)
def _(s, d):
    f = fr(s, d)
    r = desk.reverse_stress(as_of_x(f), vols(f), 0.05)
    return r.select("Book", "Factor", F.col("x").alias("exposure"), F.col("fvol").alias("vol"), "sigma_to_breach",
                    F.rank().over(Window.partitionBy("Book").orderBy("abs_sigma")).alias("rank"))


@query("mod12_hedge_table", psql("""SELECT book, factor, x AS net_exposure, sqrt(ex_var + S) AS vol_ex_factor, -m_cov / (x * fvol * fvol) AS min_variance_hedge_ratio,
    sqrt(greatest(bvar - power(m_cov / (x * fvol), 2), 0) + S) AS vol_at_min_variance_hedge FROM mg JOIN cx USING (date, book, factor) JOIN sb USING (date, book) JOIN fvs ON vf = factor""",
    "net_exposure vol_ex_factor min_variance_hedge_ratio vol_at_min_variance_hedge", cells("factor", date=True), "mg", "cx", "sb", "fvs"))
def _(s, d):
    return pivot(fr(s, d), ["Book", "Factor"], ["Net exposure", "Vol ex factor", "Min-variance hedge ratio", "Vol at min-variance hedge"], filters={"Date": [ASOF], **HF})


@query("mod05_latest_weights", sql(tidy_sql(f"SELECT book, position, arg_max(weight, date) AS weight FROM pos WHERE date <= {AS} GROUP BY ALL", "weight", 9), "pos"), 9)
def _(s, d):
    p = fr(s, d).positions.filter(F.col("Date") <= F.lit(ASOF))
    return p.groupBy("Book", "Position").agg(F.max_by("Weight", F.col("Date")).alias("Weight"))


LIMS = [("*", m, w, l) for m, _, w, l in desk.DEFAULT_LIMITS] + [("BUILDING", "Scenario VaR 99", 0.010, 0.012)]


def limits_df(s):
    return s.createDataFrame(LIMS, "Book string, metric string, warn double, limit double")


def measured(s, d):
    f = fr(s, d)
    p = pivot(f, ["Book"], ["Scenario VaR 99", "Scenario ES 97.5", "Top-5 risk share"], filters={"Date": [ASOF], **HF})
    kv = F.create_map(*[c for n in p.columns if n != "Book" for c in (F.lit(n), F.col(f"`{n}`"))])
    m = p.select("Book", F.explode(kv).alias("metric", "value"), F.lit(None).cast("string").alias("detail"))
    return m.unionByName(desk.concentration_values(desk.latest_positions(f.positions, ASOF), f.securities))


_MTOT = "(m_var * bvar99 + 2.326 * 2.326 * coalesce(svar, 0)) / (bread * bvar99 + 2.326 * 2.326 * S)"
CPOS = cells("position", date=True)
_MEAS = f"""SELECT book, metric, value, detail FROM (
    SELECT book, 'Scenario VaR 99' AS metric, any_value(bvar99) AS value, NULL AS detail FROM mg GROUP BY book UNION ALL SELECT book, 'Scenario ES 97.5', any_value(bes), NULL FROM mg GROUP BY book UNION ALL
    SELECT book, 'Top-5 risk share', sum(sh), NULL FROM (SELECT book, {_MTOT} AS sh, rank() OVER (PARTITION BY book ORDER BY {_MTOT} DESC) AS rk FROM mg JOIN sp USING (date, book, position) JOIN sb USING (date, book)) WHERE rk <= 5 GROUP BY book UNION ALL
    SELECT book, 'single_name_weight', max(weight), replace(arg_max(position, weight), 'P', 't') FROM pos WHERE date = {AS} GROUP BY book UNION ALL
    SELECT book, 'sector_weight', max(w), arg_max(sector, w) FROM (SELECT book, sector, sum(weight) AS w FROM pos p JOIN sec s ON s.position = p.position WHERE date = {AS} GROUP BY ALL) GROUP BY book)"""
_LIMV = ", ".join(f"('{b}', '{m}', {w}::DOUBLE, {l}::DOUBLE)" for b, m, w, l in LIMS)
_CHK = f"""SELECT m.book, m.metric, m.value, l.warn, l.lim AS "limit", CASE WHEN m.value >= l.lim THEN 'breach' WHEN m.value >= l.warn THEN 'amber' ELSE 'green' END AS status, l.lim - m.value AS headroom, m.detail,
    l.b = '*' AND m.book <> 'BUILDING' AS cross_book FROM ({_MEAS}) m JOIN (VALUES {_LIMV}) l(b, metric, warn, lim) ON l.metric = m.metric AND (l.b = m.book OR (l.b = '*' AND NOT (m.book = 'BUILDING' AND m.metric = 'Scenario VaR 99')))"""


@query("mod29_limits", psql(_CHK, "value warn limit headroom", CPOS, "mg", "sp", "sb", "pos", "sec"))
def _(s, d):
    return desk.check_limits(measured(s, d), limits_df(s), "BUILDING")


@query("mod29_overall_status", psql(f"""SELECT book, CASE max(CASE status WHEN 'green' THEN 0 WHEN 'unknown' THEN 1 WHEN 'amber' THEN 2 ELSE 3 END) WHEN 0 THEN 'green' WHEN 1 THEN 'unknown' WHEN 2 THEN 'amber' ELSE 'breach' END AS status,
    count(*) FILTER (WHERE status = 'breach') AS breaches FROM ({_CHK}) GROUP BY book""", "", CPOS, "mg", "sp", "sb", "pos", "sec"))
def _(s, d):
    return desk.overall_status(desk.check_limits(measured(s, d), limits_df(s), "BUILDING"))


_DEFV = ", ".join(f"('{sc}', '{m}', {w}::DOUBLE, {lim}::DOUBLE)" for m, sc, w, lim in desk.DEFAULT_LIMITS)


@query("src13_limit_table", sql(tidy_sql(f"""SELECT b.book, d.scope, d.metric, CASE d.metric WHEN 'single_name_weight' THEN 0.8 * b.mx WHEN 'Scenario VaR 99' THEN 0.04 ELSE d.warn END AS warn,
    CASE d.metric WHEN 'single_name_weight' THEN b.mx ELSE d.lim END AS "limit", b.book AS calibrated_for, 'HistFull' AS scenario_set FROM (SELECT book, max(weight) AS mx FROM pos GROUP BY book) b,
    (VALUES {_DEFV}) d(scope, metric, warn, lim) UNION ALL SELECT book, 'concentration', 'names', NULL, count(DISTINCT position), book, 'HistFull' FROM pos GROUP BY book""",
    "warn limit", 9), "pos"), 9)
def _(s, d):
    """Limit files of all books, their levels set from the books' own holdings, read back as a table."""
    p = fr(s, d).positions.groupBy("Book").agg(F.max("Weight").alias("mx"), F.count_distinct("Position").alias("n"))
    text = F.format_string('{"_comment": "set from holdings", "calibrated_for": "%s", "book": {"_old": {"warn": 1.0, "limit": 1.0}, "Scenario VaR 99": {"warn": 0.04}}, '
                           '"concentration": {"single_name_weight": {"warn": %s, "limit": %s}, "names": {"limit": %s}}}',
                           "Book", (0.8 * F.col("mx")).cast("string"), F.col("mx").cast("string"), F.col("n").cast("string"))
    return desk.parse_limits(p.select("Book", text.alias("config")))


@query("mod30_liquidity", sql(tidy_sql("""SELECT date, book, count(*) AS n_names, sum(CASE WHEN days <= 5 THEN mv ELSE 0 END) / sum(mv) AS pct_mv_within_horizon, sum(CASE WHEN days <= 5 THEN weight ELSE 0 END) AS pct_weight_within_horizon,
    sum(weight * days) / sum(CASE WHEN days IS NOT NULL THEN weight END) AS weighted_avg_days, max(days) AS max_days, count(*) FILTER (WHERE days IS NULL) AS n_no_adv, sum(CASE WHEN days IS NULL THEN weight ELSE 0 END) AS weight_no_adv
    FROM (SELECT *, CASE WHEN adv > 0 THEN mv / (0.2 * adv) END AS days FROM pos) GROUP BY ALL""", "pct_mv_within_horizon pct_weight_within_horizon weighted_avg_days max_days weight_no_adv"), "pos"))
def _(s, d):
    return desk.liquidity(fr(s, d).positions)


DIFF = {"df": (("pos",), f"""SELECT coalesce(a.book, b.book) AS book, coalesce(a.position, b.position) AS position, a.weight AS w_before, b.weight AS w_after,
    CASE WHEN a.weight IS NULL THEN 'entered' WHEN b.weight IS NULL THEN 'exited' WHEN abs(b.weight - a.weight) > 0.005 THEN 'resized' END AS change, coalesce(b.weight, 0) - coalesce(a.weight, 0) AS delta
    FROM (SELECT * FROM pos WHERE date = DATE '2000-05-31') a FULL OUTER JOIN (SELECT * FROM pos WHERE date = {AS}) b ON a.book = b.book AND a.position = b.position""")}


def diff(f):
    p = f.positions
    return desk.filing_diff(p.filter(F.col("Date") == F.lit(PREV)), p.filter(F.col("Date") == F.lit(ASOF)), ["Book"])


@query("jn12_filing_diff", sql(tidy_sql("SELECT * FROM df WHERE change IS NOT NULL", "w_before w_after delta"), **DIFF))
def _(s, d):
    return diff(fr(s, d)).select("Book", "Position", "w_before", "w_after", "change", "delta")


@query("mod31_change_counts", sql(tidy_sql("SELECT book, change, count(*) AS n_names, sum(delta) AS delta FROM df WHERE change IS NOT NULL GROUP BY ALL", "delta"), **DIFF))
def _(s, d):
    return diff(fr(s, d)).groupBy("Book", "change").agg(F.count(F.lit(1)).alias("n_names"), F.sum("delta").alias("delta"))


@query("srt02_top_changes", sql(tidy_sql("SELECT book, position, change, delta, rk FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY abs(delta) DESC, position) AS rk FROM df WHERE change IS NOT NULL) WHERE rk <= 25", "delta"), **DIFF))
def _(s, d):
    return top_k(diff(fr(s, d)), ["Book"], [F.abs("delta").desc(), "Position"], 25, "rk").select("Book", "Position", "change", "delta", "rk")


@query("set03_entered_exited", sql("""SELECT book, position, 'entered' AS change FROM pos WHERE date = DATE '2000-06-30' AND (book, position) NOT IN (SELECT (book, position) FROM pos WHERE date = DATE '2000-05-31') UNION ALL
    SELECT book, position, 'exited' FROM pos WHERE date = DATE '2000-05-31' AND (book, position) NOT IN (SELECT (book, position) FROM pos WHERE date = DATE '2000-06-30')""", "pos"))
def _(s, d):
    p = fr(s, d).positions
    a, b = (p.filter(F.col("Date") == F.lit(x)).select("Book", "Position") for x in (PREV, ASOF))
    return b.exceptAll(a).withColumn("change", F.lit("entered")).unionByName(a.exceptAll(b).withColumn("change", F.lit("exited")))


@query("win19_previous_book", sql("""SELECT a.book, a.date, coalesce(max(b.date), (SELECT min(date) FROM st c WHERE c.book = a.book)) AS previous FROM st a LEFT JOIN st b ON b.book = a.book AND b.date < a.date AND b.m <> a.m GROUP BY a.book, a.date""",
    st=(("pos",), "SELECT book, date, list(position ORDER BY position) AS m FROM pos GROUP BY ALL")))
def _(s, d):
    return desk.previous_distinct_book(fr(s, d).positions)


@query("mod33_crosscheck_top3", psql("""SELECT book, scenarioset, -quantile_cont(b, 0.01) AS var99, -min(b) AS worst, true AS agrees FROM (SELECT x.book, s.scenarioset, s.day_idx, sum(x.x * s.shock) AS b FROM
    (SELECT p.book, e.factor, sum(p.weight * e.loading) AS x FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY weight DESC, position) AS rk FROM pos WHERE date = DATE '2000-06-30') WHERE rk <= 3) p
     JOIN expo e ON e.date = p.date AND e.position = p.position GROUP BY ALL) x JOIN scn s ON s.factor = x.factor GROUP BY ALL) GROUP BY ALL""", "var99 worst", {}, "pos", "expo", "scn"))
def _(s, d):
    f = fr(s, d)
    p = desk.top_names(f.positions.filter(F.col("Date") == F.lit(ASOF)), 3)
    x = ex.net_exposure(p, f.exposures, ["Book", "Factor"])
    a = ms.ladder(ms.pnl_vectors(x, f.scenarios, ["Book"])).select("Book", "ScenarioSet", "var99", "worst")
    r = desk.array_recompute(x, f.scenarios, ["Book"])
    ok = (F.abs(F.col("var99") - F.col("ref_var99")) < 1e-9) & (F.abs(F.col("worst") - F.col("ref_worst")) < 1e-9)
    return a.join(r, ["Book", "ScenarioSet"]).select("Book", "ScenarioSet", "var99", "worst", ok.alias("agrees"))


@query("mod34_book_summary", psql(f"""SELECT book, 'limits' AS section, metric AS name, value, status FROM ({_CHK}) UNION ALL
    SELECT book, 'risk', 'model_vol', sqrt(bvar + S), NULL FROM (SELECT book, any_value(bvar) AS bvar, any_value(S) AS S FROM mg JOIN sb USING (date, book) GROUP BY book) UNION ALL
    SELECT book, 'variance', 'factor_share', bvar / (bvar + S), NULL FROM (SELECT book, any_value(bvar) AS bvar, any_value(S) AS S FROM mg JOIN sb USING (date, book) GROUP BY book)""", "value", CPOS, "mg", "sp", "sb", "pos", "sec"))
def _(s, d):
    c = desk.check_limits(measured(s, d), limits_df(s), "BUILDING").select("Book", F.lit("limits").alias("section"), F.col("metric").alias("name"), "value", "status")
    p = pivot(fr(s, d), ["Book"], ["Model vol", "Specific variance"], filters={"Date": [ASOF], **HF})
    v = F.col("Model vol")
    share = 1 - F.col("Specific variance") / (v * v)
    k = F.array(F.struct(F.lit("risk").alias("section"), F.lit("model_vol").alias("name"), v.alias("value")),
                F.struct(F.lit("variance").alias("section"), F.lit("factor_share").alias("name"), share.alias("value")))
    r = p.select("Book", F.explode(k).alias("k")).select("Book", "k.*").withColumn("status", F.lit(None).cast("string"))
    return c.unionByName(r)


@query("mod35_artifact_guard", asql("SELECT b.book, CASE WHEN a.n IS NULL THEN 'mismatch' ELSE 'ok' END AS status, coalesce(a.n, 0) AS rows FROM (SELECT DISTINCT book FROM pos) b LEFT JOIN (SELECT book, count(*) AS n FROM art WHERE book <> 'BUILDING' GROUP BY book) a USING (book)", "", "pos", "art"))
def _(s, d):
    a = artifact(s, d).filter(F.col("Book") != "BUILDING")
    return views.artifact_guard(a, fr(s, d).positions.select("Book").distinct())


@query("mod19_residual_diagnostics", asql("""SELECT book, name, value, CASE name WHEN 'ir' THEN CASE WHEN value >= 0.3 THEN 'green' WHEN value <= -0.3 THEN 'red' ELSE 'amber' END
    ELSE CASE WHEN abs(value) < 0.2 THEN 'green' WHEN abs(value) > 0.35 THEN 'red' ELSE 'amber' END END AS status FROM (
    SELECT book, 'ir' AS name, avg(v) / stddev_samp(v) * sqrt(12) AS value FROM um GROUP BY book UNION ALL
    SELECT book, 'autocorr1', corr(v, l) FROM (SELECT book, v, lag(v) OVER (PARTITION BY book ORDER BY month) AS l FROM um) WHERE l IS NOT NULL GROUP BY book UNION ALL
    SELECT book, 'autocorr2', corr(v, l) FROM (SELECT book, v, lag(v, 2) OVER (PARTITION BY book ORDER BY month) AS l FROM um) WHERE l IS NOT NULL GROUP BY book)""", "value", "um",
    um=(("aw",), "SELECT book, last_day(date) AS month, sum(value) AS v FROM aw WHERE kind = 'contribution' AND source = 'Specific' GROUP BY ALL")))
def _(s, d):
    w = at.window_of(artifact(s, d)).filter((F.col("Kind") == "contribution") & (F.col("Source") == "Specific"))
    m = ts.monthly_sum(w, ["Book"], "Date", "Value")
    r = ts.info_ratio(m, ["Book"], "total").select("Book", F.lit("ir").alias("name"), F.col("ir").alias("value"))
    for k in (1, 2):
        r = r.unionByName(ts.autocorr(m, ["Book"], "month", "total", k).select("Book", F.lit(f"autocorr{k}").alias("name"), F.col("autocorr").alias("value")))
    return r.withColumn("status", desk.verdict_rag(F.col("name"), F.col("value"), F.lit(0.3)))
