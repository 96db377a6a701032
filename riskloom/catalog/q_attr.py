"""Realized attribution, linking, diagnostics and the risk-to-P&L linkage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_risk import AS, ASOF, fr, psql, cells
from riskloom.catalog.registry import query, tidy_sql
from riskloom.frames import Frames, materialized
from riskloom.operators import attribution as at, scenarios as sc, timeseries as ts
from riskloom.plans.pivot import pivot

AT: dict[str, tuple[tuple[str, ...], str]] = {
    "ends": (("expo",), "SELECT DISTINCT date AS e FROM expo"),
    "days": (("fr", "ends"), "SELECT f.day, max(e) AS d0 FROM (SELECT DISTINCT date AS day FROM fr) f JOIN ends ON e < day GROUP BY day"),
    "ffr": (("fr", "days"), "SELECT d0 AS date, factor, sum(ret) AS fwd FROM fr JOIN days ON day = date GROUP BY ALL"),
    "fsr": (("sr", "days"), "SELECT d0 AS date, position, sum(sret) AS fwd FROM sr JOIN days ON day = date GROUP BY ALL"),
    "wmap": (("pos",), "SELECT book, date, list((position, round(weight, 12)) ORDER BY position) AS m FROM pos GROUP BY ALL"),
    "anc": (("wmap",), """SELECT book, date AS anchor, lead(date) OVER (PARTITION BY book ORDER BY date) AS nxt FROM
        (SELECT *, lag(m) OVER (PARTITION BY book ORDER BY date) AS pm FROM wmap) WHERE pm IS NULL OR pm <> m"""),
    "rdays": (("anc", "days"), "SELECT book, anchor, d0, day FROM anc JOIN days ON day > anchor AND (nxt IS NULL OR day <= nxt)"),
    "nr": (("sr", "days", "expo", "fr"), """SELECT s.position, s.date AS day, d.d0, any_value(s.sret) AS eps,
        any_value(s.sret) + sum(coalesce(e.loading * f.ret, 0)) AS r FROM sr s JOIN days d ON d.day = s.date
        JOIN expo e ON e.date = d.d0 AND e.position = s.position LEFT JOIN fr f ON f.date = s.date AND f.factor = e.factor
        GROUP BY s.position, s.date, d.d0"""),
    "dw": (("pos", "nr", "rdays"), """SELECT p.book, rd.anchor, p.position, rd.day, rd.d0, p.weight AS w0, n.r, n.eps, p.weight * exp(coalesce(sum(ln(1 + n.r))
        OVER (PARTITION BY p.book, rd.anchor, p.position ORDER BY rd.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS val
        FROM pos p JOIN rdays rd ON rd.book = p.book AND rd.anchor = p.date JOIN nr n ON n.position = p.position AND n.day = rd.day"""),
    "dd": (("rdays", "dw", "pos"), """SELECT d.book, d.anchor, d.d0, d.day, coalesce(gain, 0) AS gain, coalesce(spec, 0) AS spec, coalesce(priced, 0) AS priced,
        b.w0 + coalesce(sum(gain) OVER (PARTITION BY d.book, d.anchor ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total
        FROM rdays d LEFT JOIN (SELECT book, anchor, day, sum(val * r) AS gain, sum(val * eps) AS spec, sum(val) AS priced FROM dw GROUP BY ALL) g
        ON g.book = d.book AND g.anchor = d.anchor AND g.day = d.day
        JOIN (SELECT book, date, sum(weight) AS w0 FROM pos GROUP BY ALL) b ON b.book = d.book AND b.date = d.anchor"""),
    "dx": (("dd", "dw", "expo", "fr"), """SELECT d.book, d.day, f.factor, coalesce(x.vx, 0) / d.total AS x, f.ret FROM dd d JOIN fr f ON f.date = d.day
        SEMI JOIN (SELECT DISTINCT date, factor FROM expo) q ON q.date = d.d0 AND q.factor = f.factor
        LEFT JOIN (SELECT w.book, w.anchor, w.day, e.factor, sum(w.val * e.loading) AS vx FROM dw w JOIN expo e ON e.date = w.d0 AND e.position = w.position GROUP BY ALL) x
        ON x.book = d.book AND x.anchor = d.anchor AND x.day = d.day AND x.factor = f.factor"""),
    "art": (("dd", "dx", "dw", "pos", "rdays"), """SELECT book, day AS date, 'contribution' AS kind, 'Specific' AS source, spec / total AS value FROM dd
        UNION ALL SELECT book, day, 'contribution', 'Realized', gain / total FROM dd
        UNION ALL SELECT book, day, 'coverage', 'priced_share', priced / total FROM dd
        UNION ALL SELECT book, day, 'contribution', factor, x * ret FROM dx UNION ALL SELECT book, day, 'exposure', factor, x FROM dx
        UNION ALL SELECT p.book, p.date, 'unpriced', replace(p.position, 'P', 't'), p.weight FROM pos p
        SEMI JOIN rdays r ON r.book = p.book AND r.anchor = p.date
        ANTI JOIN dw w ON w.book = p.book AND w.anchor = p.date AND w.position = p.position"""),
    "aw": (("art",), """SELECT a.*, lo, hi FROM art a JOIN (SELECT book, max(date) AS hi, max(date) - INTERVAL 12 MONTH AS lo FROM art WHERE kind = 'contribution' GROUP BY book) b
        ON b.book = a.book AND a.date BETWEEN lo AND hi"""),
    "car": (("aw",), """SELECT c.book, c.source, sum(c.value * CASE WHEN abs(r.value) > 1e-12 THEN ln(1 + r.value) / r.value ELSE 1 END)
        / any_value(CASE WHEN abs(rg) > 1e-12 THEN ln(1 + rg) / rg ELSE 1 END) AS linked, any_value(rg) AS rg
        FROM aw c JOIN aw r ON r.book = c.book AND r.date = c.date AND r.kind = 'contribution' AND r.source = 'Realized'
        JOIN (SELECT book, exp(sum(ln(1 + value))) - 1 AS rg FROM aw WHERE kind = 'contribution' AND source = 'Realized' GROUP BY book) g ON g.book = c.book
        WHERE c.kind = 'contribution' AND c.source <> 'Realized' GROUP BY ALL"""),
    "na": (("pos", "expo", "ffr", "fsr"), """SELECT p.book, p.position, p.date, p.weight * coalesce(f.fac, 0) AS factor_pnl, p.weight * coalesce(s.fwd, 0) AS specific_pnl
        FROM pos p LEFT JOIN (SELECT e.date, e.position, sum(e.loading * f.fwd) AS fac FROM expo e JOIN ffr f ON f.date = e.date AND f.factor = e.factor GROUP BY ALL) f
        ON f.date = p.date AND f.position = p.position LEFT JOIN fsr s ON s.date = p.date AND s.position = p.position"""),
    "pc2": (("panel",), "SELECT a.date, a.factor, b.factor AS f2, a.ret AS r1, b.ret AS r2 FROM panel a JOIN panel b ON a.date = b.date"),
    "pcov": (("pc2", "ends"), """SELECT e AS date, factor, f2, covar_samp(r1, r2) AS cov FROM ends JOIN pc2 ON pc2.date <= e
        GROUP BY ALL HAVING count(*) >= 60"""),
    "pvf": (("xb", "pcov"), """SELECT x.date, x.book, c.f2 AS factor, sum(x.x * c.cov) AS fx, max(CASE WHEN c.factor = c.f2 THEN sqrt(c.cov) END) AS sigma
        FROM xb x JOIN pcov c ON c.date = x.date AND c.factor = x.factor GROUP BY ALL"""),
    "pvj": (("pvf", "xb"), "SELECT v.*, x.x, abs(x.x) * sigma AS fvol FROM pvf v JOIN xb x ON x.date = v.date AND x.book = v.book AND x.factor = v.factor"),
    "pvb": (("pvj", "pos", "sv"), """SELECT v.*, s.svar, sqrt(fv + s.svar) AS bvol, sqrt(s.svar) AS svol FROM
        (SELECT date, book, sum(x * fx) AS fv, sum(x * sigma) AS sxs FROM pvj GROUP BY ALL) v JOIN (SELECT p.date, p.book, sum(p.weight * p.weight * coalesce(v.sv, 0)) AS svar
        FROM pos p LEFT JOIN sv v ON v.date = p.date AND v.position = p.position GROUP BY ALL) s ON s.date = v.date AND s.book = v.book"""),
    "calz": (("art", "pvb"), """SELECT m.book, CASE WHEN m.source = 'Realized' THEN 'book' ELSE 'specific' END AS block, m.month, m.realized,
        CASE WHEN m.source = 'Realized' THEN p.bvol ELSE p.svol END * sqrt(m.days) AS predicted FROM
        (SELECT book, source, last_day(date) AS month, sum(value) AS realized, count(*) AS days FROM art WHERE kind = 'contribution' AND source IN ('Realized', 'Specific') GROUP BY ALL) m
        JOIN pvb p ON p.book = m.book AND last_day(CAST(p.date + INTERVAL 1 MONTH AS DATE)) = m.month"""),
}


def asql(body: str, doubles: str, *need: str, digits: int = 6, **extra) -> str:
    local: dict = {}
    every = {**AT, **extra}

    def add(n):
        if n in every and n not in local:
            for dep in every[n][0]:
                add(dep)
            local[n] = every[n]

    for n in (*need, *extra):
        add(n)
    return sql(tidy_sql(body, doubles, digits), *[n for n in need if n not in every], **local)


def artifact(s, d):
    """The attribution artifact, written once per application and read back."""
    f = fr(s, d)
    return materialized(s, d.strip("/").replace("/", "_") + "/pnl_attribution", lambda: at.compute_attribution(f))


def panel(f):
    return sc.complete_panel(f.factor_returns)


@query("jn08_owner_month", asql("SELECT f.date, f.factor, d.d0 FROM fr f JOIN days d ON d.day = f.date", "", "fr", "days"))
def _(s, d):
    from riskloom.functions.joins import owner_month

    f = fr(s, d)
    return owner_month(f.factor_returns, f.exposures.select("Date").distinct()).select("Date", "Factor", "d0")


@query("ag14_forward_returns", asql("SELECT date, factor AS member, fwd FROM ffr UNION ALL SELECT date, position, fwd FROM fsr", "fwd", "ffr", "fsr", digits=12), 12)
def _(s, d):
    f = fr(s, d)
    a = at.forward_factor_returns(f).withColumnRenamed("Factor", "member")
    return a.unionByName(at.forward_specific_returns(f).withColumnRenamed("Position", "member"))


@query("ag15_contribution_by_sector", asql(
    """SELECT date, book, sector, sum(factor_pnl) AS factor_contribution, sum(sp) AS specific_pnl, sum(factor_pnl) + coalesce(sum(sp), 0) AS realized_pnl
       FROM (SELECT n.*, CASE WHEN s.fwd IS NOT NULL THEN n.specific_pnl END AS sp FROM na n LEFT JOIN fsr s ON s.date = n.date AND s.position = n.position)
       JOIN sec USING (position) GROUP BY ALL""", "factor_contribution specific_pnl realized_pnl", "na", "fsr", "sec"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Sector"], ["Factor contribution", "Specific PnL", "Realized PnL"])


@query("ag15_contribution_by_factor", asql(
    "SELECT x.date, x.book, x.factor, x.x * coalesce(f.fwd, 0) AS factor_contribution FROM xb x LEFT JOIN ffr f ON f.date = x.date AND f.factor = x.factor",
    "factor_contribution", "xb", "ffr"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book", "Factor"], ["Factor contribution"])


@query("win18_weight_regimes", asql("SELECT book, anchor FROM anc", "", "anc"))
def _(s, d):
    return at.weight_regimes(fr(s, d).positions).select("Book", "anchor").distinct()


@query("win17_drifting_weights", asql(
    "SELECT w.book, w.position, w.day, w.val / d.total AS weight FROM dw w JOIN dd d ON d.book = w.book AND d.anchor = w.anchor AND d.day = w.day",
    "weight", "dw", "dd"))
def _(s, d):
    f = fr(s, d)
    v = at.drifting_weights(f)
    g = v.groupBy("Book", "anchor", "Day").agg(F.sum(F.col("val") * F.col("R")).alias("gain"))
    b = f.positions.groupBy("Book", F.col("Date").alias("anchor")).agg(F.sum("Weight").alias("W0"))
    w = Window.partitionBy("Book", "anchor").orderBy("Day").rowsBetween(Window.unboundedPreceding, -1)
    t = g.join(b, ["Book", "anchor"]).withColumn("total", F.col("W0") + F.coalesce(F.sum("gain").over(w), F.lit(0.0)))
    return (v.join(t, ["Book", "anchor", "Day"])
            .select("Book", "Position", "Day", (F.col("val") / F.col("total")).alias("weight")))


@query("mod16_attribution", asql("SELECT * FROM art", "value", "art"))
def _(s, d):
    return artifact(s, d)


@query("mod17_carino_linking", asql("SELECT book, source, linked, rg FROM car", "linked rg", "car"))
def _(s, d):
    return at.carino(at.window_of(artifact(s, d)))


@query("mod18_headline", asql(
    """SELECT c.*, specific / realized_geometric AS specific_share, n_days, mean_priced_share, min_priced_share FROM
       (SELECT book, max(rg) AS realized_geometric, sum(linked) FILTER (WHERE source <> 'Specific') AS factor, sum(linked) FILTER (WHERE source = 'Specific') AS specific FROM car GROUP BY book) c
       JOIN (SELECT book, count(*) AS n_days, avg(value) AS mean_priced_share, min(value) AS min_priced_share FROM aw WHERE kind = 'coverage' GROUP BY book) USING (book)""",
    "realized_geometric factor specific specific_share mean_priced_share min_priced_share", "car", "aw"))
def _(s, d):
    return at.headline(at.window_of(artifact(s, d)))


@query("mod18_by_factor", asql(
    """SELECT c.book, c.source AS factor, x.ax AS avg_exposure, coalesce(f.cf, 0) AS cum_factor_return, c.linked AS contribution, c.linked / c.rg AS pct_of_total,
       t.m / t.s * sqrt(t.n) AS t_stat FROM car c JOIN (SELECT book, source, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM aw WHERE kind = 'contribution' GROUP BY ALL) t
       ON t.book = c.book AND t.source = c.source JOIN (SELECT book, source, avg(value) AS ax FROM aw WHERE kind = 'exposure' GROUP BY ALL) x ON x.book = c.book AND x.source = c.source
       LEFT JOIN (SELECT book, factor, sum(ret) AS cf FROM fr JOIN (SELECT DISTINCT book, lo, hi FROM aw) ON date BETWEEN lo AND hi GROUP BY ALL) f ON f.book = c.book AND f.factor = c.source
       WHERE c.source <> 'Specific'""", "avg_exposure cum_factor_return contribution pct_of_total t_stat", "car", "aw", "fr"))
def _(s, d):
    return at.by_factor(at.window_of(artifact(s, d)), fr(s, d).factor_returns)


@query("win20_cumulative_series", asql(
    """SELECT book, date, sum(market) OVER w AS market, sum(style) OVER w AS style, sum(specific) OVER w AS specific, sum(realized) OVER w AS realized FROM
       (SELECT book, date, sum(CASE WHEN source = 'Market' THEN value ELSE 0 END) AS market, sum(CASE WHEN source NOT IN ('Market', 'Specific', 'Realized') THEN value ELSE 0 END) AS style,
        sum(CASE WHEN source = 'Specific' THEN value ELSE 0 END) AS specific, sum(CASE WHEN source = 'Realized' THEN value ELSE 0 END) AS realized
        FROM aw WHERE kind = 'contribution' GROUP BY ALL) WINDOW w AS (PARTITION BY book ORDER BY date)""", "market style specific realized", "aw"))
def _(s, d):
    return at.cumulative_series(at.window_of(artifact(s, d)))


LO, HI = dt.date(2000, 6, 30), dt.date(2001, 6, 30)
_NAW = "FROM na WHERE date >= DATE '2000-06-30' AND date < DATE '2001-06-30'"


@query("mod18_by_name", asql(f"""SELECT book, position, factor_pnl, specific_pnl, realized, rank FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY abs(realized) DESC, position) AS rank FROM
    (SELECT book, position, sum(factor_pnl) AS factor_pnl, sum(specific_pnl) AS specific_pnl, sum(factor_pnl) + sum(specific_pnl) AS realized {_NAW} GROUP BY ALL))""",
    "factor_pnl specific_pnl realized", "na"))
def _(s, d):
    return at.ranked_names(at.name_attribution(fr(s, d), LO, HI))


@query("ag17_concentration", asql(f"""SELECT book, sum(a * a) / power(sum(a), 2) AS hhi, sum(a) FILTER (WHERE rk <= 5) / sum(a) AS top5_share, count(*) AS n FROM
    (SELECT book, abs(s) AS a, row_number() OVER (PARTITION BY book ORDER BY abs(s) DESC) AS rk FROM (SELECT book, position, sum(specific_pnl) AS s {_NAW} GROUP BY ALL)) GROUP BY book""",
    "hhi top5_share", "na"))
def _(s, d):
    return at.concentration(at.name_attribution(fr(s, d), LO, HI), ["Book"], "specific_pnl")


@query("mod32_winners_losers", asql(f"""SELECT book, position, specific_pnl, months, persistence, hit_rate, side FROM (
    SELECT *, 'winner' AS side, row_number() OVER (PARTITION BY book ORDER BY specific_pnl DESC, position) AS rk FROM q UNION ALL
    SELECT *, 'loser', row_number() OVER (PARTITION BY book ORDER BY specific_pnl, position) FROM q) WHERE rk <= 10""",
    "specific_pnl persistence hit_rate", "q", q=(("na",), f"""SELECT book, position, sum(v) AS specific_pnl, count(*) AS months,
    CASE WHEN count(*) > 3 THEN avg(CASE WHEN l IS NOT NULL THEN CASE WHEN sign(v) = sign(l) THEN 1.0::DOUBLE ELSE 0 END END) END AS persistence,
    avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM (SELECT book, position, specific_pnl AS v,
    lag(specific_pnl) OVER (PARTITION BY book, position ORDER BY date) AS l {_NAW}) GROUP BY ALL""")))
def _(s, d):
    from riskloom.functions.quantiles import top_k

    m = at.name_attribution(fr(s, d), LO, HI, monthly=True)
    p = ts.sign_persistence(m, ["Book", "Position"], "Date", "specific_pnl")
    n = m.groupBy("Book", "Position").agg(F.sum("specific_pnl").alias("specific_pnl")).join(p, ["Book", "Position"])
    w = top_k(n, ["Book"], [F.col("specific_pnl").desc(), "Position"], 10, "rk").withColumn("side", F.lit("winner"))
    lo = top_k(n, ["Book"], [F.col("specific_pnl").asc(), "Position"], 10, "rk").withColumn("side", F.lit("loser"))
    return w.unionByName(lo).drop("rk")


@query("mod22_predicted_vols", asql("SELECT date, book, bvol AS book_vol, svol AS specific_vol FROM pvb", "book_vol specific_vol", "pvb"))
def _(s, d):
    f = fr(s, d)
    return at.predicted_vols(f, panel(f))[0].select("Date", "Book", "book_vol", "specific_vol")


@query("mod22_predicted_factor_vols", asql("SELECT date, book, factor, fvol AS factor_vol FROM pvj", "factor_vol", "pvj"))
def _(s, d):
    f = fr(s, d)
    return at.predicted_vols(f, panel(f))[1].select("Date", "Book", "Factor", "factor_vol")


@query("mod22_calibration", asql(
    """SELECT book, block, month, realized, predicted, realized / predicted AS z FROM calz""", "realized predicted z", "calz"))
def _(s, d):
    f = fr(s, d)
    return at.calibration(artifact(s, d), at.predicted_vols(f, panel(f))[0])


@query("mod22_rolling_bias", asql(
    """SELECT book, block, month, b, sqrt(2.0 / 24) AS band FROM (SELECT book, block, month, stddev_samp(realized / predicted) OVER w AS b, count(*) OVER w AS n FROM calz
       WINDOW w AS (PARTITION BY book, block ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE n = 24""", "b band", "calz"))
def _(s, d):
    f = fr(s, d)
    return ts.rolling_bias(at.calibration(artifact(s, d), at.predicted_vols(f, panel(f))[0]), ["Book", "block"], "month")


@query("jn15_pit_covariance", asql("SELECT date, factor, f2 AS factor2, cov FROM pcov", "cov", "pcov", digits=9), 9)
def _(s, d):
    return at.pit_covariance(panel(fr(s, d))).drop("n")


T0, T1 = "2000-12-31", "2001-03-31"
_W3 = f"date > DATE '{T0}' AND date <= DATE '{T1}'"
LK = {
    "lkh": (("art",), f"SELECT book, count(*) AS h FROM art WHERE kind = 'contribution' AND source = 'Realized' AND {_W3} GROUP BY book"),
    "lkr": (("art",), f"SELECT book, source, sum(value) AS realized FROM art WHERE kind = 'contribution' AND {_W3} GROUP BY ALL"),
    "lkx": (("art",), f"SELECT book, source, avg(value) AS xw FROM art WHERE kind = 'exposure' AND {_W3} GROUP BY ALL"),
    "lkc": (("panel",), f"SELECT factor, sum(ret) AS cf FROM panel WHERE {_W3} GROUP BY factor"),
    "lkf": (("pvj", "pvb", "lkh", "lkr", "lkx", "lkc"), f"""SELECT f.book, f.factor AS name, 'factor' AS kind, f.x AS exposure, x.xw AS x_win,
        f.fvol / (sum(f.fvol) OVER (PARTITION BY f.book) + b.svol) AS risk_share, r.realized, f.fvol * sqrt(h.h) AS sd_base, f.fvol * sqrt(h.h) * 1.25 AS sd_stressed,
        c.cf / (f.sigma * sqrt(h.h)) AS factor_sigma, r.realized / (abs(x.xw) * f.sigma * sqrt(h.h)) AS z_window, abs(x.xw) / greatest(abs(f.x), 1e-9) AS ratio
        FROM pvj f JOIN pvb b ON b.date = f.date AND b.book = f.book JOIN lkh h ON h.book = f.book JOIN lkr r ON r.book = f.book AND r.source = f.factor
        JOIN lkx x ON x.book = f.book AND x.source = f.factor JOIN lkc c ON c.factor = f.factor WHERE f.date = DATE '{T0}'"""),
    "lkb": (("pvj", "pvb", "lkh", "lkr"), f"""SELECT b.book, k.name, k.kind, NULL AS exposure, NULL AS x_win, CASE WHEN k.kind = 'book' THEN 1.0 ELSE b.svol / (sa.sa + b.svol) END AS risk_share,
        r.realized, CASE WHEN k.kind = 'book' THEN b.bvol ELSE b.svol END * sqrt(h.h) AS sd_base,
        CASE WHEN k.kind = 'book' THEN 1.25 * sqrt(0.25 * b.fv + 0.75 * b.sxs * b.sxs + b.svar) ELSE b.svol * 1.25 END * sqrt(h.h) AS sd_stressed,
        NULL AS factor_sigma, NULL AS z_window, NULL AS ratio FROM pvb b JOIN lkh h ON h.book = b.book
        JOIN (SELECT book, date, sum(fvol) AS sa FROM pvj GROUP BY ALL) sa ON sa.book = b.book AND sa.date = b.date
        CROSS JOIN (VALUES ('Specific', 'specific', 'Specific'), ('Book total', 'book', 'Realized')) k(name, kind, src)
        JOIN lkr r ON r.book = b.book AND r.source = k.src WHERE b.date = DATE '{T0}'"""),
    "lka": (("lkf", "lkb"), """SELECT *, realized / sd_base AS z, CASE WHEN abs(realized) <= 2 * sd_base THEN 'within' WHEN abs(realized) <= 2 * sd_stressed THEN 'stress' ELSE 'investigate' END AS verdict
        FROM (SELECT * FROM lkf UNION ALL SELECT * FROM lkb)"""),
}


@query("mod21_linkage", asql(
    """SELECT *, CASE WHEN verdict = 'within' OR kind <> 'factor' THEN NULL WHEN ratio >= 3 AND abs(z_window) <= 2 THEN 'exposure_migration'
       WHEN ratio < 3 AND abs(factor_sigma) >= 1.5 THEN 'factor_move' ELSE 'mixed' END AS driver FROM lka""",
    "exposure x_win risk_share realized sd_base sd_stressed factor_sigma z_window ratio z", "lka", **LK))
def _(s, d):
    f = fr(s, d)
    return at.linkage_rows(f, artifact(s, d), panel(f), T0, 3)


#: names at T0 against their own band
PS = f"""SELECT book, position, weight, w_win, realized, factor_pnl, specific_pnl, sd_base, realized / sd_base AS z, verdict,
       CASE WHEN verdict = 'within' THEN NULL WHEN (ratio >= 3 OR ratio <= 1.0/3.0) AND abs(realized / (sd_base * ratio)) <= 2 THEN 'weight_migration'
       WHEN abs(specific_pnl) / (abs(factor_pnl) + abs(specific_pnl)) >= 0.65 THEN 'specific_move' WHEN abs(specific_pnl) / (abs(factor_pnl) + abs(specific_pnl)) <= 0.35 THEN 'factor_move'
       ELSE 'mixed' END AS driver, weight < 0.001 AS dust FROM (SELECT *, abs(w_win) / greatest(abs(weight), 1e-9) AS ratio,
       CASE WHEN abs(realized) <= 2 * sd_base THEN 'within' WHEN abs(realized) <= 2.5 * sd_base THEN 'stress' ELSE 'investigate' END AS verdict FROM
       (SELECT p.book, p.position, p.weight, w.w_win, n.f + n.s AS realized, n.f AS factor_pnl, n.s AS specific_pnl,
        abs(p.weight) * sqrt(coalesce(v.lfl, 0) + coalesce(sv.sv, 0)) * sqrt(h.h) AS sd_base FROM pos p JOIN lkh h ON h.book = p.book
        LEFT JOIN (SELECT a.position, sum(a.loading * c.cov * b.loading) AS lfl FROM expo a JOIN pcov c ON c.date = a.date AND c.factor = a.factor
          JOIN expo b ON b.date = a.date AND b.position = a.position AND b.factor = c.f2 WHERE a.date = DATE '{T0}' GROUP BY ALL) v ON v.position = p.position
        LEFT JOIN sv ON sv.date = p.date AND sv.position = p.position
        JOIN (SELECT book, position, sum(factor_pnl) AS f, sum(specific_pnl) AS s FROM na WHERE date >= DATE '{T0}' AND date < DATE '{T1}' GROUP BY ALL) n ON n.book = p.book AND n.position = p.position
        JOIN (SELECT book, position, sum(weight) / 3 AS w_win FROM pos WHERE date >= DATE '{T0}' AND date < DATE '{T1}' GROUP BY ALL) w ON w.book = p.book AND w.position = p.position
        WHERE p.date = DATE '{T0}'))"""


@query("mod21_position_surprises", asql(
    PS, "weight w_win realized factor_pnl specific_pnl sd_base z", "pos", "expo", "pcov", "sv", "na", lkh=LK["lkh"]))
def surprises(s, d):
    f = fr(s, d)
    a = artifact(s, d)
    h = (a.filter((F.col("Kind") == "contribution") & (F.col("Source") == "Realized") & (F.col("Date") > T0) & (F.col("Date") <= T1))
         .groupBy("Book").agg(F.count(F.lit(1)).alias("h")))
    return at.position_surprises(f, a, panel(f), T0, T1, h)


@query("mod21_comovement", asql(
    """SELECT book, any_value(nn) AS n_names, any_value(nn * (nn - 1) // 2) AS n_pairs, count(*) AS n_obs, sum(sz * sz - zz) / sum(k * (k - 1)) AS mean_corr,
       CASE WHEN sum(sz * sz - zz) / sum(k * (k - 1)) >= 0.25 THEN 'common_thread' ELSE 'independent' END AS verdict FROM
       (SELECT book, date, sum(z) AS sz, sum(z * z) AS zz, count(*) AS k, any_value(nn) AS nn FROM (SELECT *, count(DISTINCT source) OVER (PARTITION BY book) AS nn FROM
         (SELECT a.book, a.date, a.source, (a.value - t.m) / t.s AS z FROM aw a JOIN (SELECT book, source, avg(value) AS m, stddev_pop(value) AS s FROM aw
          WHERE kind = 'contribution' AND source <> 'Realized' GROUP BY ALL HAVING count(value) >= 20) t ON t.book = a.book AND t.source = a.source
          WHERE a.kind = 'contribution' AND a.source <> 'Realized' AND t.s > 0 AND a.value IS NOT NULL)) GROUP BY book, date) WHERE k > 1 GROUP BY book""", "mean_corr", "aw"))
def _(s, d):
    w = at.window_of(artifact(s, d)).filter((F.col("Kind") == "contribution") & (F.col("Source") != "Realized"))
    sr = w.select("Book", "Date", F.concat_ws("|", "Book", "Source").alias("Position"), F.col("Value").alias("SpecificReturn"))
    return at.comovement(sr.drop("Book"), sr.select("Book", "Position").distinct(), dt.date(1990, 1, 1), dt.date(2030, 1, 1))
