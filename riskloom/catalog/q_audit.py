"""Windowed descriptor audit, drivers of breaches, and the table of residual verdicts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_attr import LK, PS, T0, T1, _W3, artifact, asql, panel, surprises
from riskloom.catalog.q_build import _GJ, _LAST, _RB, _RR, _X, wide_factors
from riskloom.catalog.q_risk import fr
from riskloom.catalog.registry import query, tidy_sql
from riskloom.operators import attribution as at, audit, drivers
from riskloom.operators.residuals import residual_checks

# ---- descriptor audit: the trailing year at every month-end -----------------------------------------------------------
_E = "(SELECT DISTINCT last_day(date) AS e FROM panel)"
_IN = "date <= e AND {}.date > last_day(CAST(e - INTERVAL 12 MONTH AS DATE))"


@query("mod28_window_pairs", sql(tidy_sql(f"""SELECT * FROM (SELECT e AS date, x.factor AS a, y.factor AS b, corr(x.ret, y.ret) AS rho, count(*) AS n FROM {_E}
    JOIN panel x ON x.{_IN.format('x')} JOIN panel y ON y.date = x.date AND x.factor < y.factor GROUP BY ALL) WHERE abs(rho) >= 0.3 AND n >= 20""", "rho"), "panel"))
def _(s, d):
    return audit.rolling_pairs(panel(fr(s, d)), 0.3)


_WB = {"wb": (("sr", "panel", "pos"), f"""SELECT p.date, p.book, b.position, b.factor, p.weight, c / vx AS beta, (c / vx) / sqrt(greatest(vu - c * c / vx, 0) / (n * vx)) AS t, n FROM
    (SELECT e, s.position, f.factor, count(*) AS n, covar_samp(s.sret, f.ret) AS c, var_samp(f.ret) AS vx, var_samp(s.sret) AS vu FROM {_E} JOIN sr s ON s.{_IN.format('s')}
     JOIN panel f ON f.date = s.date AND f.factor <> 'Market' GROUP BY ALL HAVING count(*) >= 40) b JOIN pos p ON p.position = b.position AND p.date = b.e""")}


def window_betas(s, d):
    f = fr(s, d)
    return audit.rolling_hidden_betas(f.specific_returns, panel(f), f.positions, min_obs=40)


@query("mod28_window_betas", sql(tidy_sql("SELECT * FROM wb", "weight beta t", 5), **_WB), 5)
def _(s, d):
    return window_betas(s, d)


@query("mod28_window_summary", sql(tidy_sql("""SELECT *, book_beta / weight_tested AS wavg_beta, CASE WHEN abs(book_beta) >= 0.10 AND share_sig >= 0.4 THEN 'HIDDEN BETA' WHEN abs(book_beta) >= 0.05 THEN 'watch' ELSE 'ok' END AS flag FROM
    (SELECT date, book, factor, sum(weight * beta) AS book_beta, sum(weight) AS weight_tested, avg(CASE WHEN abs(t) > 2 THEN 1.0::DOUBLE ELSE 0 END) AS share_sig, count(*) AS n_names FROM wb GROUP BY ALL)""",
    "book_beta weight_tested share_sig wavg_beta"), **_WB))
def _(s, d):
    return audit.rolling_beta_summary(window_betas(s, d))


# ---- drivers of breaches -----------------------------------------------------------------------------------------------
def linkage(s, d):
    f = fr(s, d)
    return at.linkage_rows(f, artifact(s, d), panel(f), T0, 3)


@query("mod21_linkage_drivers", asql(
    """SELECT book, name, kind, realized, z, verdict, CASE WHEN verdict <> 'within' AND kind <> 'factor' THEN z ELSE factor_sigma END AS factor_sigma,
       CASE WHEN verdict = 'within' THEN NULL WHEN kind <> 'factor' THEN 'vol_underforecast' WHEN ratio >= 3 AND abs(z_window) <= 2 THEN 'exposure_migration'
       WHEN ratio < 3 AND abs(factor_sigma) >= 1.5 THEN 'factor_move' ELSE 'mixed' END AS driver FROM lka""", "realized z factor_sigma", "lka", **LK))
def _(s, d):
    return drivers.aggregate_drivers(linkage(s, d)).select("Book", "name", "kind", "realized", "z", "verdict", "factor_sigma", "driver")


_BR = {
    "psu": (("pos", "expo", "pcov", "sv", "na", "lkh"), PS),
    "tpf": (("expo", "panel"), f"""SELECT position, factor, pnl FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY abs(pnl) DESC, factor DESC) AS r FROM
        (SELECT e.position, e.factor, e.loading * coalesce(m.moved, 0) AS pnl FROM expo e LEFT JOIN (SELECT factor, sum(ret) AS moved FROM panel WHERE {_W3} GROUP BY factor) m USING (factor)
         WHERE e.date = DATE '{T0}')) WHERE r = 1"""),
    "brd": (("psu", "tpf", "lka"), """SELECT p.book, p.position, weight, realized, factor_pnl, specific_pnl, z, p.verdict, driver, dust, t.factor AS top_factor, t.pnl * weight AS top_pnl,
        l.verdict AS factor_verdict, coalesce(driver IN ('factor_move', 'mixed') AND l.verdict = 'within', false) AS hidden_beta
        FROM psu p LEFT JOIN tpf t USING (position) LEFT JOIN (SELECT book, name, verdict FROM lka WHERE kind = 'factor') l ON l.book = p.book AND l.name = t.factor WHERE p.verdict <> 'within'"""),
}


def breaches(s, d):
    f = fr(s, d)
    return drivers.breach_drivers(surprises(s, d), linkage(s, d), f.exposures, panel(f), T0, T1)


@query("mod21_breach_drivers", asql("SELECT * FROM brd", "weight realized factor_pnl specific_pnl z top_pnl", "brd", **LK, **_BR))
def _(s, d):
    return breaches(s, d)


@query("mod21_breach_comovement", asql(
    f"""SELECT c.*, sh.shared_sector FROM (SELECT book, any_value(nn) AS n_names, any_value(nn * (nn - 1) // 2) AS n_pairs, count(*) AS n_obs, sum(sz * sz - zz) / sum(k * (k - 1)) AS mean_corr,
       CASE WHEN sum(sz * sz - zz) / sum(k * (k - 1)) >= 0.25 THEN 'common_thread' ELSE 'independent' END AS verdict FROM
       (SELECT book, date, sum(z) AS sz, sum(z * z) AS zz, count(*) AS k, any_value(nn) AS nn FROM (SELECT book, date, position, (sret - m) / s AS z, count(DISTINCT position) OVER (PARTITION BY book) AS nn FROM bsr
         JOIN (SELECT book, position, avg(sret) AS m, stddev_pop(sret) AS s FROM bsr GROUP BY ALL HAVING count(*) >= 5) USING (book, position) WHERE s > 0) GROUP BY book, date) WHERE k > 1 GROUP BY book) c
       LEFT JOIN (SELECT book, CASE WHEN k >= 2 THEN sector END AS shared_sector FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY k DESC, sector) AS r FROM
         (SELECT book, sector, count(*) AS k FROM bnm JOIN sec USING (position) GROUP BY ALL)) WHERE r = 1) sh USING (book)""", "mean_corr", "bsr", "bnm", "sec",
    bnm=(("brd",), "SELECT book, position FROM brd WHERE driver IN ('specific_move', 'mixed') AND NOT dust"),
    bsr=(("bnm", "sr"), f"SELECT bnm.book, sr.* FROM sr JOIN bnm USING (position) WHERE {_W3}"), **LK, **_BR))
def _(s, d):
    return drivers.breach_comovement(breaches(s, d), fr(s, d), dt.date.fromisoformat(T0), dt.date.fromisoformat(T1), 5)


# ---- residual verdicts --------------------------------------------------------------------------------------------------
_SP = "kind = 'contribution' AND source = 'Specific'"
_RC = {
    "um": (("aw",), f"SELECT book, last_day(date) AS month, sum(value) AS v FROM aw WHERE {_SP} GROUP BY ALL"),
    "sp1": (("aw", "pvb"), f"""SELECT a.book, a.s / p.p AS value FROM (SELECT book, stddev_samp(value) AS s FROM aw WHERE {_SP} GROUP BY book) a
        JOIN (SELECT b.book, avg(p.svol) AS p FROM (SELECT DISTINCT book, lo, hi FROM aw) b JOIN pvb p ON p.book = b.book AND p.date >= b.lo AND p.date < b.hi GROUP BY b.book) p USING (book)"""),
    "czw": (("aw", "pvb"), """SELECT m.book, CASE WHEN m.source = 'Realized' THEN 'book' ELSE 'specific' END AS block, m.realized / (CASE WHEN m.source = 'Realized' THEN p.bvol ELSE p.svol END * sqrt(m.days)) AS z FROM
        (SELECT book, lo, hi, source, last_day(date) AS month, sum(value) AS realized, count(*) AS days FROM aw WHERE kind = 'contribution' AND source IN ('Realized', 'Specific') GROUP BY ALL) m
        JOIN pvb p ON p.book = m.book AND last_day(CAST(p.date + INTERVAL 1 MONTH AS DATE)) = m.month AND p.date >= m.lo AND p.date < m.hi"""),
    "rr": (("aw", "fr"), _RR[1].replace("FROM art", "FROM aw")), **_GJ, "rb": (("rr", _LAST), _RB[1]),
    "chk": (("um", "sp1", "czw", "rb"), """SELECT book, 'ir' AS name, avg(v) / stddev_samp(v) * sqrt(12) AS value, NULL::DOUBLE AS half_width FROM um GROUP BY book UNION ALL
        SELECT book, 'vol_ratio', value, NULL FROM sp1 UNION ALL
        SELECT book, 'autocorr1', corr(v, l), NULL FROM (SELECT book, v, lag(v) OVER (PARTITION BY book ORDER BY month) AS l FROM um) WHERE l IS NOT NULL GROUP BY book UNION ALL
        SELECT book, 'autocorr2', corr(v, l), NULL FROM (SELECT book, v, lag(v, 2) OVER (PARTITION BY book ORDER BY month) AS l FROM um) WHERE l IS NOT NULL GROUP BY book UNION ALL
        SELECT book, 'r2', 1 - ss / st, NULL FROM rb UNION ALL
        SELECT book, 'bias_' || block, stddev_samp(z), sqrt(2.0 / count(*)) FROM czw GROUP BY book, block HAVING count(*) >= 6"""),
    "chs": (("chk",), """SELECT *, CASE WHEN name = 'ir' THEN CASE WHEN value >= 0.3 THEN 'green' WHEN value <= -0.3 THEN 'red' ELSE 'amber' END
        WHEN name = 'vol_ratio' THEN CASE WHEN value BETWEEN 0.8 AND 1.25 THEN 'green' WHEN value > 1.5 OR value < 0.6 THEN 'red' ELSE 'amber' END
        WHEN name LIKE 'autocorr%' THEN CASE WHEN abs(value) < 0.2 THEN 'green' WHEN abs(value) > 0.35 THEN 'red' ELSE 'amber' END
        WHEN name = 'r2' THEN CASE WHEN value < 0.10 THEN 'green' WHEN value > 0.25 THEN 'red' ELSE 'amber' END
        ELSE CASE WHEN abs(value - 1) <= half_width THEN 'green' WHEN abs(value - 1) > 1.5 * half_width THEN 'red' ELSE 'amber' END END AS status FROM chk"""),
}


@query("mod19_residual_checks", asql("""SELECT * FROM chs UNION ALL SELECT book, 'overall', NULL, NULL,
    CASE max(CASE status WHEN 'red' THEN 2 WHEN 'amber' THEN 1 ELSE 0 END) WHEN 2 THEN 'red' WHEN 1 THEN 'amber' ELSE 'green' END FROM chs GROUP BY book""", "value half_width", "chs", **_RC))
def _(s, d):
    f = fr(s, d)
    return residual_checks(at.window_of(artifact(s, d)), at.predicted_vols(f, panel(f))[0], wide_factors(f, _X), _X)
