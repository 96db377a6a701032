"""The artifact store, the stat row of path reports, and long lists rolled up."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import artifacts as ar
from riskloom.catalog.oracle import sql
from riskloom.catalog.q_attr import artifact
from riskloom.catalog.q_build import fitted
from riskloom.catalog.q_risk import HF, cells, fr, psql
from riskloom.catalog.q_sources import landing
from riskloom.catalog.q_universe import HOLD, WORDS, full_span, funnel, holdings, members
from riskloom.catalog.registry import ORACLES, query, tidy_sql
from riskloom.frames import staged
from riskloom.operators import attribution as at, universe as un
from riskloom.plans import views
from riskloom.plans.pivot import pivot

_PARTS = {"pnl_attribution": "SELECT book FROM art", "universe_membership": f"SELECT book FROM ({ORACLES['mod23_membership']})",
          "universe_funnel": f"SELECT '*' AS book FROM ({ORACLES['mod24_funnel']})", "universe_span": f"SELECT book FROM ({ORACLES['mod25_span']})",
          "universe_drift": "SELECT book FROM xb", "regression_stats": f"SELECT '*' AS book FROM ({ORACLES['mod03_fit_statistics']})"}


def _store_sql() -> str:
    from riskloom.catalog.q_attr import asql

    return asql("SELECT artifact, book, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS artifact, book FROM ({q})" for a, q in _PARTS.items()) + ") GROUP BY ALL", "", "art", "xb")


@query("src14_artifact_store", _store_sql())
def _(s, d):
    """Every artifact written as a build; one book of the drift rebuilt; what the manifest then has, read and counted."""
    f, folder = fr(s, d), landing(s, "store")
    drift = at.book_factor_exposure(f)
    for name, df in {"pnl_attribution": artifact(s, d), "universe_membership": members(s, d), "universe_funnel": funnel(s, d),
                     "universe_span": full_span(s, d), "universe_drift": drift, "regression_stats": fitted(s, d)}.items():
        ar.write_artifact(df, folder, name)
    ar.write_artifact(drift.filter("Book = 'BUILDING'"), folder, "universe_drift")
    out = None
    for name in ar.ARTIFACTS:
        a = ar.read_artifact(s, folder, name)
        book = F.col("Book") if "Book" in a.columns else F.lit(ar.SHARED)
        n = a.groupBy(book.alias("book")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "book", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("vec24_path_stats", psql("SELECT date, book, scenarioset, -var99 AS var_line, -worst AS worst_pnl, worst_date, mean AS mean_pnl FROM lad", "var_line worst_pnl mean_pnl", cells("", sets=""), "lad"))
def _(s, d):
    return views.path_stats(fr(s, d))


@query("qry12_top20_rest", psql("""SELECT date, book, CASE WHEN rk <= 20 THEN position ELSE 'rest' END AS name, sum(m_cov + coalesce(svar, 0)) AS value, count(*) AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY date, book ORDER BY round(abs(m_cov + coalesce(svar, 0)), 12) DESC, position) AS rk FROM mgx JOIN sp USING (date, book, position)) GROUP BY ALL""", "value", cells("position"), "mgx", "sp"))
def _(s, d):
    p = pivot(fr(s, d), ["Date", "Book", "Position"], ["Factor variance contribution", "Specific variance"], filters=HF)
    v = p.select("Date", "Book", "Position", (F.col("Factor variance contribution") + F.coalesce("Specific variance", F.lit(0.0))).alias("v"))
    return views.top_and_rest(v, ["Date", "Book"], "Position", "v", 20)


# ---- managers with their disclosure: what was parsed, dropped as pooled, and left -------------------------------------
_MG = {"hold": HOLD, "mgd": (("hold", "mgr"), r"""SELECT m.book, m.cik, m.entityname, m.firmtype, h.* EXCLUDE (book) FROM mgr m JOIN (SELECT h.book, min(filing_date) AS first_filing_date, max(filing_date) AS last_filing_date,
    count(DISTINCT filing_date) AS n_filings, count(DISTINCT cusip) AS n_distinct_cusips_parsed, coalesce(sum(value) FILTER (WHERE pool AND report_date = last), 0) / sum(value) FILTER (WHERE report_date = last) AS dropped_value_share_latest,
    count(DISTINCT cusip) FILTER (WHERE NOT pool) AS n_positions_distinct FROM (SELECT *, regexp_matches(upper(issuer), '\bRING\b|\bBOLT\b') AS pool FROM hold) h
    JOIN (SELECT book, max(report_date) AS last FROM hold GROUP BY book) l ON l.book = h.book GROUP BY h.book) h USING (book)""")}


def managers(s, d):
    return un.manager_frame(holdings(s, d), fr(s, d).managers, WORDS)


@query("ag23_manager_disclosure", sql(tidy_sql("SELECT * FROM mgd", "dropped_value_share_latest"), **_MG))
def _(s, d):
    return managers(s, d)


@query("ag16_manager_etp_share", sql(tidy_sql("""SELECT x.date, x.book, m.entityname, m.dropped_value_share_latest AS manager_etp_dropped_value_share, m.n_positions_distinct AS manager_n_positions
    FROM (SELECT DISTINCT date, book FROM xb) x JOIN mgd m USING (book)""", "manager_etp_dropped_value_share"), "xb", **_MG))
def _(s, d):
    f = fr(s, d)
    return pivot(f.replace(managers=staged(managers(s, d))), ["Date", "Book", "EntityName"], ["Manager ETP dropped value share", "Manager n positions"])
