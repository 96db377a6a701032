"""The pivot as a matrix with a measure axis, and profiles of loadings."""

from __future__ import annotations

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_attr import T0, artifact, panel
from riskloom.catalog.q_risk import ASOF, HF, cells, fr, psql
from riskloom.catalog.q_series import book_series
from riskloom.catalog.registry import ORACLES, query, snake, tidy_sql
from riskloom.frames import staged
from riskloom.operators import attribution as at, quality as qa, timeseries as ts
from riskloom.plans import grid as gr, views
from riskloom.plans.pivot import pivot
from riskloom.sources.tables import STYLES

_M = ["Net exposure", "% of Scenario VaR 99"]
_F = [*sorted(["Market", *STYLES]), "TOTAL"]
_COLS = {f"{f}{gr.SEP}{m}": (f, m) for f in _F for m in _M}


def _column(f: str, m: str) -> str:
    v = "x" if m == _M[0] else "100 * m_var / bread"
    return f"max(CASE WHEN factor = '{f}' THEN {v} END) AS {snake(f'{f}{gr.SEP}{m}')}"


@query("prj21_measure_grid", psql(f"""SELECT date::VARCHAR AS date, book, sector, {', '.join(_column(*c) for c in _COLS.values())}, sector = 'TOTAL' AS is_total FROM
    (SELECT date, book, coalesce(sector, 'TOTAL') AS sector, coalesce(factor, 'TOTAL') AS factor, sum(x) AS x, sum(m_var) AS m_var, any_value(bread) AS bread
     FROM mgx JOIN cx USING (date, book, sector, factor) GROUP BY GROUPING SETS ((date, book, sector, factor), (date, book, sector), (date, book, factor), (date, book))) GROUP BY date, book, sector""",
    " ".join(snake(c) for c in _COLS), cells("sector factor"), "mgx", "cx"))
def _(s, d):
    p = pivot(fr(s, d), ["Date", "Book", "Sector"], _M, cols=["Factor"], filters=HF, totals=True)
    return gr.grid(p, ["Date", "Book", "Sector"], ["Factor"], _M)


@query("prj21_measures_on_rows", psql("""SELECT book, m.measure, coalesce(sector, 'TOTAL') AS sector, max(CASE WHEN measure = 'Net exposure' THEN x ELSE 100 * m_var / bread END) AS value, sector IS NULL AS is_total FROM
    (SELECT book, sector, sum(x) AS x, sum(m_var) AS m_var, any_value(bread) AS bread FROM mgx JOIN cx USING (date, book, sector) GROUP BY GROUPING SETS ((book, sector), (book)))
    CROSS JOIN (VALUES ('Net exposure'), ('% of Scenario VaR 99')) m(measure) GROUP BY book, m.measure, sector""", "value", cells("sector", date=True), "mgx", "cx"))
def _(s, d):
    p = pivot(fr(s, d), ["Book", "Sector"], _M, filters={"Date": [ASOF], **HF}, totals=True)
    return gr.grid(p, ["Book", gr.MEASURES, "Sector"], [], _M, sort=[("Book", False), ("value", True)])


# ---- profiles of loadings: every factor on every date ------------------------------------------------------------------
_PROF = {"pro": (("expo",), """SELECT *, n_beyond_3 / n AS share_beyond_3 FROM (SELECT date, factor, quantile_cont(loading, 0.01) AS p01, quantile_cont(loading, 0.25) AS p25, quantile_cont(loading, 0.5) AS p50,
    quantile_cont(loading, 0.75) AS p75, quantile_cont(loading, 0.99) AS p99, count(*) AS n, count(*) FILTER (WHERE abs(loading) > 3) AS n_beyond_3, least(min(loading), -3.5) AS lo, greatest(max(loading), 3.5) AS hi
    FROM expo GROUP BY ALL)""")}


@query("ag20_profiles", sql(tidy_sql("SELECT * FROM pro", "p01 p25 p50 p75 p99 lo hi share_beyond_3"), **_PROF))
def _(s, d):
    return qa.factor_profiles(fr(s, d).exposures)


@query("ag20_extremes", sql(tidy_sql("""SELECT date, factor, side, rank, position, coalesce(ticker, position) AS ticker, loading FROM
    (SELECT *, row_number() OVER (PARTITION BY date, factor, side ORDER BY abs(loading) DESC, position) AS rank FROM (SELECT *, CASE WHEN loading > 0 THEN 'high' ELSE 'low' END AS side FROM expo WHERE abs(loading) > 3))
    LEFT JOIN sec USING (position) WHERE rank <= 8""", "loading"), "expo", "sec"))
def _(s, d):
    f = fr(s, d)
    return qa.factor_extremes(f.exposures, f.securities)


@query("ag20_held_overlay", sql(tidy_sql("""SELECT p.date, e.factor, p.book, position, coalesce(ticker, position) AS ticker, p.weight, e.loading, CAST(least(floor((e.loading - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin
    FROM pos p JOIN expo e USING (date, position) JOIN pro ON pro.date = p.date AND pro.factor = e.factor LEFT JOIN sec USING (position)""", "weight loading"), "pos", "sec", **_PROF))
def _(s, d):
    f = fr(s, d)
    return qa.held_overlay(f.exposures, staged(qa.factor_profiles(f.exposures)), f.positions, f.securities)


# ---- the rest of the book summary: backtest, attribution, linkage, data checks ----------------------------------------
def _unpivot(src: str, section: str, names: str, status: str) -> str:
    cols = ", ".join(f"{n}::DOUBLE AS {n}" for n in names.split())
    return (f"SELECT book, '{section}' AS section, name, value, st AS status FROM (UNPIVOT (SELECT book, {status} AS st, {cols} FROM ({ORACLES[src]})) "
            f"ON {', '.join(names.split())} INTO NAME name VALUE value)")


_SECTIONS = " UNION ALL ".join([
    _unpivot("mod14_backtest_fhs", "backtest", "tested exceptions expected rate", "CASE WHEN status <> 'ok' THEN 'insufficient' WHEN kupiec_reject THEN 'reject' ELSE 'ok' END"),
    _unpivot("mod18_headline", "attribution", "realized_geometric factor specific specific_share", "NULL::VARCHAR"),
    f"SELECT book, 'reconcile', name, z, verdict FROM ({ORACLES['mod21_linkage']}) WHERE verdict <> 'within'",
    f"SELECT NULL, 'dq', level, count(*)::DOUBLE, CASE level WHEN 'FAIL' THEN 'fail' WHEN 'WARN' THEN 'warn' ELSE 'pass' END FROM ({ORACLES['mod27_dq_suite']}) GROUP BY level"])


@query("mod34_book_sections", tidy_sql(_SECTIONS, "value"))
def _(s, d):
    f = fr(s, d)
    return views.book_sections(ts.backtest(book_series(f), ["Book"], "i", "r", 250, 0.99, "fhs", 0.94), at.headline(at.window_of(artifact(s, d))),
                               at.linkage_rows(f, artifact(s, d), panel(f), T0, 3), qa.run_checks(f, f.universe))


# ---- what the data checks object to ------------------------------------------------------------------------------------
_T = {"exposures": ("expo", "date position factor"), "positions": ("pos", "date book position"), "securities": ("sec", "position"), "factor_meta": ("fm", "factor"),
      "factor_returns": ("fr", "date factor"), "specific_var": ("sv", "date position")}


def _key(cols: str) -> str:
    return "concat_ws(' / ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in cols.split()) + ")"


_OFF = [q for n, (t, k) in _T.items() for q in (
    f"SELECT '{n}: key unique' AS name, {_key(k)} AS key FROM {t} GROUP BY {k.replace(' ', ', ')} HAVING count(*) > 1",
    f"SELECT '{n}: no null keys', {_key(k)} FROM {t} WHERE {' OR '.join(c + ' IS NULL' for c in k.split())}")]
_OFF += [f"SELECT DISTINCT '{n}.{c.capitalize()} in {u}', {c} FROM {_T[n][0]} WHERE {c} NOT IN (SELECT {c} FROM {_T[u][0]})" for n, c, u in (
    ("exposures", "position", "securities"), ("positions", "position", "securities"), ("specific_var", "position", "securities"), ("exposures", "factor", "factor_meta"), ("factor_returns", "factor", "factor_meta"))]
_OFF += [f"SELECT '{name}', {_key(_T[n][1])} FROM {_T[n][0]} WHERE {cond}" for name, n, cond in (
    ("positions: no negative weights", "positions", "weight < 0"), ("specific_var: non-negative", "specific_var", "sv < 0"),
    ("exposures: loadings within the coverage cap", "exposures", "abs(loading) > 15"), ("factor_returns: |return| <= 50%", "factor_returns", "abs(ret) > 0.5"))]
_OFF += [f"SELECT DISTINCT 'held positions have {n} on the same date', {_key('date position')} FROM pos WHERE (date, position) NOT IN (SELECT (date, position) FROM {_T[n][0]})" for n in ("exposures", "specific_var")]
_DET = {"off": (tuple(t for t, _ in _T.values()), " UNION ALL ".join(_OFF)),
        "det": (("off",), "SELECT name, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY key) AS rank, key FROM off QUALIFY rank <= 5")}


@query("mod27_dq_details", sql("SELECT * FROM det", **_DET))
def _(s, d):
    return qa.check_details(fr(s, d))


@query("mod27_dq_detail_text", sql("""SELECT name, any_value(n) || CASE WHEN any_value(n) = 1 THEN ' row: ' ELSE ' rows: ' END || string_agg(key, '; ' ORDER BY rank) || CASE WHEN any_value(n) > count(*) THEN '; ...' ELSE '' END AS detail
    FROM det GROUP BY name""", **_DET))
def _(s, d):
    return qa.detail_text(qa.check_details(fr(s, d)))
