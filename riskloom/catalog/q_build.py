"""Builder queries: descriptors, standardisation, regressions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from riskloom.catalog import regression_sql
from riskloom.catalog.oracle import solved, sql
from riskloom.catalog.q_attr import AT, artifact, asql
from riskloom.catalog.q_risk import fr
from riskloom.catalog.q_series import BETA, daily_betas, proxy
from riskloom.catalog.registry import query, tidy_sql
from riskloom.frames import materialized
from riskloom.functions.joins import asof_join
from riskloom.operators import descriptors as de, regression as rg, timeseries as ts
from riskloom.sources.tables import STYLES

DAILY = (("mom", "px"), """SELECT m.position, m.date, CASE WHEN n >= 120 THEN csm / vm END AS beta,
    CASE WHEN n >= 120 THEN sqrt(252) * sqrt(vs - csm * csm / vm) END AS residvol,
    CASE WHEN n >= 120 THEN (cst - ctm * csm / vm) / (vt - ctm * ctm / vm) END AS ratebeta,
    CASE WHEN n >= 120 THEN (csx - cxm * csm / vm) / (vx - cxm * cxm / vm) END AS ndxbeta, p.momentum, p.logadv, p.close FROM mom m
    JOIN (SELECT position, date, close, ln(lag(close, 20) OVER w / lag(close, 251) OVER w) AS momentum,
      CASE WHEN count(*) OVER v >= 21 THEN ln(avg(close * volume) OVER v + 1) END AS logadv FROM px
      WINDOW w AS (PARTITION BY position ORDER BY date), v AS (PARTITION BY position ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) p
    ON p.position = m.position AND p.date = m.date""")
GRID = (("px", "shares"), """SELECT p.position, c.date FROM (SELECT position, min(last_day(date)) AS fm FROM px GROUP BY position) p
    JOIN (SELECT DISTINCT date FROM shares) c ON c.date >= p.fm""")
PD = (("gridp", "daily"), """SELECT g.position, g.date, d.beta, d.residvol, d.ratebeta, d.ndxbeta, d.momentum, d.logadv, d.close
    FROM gridp g ASOF JOIN daily d ON d.position = g.position AND g.date >= d.date""")
FD = (("pd", "funda"), """SELECT position, date, ln(mcap + 1) AS size, equity / (mcap + 1) AS value, netincome / (mcap + 1) AS earnyield,
    coalesce(liabilities, assets - equity) / (assets + 1) AS leverage FROM (SELECT g.position, g.date, f.*,
    CASE WHEN g.close * f.shares > 1e7 THEN g.close * f.shares END AS mcap FROM pd g ASOF LEFT JOIN (SELECT position AS fp, filed, equity, assets, liabilities, netincome, shares FROM funda) f
    ON f.fp = g.position AND g.date >= f.filed)""")
RAW = (("pd", "fd", "univ"), """SELECT p.*, f.size, f.value, f.earnyield, f.leverage, u.est FROM pd p JOIN fd f ON f.position = p.position AND f.date = p.date
    JOIN univ u ON u.position = p.position""")
IMP = (("raw",), """SELECT r.* REPLACE (CASE WHEN NOT est AND size IS NULL AND logadv IS NOT NULL AND n >= 30 THEN s * logadv + i ELSE size END AS size),
    CASE WHEN logadv IS NOT NULL AND size IS NOT NULL THEN logadv - size END AS liquidity,
    est OR (ne < 10) AS ref FROM raw r JOIN (SELECT date AS d2, regr_slope(size, logadv) FILTER (WHERE est) AS s, regr_intercept(size, logadv) FILTER (WHERE est) AS i,
    count(*) FILTER (WHERE est AND size IS NOT NULL AND logadv IS NOT NULL) AS n, count(*) FILTER (WHERE est) AS ne FROM raw GROUP BY date) l ON l.d2 = r.date""")


def split_z_sql(src: str) -> dict:
    """CTEs scoring ``src(date, position, ref, factor, v)`` -> ``<src>_z``."""
    return {
        f"{src}_m": ((src,), f"SELECT date, factor, median(v) FILTER (WHERE ref) AS med FROM {src} GROUP BY ALL"),
        f"{src}_s": ((src, f"{src}_m"), f"SELECT a.date, a.factor, any_value(med) AS med, 1.4826 * median(abs(v - med)) FILTER (WHERE ref) AS sc FROM {src} a JOIN {src}_m USING (date, factor) GROUP BY ALL"),
        f"{src}_c": ((src, f"{src}_s"), f"SELECT a.*, CASE WHEN sc > 1e-12 THEN (v - med) / sc END AS z0 FROM {src} a JOIN {src}_s USING (date, factor)"),
        f"{src}_r": ((f"{src}_c",), f"SELECT date, factor, avg(CASE WHEN z0 IS NOT NULL THEN greatest(-3, least(3, z0)) END) FILTER (WHERE ref) AS mu, stddev_samp(CASE WHEN z0 IS NOT NULL THEN greatest(-3, least(3, z0)) END) FILTER (WHERE ref) AS sd FROM {src}_c GROUP BY ALL"),
        f"{src}_z": ((f"{src}_c", f"{src}_r"), f"""SELECT date, position, ref, factor, CASE WHEN sd > 1e-12 AND z0 IS NOT NULL THEN
            (CASE WHEN ref THEN greatest(-3, least(3, z0)) ELSE greatest(-10, least(10, z0)) END - mu) / sd END AS z FROM {src}_c JOIN {src}_r USING (date, factor)"""),
    }


_FIRST = [s for s in de.STYLE_FACTORS if s != "NonLinSize"]
LONG = (("imp",), " UNION ALL ".join(f"SELECT date, position, ref, '{c}' AS factor, {c.lower()} AS v FROM imp" for c in _FIRST))
WIDE = (("l1_z",), """SELECT date, position, any_value(ref) AS ref, max(CASE WHEN factor = 'Size' THEN z END) AS size, max(CASE WHEN factor = 'Liquidity' THEN z END) AS liq,
    CASE WHEN max(CASE WHEN factor = 'Size' THEN z END) IS NOT NULL THEN greatest(-3, least(3, max(CASE WHEN factor = 'Size' THEN z END))) END AS s3 FROM l1_z GROUP BY date, position""")
L2 = (("wide",), """SELECT w.date, w.position, w.ref, 'NonLinSize' AS factor, power(s3, 3) - (s * s3 + i) AS v FROM wide w JOIN (SELECT date,
    regr_slope(coalesce(power(s3, 3), 0), coalesce(s3, 0)) FILTER (WHERE ref) AS s, regr_intercept(coalesce(power(s3, 3), 0), coalesce(s3, 0)) FILTER (WHERE ref) AS i FROM wide GROUP BY date) l ON l.date = w.date
    UNION ALL SELECT w.date, w.position, w.ref, 'Liquidity', liq - (s * size + i) FROM wide w JOIN (SELECT date,
    regr_slope(coalesce(liq, 0), coalesce(size, 0)) FILTER (WHERE ref) AS s, regr_intercept(coalesce(liq, 0), coalesce(size, 0)) FILTER (WHERE ref) AS i FROM wide GROUP BY date) l ON l.date = w.date""")
LOADS = (("l1_z", "l2_z"), """SELECT date, position, factor, z AS loading FROM l1_z WHERE factor <> 'Liquidity' AND z IS NOT NULL UNION ALL
    SELECT date, position, factor, CASE WHEN factor = 'NonLinSize' THEN greatest(-3, least(3, z)) ELSE z END FROM l2_z WHERE z IS NOT NULL""")
DESC = {**BETA, "daily": DAILY, "gridp": GRID, "pd": PD, "fd": FD, "raw": RAW, "imp": IMP, "l1": LONG, **split_z_sql("l1"),
        "wide": WIDE, "l2": L2, **split_z_sql("l2"), "loads": LOADS}


def dsql(body: str, doubles: str, *need: str, digits: int = 6, **extra) -> str:
    every = {**AT, **DESC, **extra}
    local: dict = {}

    def add(n):
        if n in every and n not in local:
            for dep in every[n][0]:
                add(dep)
            local[n] = every[n]

    for n in (*need, *extra):
        add(n)
    return sql(tidy_sql(body, doubles, digits), *[n for n in need if n not in every], **local)


def until(f):
    return f.prices.agg(F.last_day(F.max("Date"))).scalar()


def raw(s, d):
    f = fr(s, d)
    prox = {"RateBeta": proxy(f, "RATE"), "NdxBeta": proxy(f, "INDEX")}
    return materialized(s, d.strip("/").replace("/", "_") + "/raw_descriptors", lambda: de.raw_descriptors(
        f.prices, proxy(f, "MKT"), prox, f.fundamentals, f.universe, until(f)), ["Date"])


@query("src06_prices", sql(tidy_sql("SELECT * FROM px", "close", 8), "px"), 8)
def _(s, d):
    return fr(s, d).prices


@query("jn06_month_end_asof", dsql("SELECT position, date, close, logadv FROM pd", "logadv", "pd", digits=8), 8)
def _(s, d):
    f = fr(s, d)
    px = f.prices.select("Position", "Date", "Close").join(ts.log_dollar_volume(f.prices), ["Position", "Date"])
    return ts.month_snapshots(px, ["Position"], "Date", until(f)).select("Position", "Date", "Close", "LogADV")


@query("jn05_fundamental_stitch", sql(tidy_sql("SELECT position, filed, equity, assets, liabilities, netincome, shares FROM funda", "equity assets liabilities netincome shares", 4), "funda"), 4)
def _(s, d):
    from riskloom.sources.landed import stitch_fundamentals

    f = fr(s, d).fundamentals
    facts = f.unpivot(["Position", "filed"], ["Equity", "Assets", "Liabilities", "NetIncome", "Shares"], "name", "val").filter("val is not null")
    facts = facts.withColumns({"end": F.col("filed"), "pos": F.lit(0)})
    st = stitch_fundamentals(facts, ["Position"])
    # a tag absent from a filing keeps its last value; here a name reports a tag always or never
    return st.select("Position", "filed", "Equity", "Assets", "Liabilities", "NetIncome", "Shares")


_TAGS = ["Equity", "Assets", "Liabilities", "NetIncome", "Shares"]


def _reported(i: int, number: str, month: str) -> str:
    """Which filings report a tag: three of four the equity, two of three any other."""
    return f"({number} + {month}) % 4 <> 0" if i == 0 else f"({number} + 2 * {month} + 5 * {i}) % 3 <> 0"


_SPARSE = (("funda",), f"""SELECT position, filed, {', '.join(f"CASE WHEN {_reported(i, 'CAST(substring(position, 2) AS BIGINT)', 'month(filed)')} THEN {t.lower()} END AS {t.lower()}" for i, t in enumerate(_TAGS))} FROM funda""")


@query("jn05_sparse_fundamentals", sql(tidy_sql(f"""SELECT position, filed, {', '.join(f'last_value({t.lower()} IGNORE NULLS) OVER w AS {t.lower()}' for t in _TAGS)} FROM spf
    WINDOW w AS (PARTITION BY position ORDER BY filed ROWS UNBOUNDED PRECEDING) QUALIFY equity IS NOT NULL""", "equity assets liabilities netincome shares", 4), spf=_SPARSE), 4)
def _(s, d):
    """Filings that lack tags: every filing with an equity has the latest value of each tag before it."""
    from riskloom.sources.landed import stitch_fundamentals

    f = fr(s, d).fundamentals
    n, m = "cast(substring(Position, 2) as bigint)", "month(filed)"
    f = f.select("Position", "filed", *[F.when(F.expr(_reported(i, n, m)), F.col(t)).alias(t) for i, t in enumerate(_TAGS)])
    facts = f.unpivot(["Position", "filed"], _TAGS, "name", "val").filter("val IS NOT NULL").withColumns({"end": F.col("filed"), "pos": F.lit(0)})
    return stitch_fundamentals(facts, ["Position"]).select("Position", "filed", *_TAGS)


@query("ag13_fundamental_descriptors", dsql("SELECT date, position, size, value, earnyield, leverage FROM fd", "size value earnyield leverage", "fd"))
def _(s, d):
    f = fr(s, d)
    px = f.prices.select("Position", "Date", "Close")
    m = ts.month_snapshots(px, ["Position"], "Date", until(f))
    return de.fundamental_descriptors(m, f.fundamentals).select("Date", "Position", "Size", "Value", "EarnYield", "Leverage")


@query("jn18_raw_descriptors", dsql("""SELECT date, position, beta, residvol, ratebeta, ndxbeta, momentum, logadv, size, value, earnyield, leverage, est AS is_estimation FROM raw""",
    "beta residvol ratebeta ndxbeta momentum logadv size value earnyield leverage", "raw", digits=5), 5)
def _(s, d):
    return raw(s, d)


@query("ag10_size_imputation", dsql("SELECT date, position, size, raw_null AND size IS NOT NULL AS imputed FROM (SELECT i.*, r.size IS NULL AS raw_null FROM imp i JOIN raw r USING (date, position))", "size", "imp", "raw"))
def _(s, d):
    return de.impute_size(raw(s, d)).select("Date", "Position", "Size", "imputed")


_BV = (("imp",), "SELECT date, position, ref, 'Beta' AS factor, beta AS v FROM imp")


@query("ag09_split_z", dsql("SELECT date, position, z FROM bv_z", "z", "bv_z", digits=5, bv=_BV, **split_z_sql("bv")), 5)
def _(s, d):
    r = de.with_reference(raw(s, d), ["Date"])
    return de.split_z(r.select("Date", "Position", "ref", F.col("Beta").alias("v")), ["Date"], "v", "ref").select("Date", "Position", "z")


@query("ag08_robust_z", dsql("""SELECT date, position, CASE WHEN z0 IS NOT NULL THEN (z0 - avg(z0) OVER (PARTITION BY date)) / (stddev_samp(z0) OVER (PARTITION BY date) + 1e-12) END AS z FROM
    (SELECT r.date, r.position, CASE WHEN sc > 1e-12 AND value IS NOT NULL THEN greatest(-3, least(3, (value - med) / sc)) END AS z0 FROM raw r JOIN
     (SELECT date AS d2, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS sc FROM (SELECT date, value, median(value) OVER (PARTITION BY date) AS med FROM raw) GROUP BY date) s ON s.d2 = r.date)""",
    "z", "raw", digits=5), 5)
def _(s, d):
    return de.robust_z(raw(s, d).select("Date", "Position", F.col("Value").alias("v")), ["Date"], "v").select("Date", "Position", "z")


def loadings(s, d):
    return materialized(s, d.strip("/").replace("/", "_") + "/style_loadings", lambda: de.build_loadings(raw(s, d)), ["Date"])


@query("mod36_loadings", dsql("SELECT * FROM loads", "loading", "loads", digits=4), 4)
def _(s, d):
    return loadings(s, d)


@query("ag11_nonlinear_size", dsql("SELECT date, position, loading FROM loads WHERE factor = 'NonLinSize'", "loading", "loads", digits=4), 4)
def _(s, d):
    return loadings(s, d).filter(F.col("Factor") == "NonLinSize").select("Date", "Position", "Loading")


@query("ag12_liquidity", dsql("SELECT date, position, loading FROM loads WHERE factor = 'Liquidity'", "loading", "loads", digits=4), 4)
def _(s, d):
    return loadings(s, d).filter(F.col("Factor") == "Liquidity").select("Date", "Position", "Loading")


@query("prj13_corrupt_masks", sql(tidy_sql("""SELECT position, date, ret, CASE WHEN abs(ret) <= 0.5 THEN ret END AS masked FROM ret""", "ret masked"), ret=BETA["ret"]))
def _(s, d):
    r = ts.returns(fr(s, d).prices, ["Position"])
    return r.select("Position", "Date", "ret", ts.mask_return(F.col("ret")).alias("masked"))


@query("prj14_coverage_gate", sql("""SELECT date, position, count(*) AS n_descriptors FROM expo WHERE factor <> 'Market' GROUP BY ALL HAVING count(*) >= 4""", "expo"))
def _(s, d):
    return de.coverage_gate(fr(s, d).exposures.filter(F.col("Factor") != "Market"), 6)


@query("prj14_constant_columns", sql(tidy_sql("SELECT date, factor, stddev_samp(loading) AS sd, stddev_samp(loading) > 0.05 AS kept FROM expo GROUP BY ALL HAVING count(*) > 1", "sd"), "expo"))
def _(s, d):
    g = fr(s, d).exposures.groupBy("Date", "Factor").agg(F.stddev_samp("Loading").alias("sd"))
    return g.filter(F.col("sd").isNotNull()).select("Date", "Factor", "sd", (F.col("sd") > rg.MIN_STD).alias("kept"))


def style_exposures(f):
    return f.exposures


def day_returns(f):
    """Daily return of each name: its mean discount over the neutral rate."""
    m = f.factor_returns.filter(F.col("Factor") == "Market").select("Date", F.col("Return").alias("m"))
    return f.specific_returns.join(F.broadcast(m), "Date").select("Position", "Date", (F.col("SpecificReturn") + F.col("m")).alias("ret"))


def design(f):
    # the six shares of a name sum to one, so one part type is left out of the design
    return rg.designs(f.exposures.filter(F.col("Factor") != "STANDARD"), f.securities, None, size="LARGE", sector="Country", min_names=8)


def fitted(s, d):
    f = fr(s, d)
    return materialized(s, d.strip("/").replace("/", "_") + "/regression_stats", lambda: rg.regress_factors(
        design(f), day_returns(f), min_names=12))


@query("mod01_factor_returns", regression_sql.RETURNS)
def _(s, d):
    """Daily constrained WLS from distributed normal equations (checked against numpy in the tests)."""
    return fitted(s, d).select("Date", "Factor", "Return")


@query("mod03_fit_statistics", regression_sql.STATISTICS)
def _(s, d):
    """R2, t-statistics and breadth of the daily fit (checked against numpy in the tests)."""
    return fitted(s, d).select("Date", "Factor", "TStat", "R2", "N")


@query("ag21_regression_health", regression_sql.HEALTH)
def _(s, d):
    """Monthly mean R2 and breadth over the fitted days."""
    return rg.regression_health(fitted(s, d))


@query("ag21_factor_significance", regression_sql.SIGNIFICANCE)
def _(s, d):
    """Share of days with |t| > 2 and mean |t| per factor."""
    return rg.factor_significance(fitted(s, d))


@query("mod02_residuals", asql("""SELECT s.date, s.position, any_value(s.sret) + any_value(m.ret) - sum(coalesce(e.loading * f.ret, 0)) AS specificreturn FROM sr s
    JOIN fr m ON m.date = s.date AND m.factor = 'Market' JOIN days d ON d.day = s.date JOIN expo e ON e.date = d.d0 AND e.position = s.position
    LEFT JOIN fr f ON f.date = s.date AND f.factor = e.factor GROUP BY s.date, s.position""", "specificreturn", "sr", "fr", "days", "expo"))
def _(s, d):
    f = fr(s, d)
    return rg.residuals(day_returns(f), f.exposures, f.factor_returns)


@query("mod13_factor_portfolios", regression_sql.PORTFOLIOS)
def _(s, d):
    """Pure factor portfolio weights per month (PX = I is checked in the tests)."""
    return rg.factor_portfolios(design(fr(s, d))).select("d0", "Factor", "Position", "weight")


@query("mod13_purity", regression_sql.PURITY)
def _(s, d):
    """Leverage, own and cross exposure of the pure factor portfolios."""
    return rg.portfolio_purity(rg.factor_portfolios(design(fr(s, d))))


def wide_factors(f, names):
    p = f.factor_returns.groupBy("Date").pivot("Factor", names).agg(F.first("Return"))
    return p.dropna()


_X = ["Market", *STYLES]
_K = len(_X) + 1
_V = ["1.0::DOUBLE", *[f"x{i}" for i in range(1, _K)]]
_wide = ", ".join(f"max(ret) FILTER (WHERE factor = '{n}') AS x{i}" for i, n in enumerate(_X, 1))
_RR = (("art", "fr"), f"""SELECT book, count(*) AS n, sum(u) AS sy, sum(u * u) AS yy, {', '.join(f"sum({_V[i]} * u) AS c_{i}" for i in range(_K))},
    {', '.join(f"sum({_V[i]} * {_V[j]}) AS m_{i}_{j}" for i in range(_K) for j in range(i, _K))}
    FROM (SELECT book, date, value AS u FROM art WHERE kind = 'contribution' AND source = 'Specific') JOIN
    (SELECT * FROM (SELECT date, {_wide} FROM fr GROUP BY date) WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(1, _K))}) USING (date) GROUP BY book HAVING count(*) >= {len(_X) + 4}""")
_LAST, _GJ = solved("rr", "book", _K)
_beta = lambda i: " + ".join(f"e_{i}_{j} * c_{j}" for j in range(_K))
_RB = (("rr", _LAST), f"""SELECT rr.book, n, {', '.join(f'{_beta(i)} AS b_{i}' for i in range(_K))}, {', '.join(f'e_{i}_{i} AS v_{i}' for i in range(_K))}, c_0,
    yy - ({' + '.join(f'({_beta(i)}) * c_{i}' for i in range(_K))}) AS ss, yy - sy * sy / n AS st FROM rr JOIN {_LAST} g ON g.book = rr.book""")


@query("mod20_residual_regression", asql(" UNION ALL ".join(
    f"SELECT book, '{n}' AS factor, b_{i} AS beta, b_{i} / sqrt(greatest(v_{i} * ss / (n - {_K}), 1e-30)) AS t_stat, 1 - ss / st AS r2, n FROM rb" for i, n in enumerate(_X, 1)),
    "beta t_stat r2", "art", "fr", rr=_RR, **_GJ, rb=_RB))
def _(s, d):
    """OLS of the books' daily residual on the factors."""
    f = fr(s, d)
    u = artifact(s, d).filter((F.col("Kind") == "contribution") & (F.col("Source") == "Specific")).select("Book", "Date", F.col("Value").alias("u"))
    return rg.residual_regression(u, wide_factors(f, ["Market", *STYLES]), ["Market", *STYLES])


_Z = [*_V, "y"]
_PAIRS = [(i, j) for i in range(_K + 1) for j in range(i, _K + 1)]
_M4D = (("sr", "fr"), f"""SELECT s.position, s.date, row_number() OVER (PARTITION BY s.position ORDER BY s.date) AS i, s.sret + x1 AS y,
    {', '.join(f'x{i}' for i in range(1, _K))} FROM sr s JOIN (SELECT date, {_wide} FROM fr GROUP BY date) USING (date)
    WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(1, _K))}""")
_M4W = (("m4d",), f"""SELECT position, date, least(i, 504) AS n, {', '.join(f'sum({_Z[i]} * {_Z[j]}) OVER w AS p_{i}_{j}' for i, j in _PAIRS)},
    {', '.join(f'sum({_Z[i]} * {_Z[j]} * power(2.0::DOUBLE, i / 63.0::DOUBLE)) OVER w / power(2.0::DOUBLE, i / 63.0::DOUBLE) AS g_{i}_{j}' for i, j in _PAIRS)}
    FROM m4d WINDOW w AS (PARTITION BY position ORDER BY date ROWS BETWEEN 503 PRECEDING AND CURRENT ROW)""")
_M4 = (("m4w", "fr"), f"""SELECT a.position || '|' || CAST(a.cob AS VARCHAR) AS k, a.position, a.cob, w.* EXCLUDE (position, date),
    {', '.join(f'w.p_{i}_{j} AS m_{i}_{j}' for i in range(_K) for j in range(i, _K))}, {', '.join(f'w.p_{i}_{_K} AS c_{i}' for i in range(_K))}
    FROM (SELECT position, cob FROM (SELECT DISTINCT position FROM m4d), (SELECT last_day(CAST(unnest(range(date_trunc('month', min(date)), max(date) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE)) AS cob FROM fr)) a
    ASOF JOIN m4w w ON w.position = a.position AND a.cob >= w.date WHERE w.n >= 120""")
_LAST4, _GJ4 = solved("m4", "k", _K, "gk")
_M4B = (("m4", _LAST4), f"""SELECT m4.*, {', '.join(f'{_beta(i)} AS o_{i}' for i in range(_K))} FROM m4 JOIN {_LAST4} g ON g.k = m4.k""")
_M4S = (("m4b",), f"""SELECT *, -o_0 AS q_0, {', '.join(f'-(0.75 * o_{i} + {0.25 if i == 1 else 0.0}) AS q_{i}' for i in range(1, _K))}, 1.0::DOUBLE AS q_{_K} FROM m4b""")
_M4V = (("m4s",), f"SELECT *, greatest(({' + '.join(f'{1 if i == j else 2} * q_{i} * q_{j} * g_{i}_{j}' for i, j in _PAIRS)}) / g_0_0, 0) AS var FROM m4s")


@query("mod04_rolling_factor_betas", sql(tidy_sql(" UNION ALL ".join(
    f"SELECT position, cob AS date, '{n}' AS factor, -q_{i} AS loading, var AS specificvar FROM m4v" for i, n in enumerate(_X, 1)), "loading specificvar"),
    "sr", "fr", m4d=_M4D, m4w=_M4W, m4=_M4, **_GJ4, m4b=_M4B, m4s=_M4S, m4v=_M4V))
def _(s, d):
    """Shrunk trailing betas on the market and all styles at every month-end (checked against numpy in the tests)."""
    f = fr(s, d)
    names = ["Market", *STYLES]
    return rg.rolling_factor_betas(day_returns(f), wide_factors(f, names), names)


@query("prj15_leaf_augmentation", sql("""SELECT date, position, factor FROM expo WHERE factor <> 'Market' UNION ALL SELECT DISTINCT date, position, 'Market' FROM expo WHERE factor <> 'Market' UNION ALL
    SELECT DISTINCT e.date, e.position, 'Ind:' || s.sector FROM expo e JOIN sec s ON s.position = e.position WHERE e.factor <> 'Market'""", "expo", "sec"))
def _(s, d):
    f = fr(s, d)
    ind = f.securities.filter(F.col("Sector").isNotNull()).select(F.concat(F.lit("Ind:"), "Sector").alias("Factor")).distinct()
    out = de.leaf_augment(f.exposures.filter(F.col("Factor") != "Market"), f.securities, ind)
    return out.select("Date", "Position", "Factor")


@query("prj16_estimation_universe", sql("""SELECT s.position, coalesce(h.n, 0) >= 5 AND s.cik % 11 <> 0 AS is_estimation FROM sec s LEFT JOIN (SELECT position, count(*) AS n FROM idx GROUP BY position) h ON h.position = s.position""", "sec", "idx"))
def _(s, d):
    return fr(s, d).universe


@query("ag24_completeness", sql("SELECT date, position, count(*) AS n_descriptors FROM expo WHERE factor <> 'Market' GROUP BY ALL", "expo"))
def _(s, d):
    return fr(s, d).exposures.filter(F.col("Factor") != "Market").groupBy("Date", "Position").agg(F.count("Loading").alias("n_descriptors"))
