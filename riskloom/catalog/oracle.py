"""The same frames as :mod:`riskloom.sources.tables`, stated as standard SQL for cross-checking.

``sql(body, *ctes)`` prefixes a query with the common table expressions it needs.
"""

from __future__ import annotations

from riskloom.sources.tables import EVENTS, HYPOS, STYLES

_case = ", ".join(f"sum(CASE WHEN factor = '{s}' THEN mv END) AS v_{s}" for s in STYLES)
_shares = ", ".join(f"coalesce(v_{s}, 0) / v_all AS {s}" for s in STYLES)
_zs = " UNION ALL ".join(
    f"SELECT date, position, '{s}' AS factor, "
    f"CASE WHEN stddev_samp({s}) OVER (PARTITION BY date) > 0 THEN ({s} - avg({s}) OVER (PARTITION BY date))"
    f" / stddev_samp({s}) OVER (PARTITION BY date) END AS loading FROM shares" for s in STYLES)
_events = " UNION ALL ".join(
    f"SELECT '{n}' AS scenarioset, date, factor, ret FROM panel WHERE date BETWEEN DATE '{a}' AND DATE '{b}'"
    for n, (a, b) in EVENTS.items())
_hypos = " UNION ALL ".join(
    "SELECT '%s' AS scenarioset, 0 AS day_idx, md AS scen_date, factor, vol * (CASE %s ELSE 0.0 END) AS shock FROM fvol"
    % (n, " ".join(f"WHEN factor = '{f}' THEN {v!r}" for f, v in m.items())) for n, m in HYPOS.items())

# name -> (dependencies, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lots": ((), """SELECT l_orderkey, l_partkey, 'P' || CAST(l_suppkey AS VARCHAR) AS position,
        CAST(l_shipdate AS DATE) AS day, last_day(CAST(l_shipdate AS DATE)) AS date,
        l_extendedprice * (1 - l_discount) AS mv, l_quantity AS qty, l_extendedprice AS price,
        l_discount AS disc, CAST(round(l_discount * 100) AS BIGINT) AS cents FROM lineitem"""),
    "blots": (("lots",), """SELECT lots.*, c_mktsegment AS book FROM lots
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""),
    "flots": (("lots",), "SELECT lots.*, p_type AS factor FROM lots JOIN part ON l_partkey = p_partkey"),
    "px": (("lots",), """SELECT position, day AS date, round(avg(price / qty), 8) AS close, sum(qty) AS volume
        FROM lots GROUP BY ALL"""),
    "adv": (("px",), """SELECT last_day(date) AS date, position, round(arg_max_null(a, date), 4) AS adv FROM (
        SELECT position, date, CASE WHEN count(*) OVER w >= 20 THEN avg(close * volume) OVER w END AS a FROM px
        WINDOW w AS (PARTITION BY position ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
        GROUP BY ALL"""),
    "mvs": (("blots",), "SELECT date, book, position, round(sum(mv), 4) AS mv FROM blots GROUP BY ALL"),
    "pos": (("mvs", "adv"), """SELECT m.date, m.book, m.position,
        m.mv / sum(m.mv) OVER (PARTITION BY m.date, m.book) AS weight, m.mv, a.adv
        FROM mvs m LEFT JOIN adv a ON m.date = a.date AND m.position = a.position"""),
    "rev": (("flots",), f"SELECT date, position, sum(mv) AS v_all, {_case} FROM flots GROUP BY ALL"),
    "shares": (("rev",), f"SELECT date, position, {_shares} FROM rev"),
    "expo": (("shares",), f"""SELECT * FROM (SELECT date, position, 'Market' AS factor, 1.0::DOUBLE AS loading
        FROM shares UNION ALL {_zs}) WHERE loading IS NOT NULL"""),
    "fr": (("flots",), """SELECT day AS date, coalesce(factor, 'Market') AS factor,
        CAST(sum(cents) AS DOUBLE) / (100::DOUBLE * count(cents)) - 0.05::DOUBLE AS ret FROM flots
        GROUP BY GROUPING SETS ((day, factor), (day))"""),
    "sr": (("lots", "fr"), """SELECT l.day AS date, l.position, l.d - 0.05::DOUBLE - f.ret AS sret FROM
        (SELECT day, position, CAST(sum(cents) AS DOUBLE) / (100::DOUBLE * count(cents)) AS d FROM lots GROUP BY ALL) l
        JOIN fr f ON f.date = l.day AND f.factor = 'Market'"""),
    "sv": (("lots",), """SELECT * FROM (SELECT date, position, var_samp(disc) AS sv FROM lots GROUP BY ALL)
        WHERE sv IS NOT NULL"""),
    "sec": ((), """SELECT 'P' || CAST(s_suppkey AS VARCHAR) AS position, 't' || CAST(s_suppkey AS VARCHAR) AS ticker,
        s_suppkey AS cik, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS cusip, s_name AS issuer, n_name AS sector,
        r_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "fm": (("fr",), """SELECT DISTINCT factor, CASE WHEN factor = 'Market' THEN 'Market' ELSE 'Style' END AS factorgroup
        FROM fr"""),
    "filings": (("blots",), """SELECT book, last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) AS report_date,
        position, round(sum(mv), 4) AS mv, count(*) AS lots,
        last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) + 45 AS filing_date
        FROM blots GROUP BY ALL"""),
    "mgr": (("filings",), """SELECT book, upper(substring(book, 1, 4)) AS cik,
        upper(substring(book,1,1)) || lower(substring(book,2)) || ' Desk' AS entityname,
        CASE WHEN book IN ('MACHINERY','AUTOMOBILE') THEN 'Industrial' ELSE 'Consumer' END AS firmtype,
        min(filing_date) AS first_filing_date, max(filing_date) AS last_filing_date,
        count(DISTINCT filing_date) AS n_filings, count(DISTINCT position) AS n_positions_distinct
        FROM filings GROUP BY book"""),
    "panel": (("fr",), """SELECT * FROM fr WHERE date IN (SELECT date FROM fr GROUP BY date
        HAVING count(DISTINCT factor) = (SELECT count(DISTINCT factor) FROM fr))"""),
    "fvol": (("panel",), "SELECT factor, stddev_samp(ret) AS vol, max(date) AS md FROM panel GROUP BY factor"),
    "scn": (("panel", "fvol"), f"""SELECT scenarioset, CAST(row_number() OVER (PARTITION BY scenarioset, factor
        ORDER BY date) - 1 AS INTEGER) AS day_idx, date AS scen_date, factor, ret AS shock FROM
        (SELECT 'HistFull' AS scenarioset, date, factor, ret FROM panel UNION ALL {_events})
        UNION ALL {_hypos}"""),
    "prox": (("flots",), """SELECT CASE WHEN factor IS NULL THEN 'MKT' WHEN factor = 'PROMO' THEN 'RATE' ELSE 'INDEX' END AS series,
        day AS date, round(sum(price / qty) / count(*), 8) AS close FROM flots
        GROUP BY GROUPING SETS ((day, factor), (day)) HAVING factor IS NULL OR factor IN ('PROMO', 'SMALL')"""),
    "funda": (("lots",), """SELECT position, filed, round(assets * 0.6, 4) AS equity, assets, CASE WHEN n % 7 <> 0 THEN round(d * 8, 4) END AS liabilities,
        round(assets * 0.06 - d, 4) AS netincome, CASE WHEN n % 11 <> 0 THEN qty * 1000 END AS shares FROM
        (SELECT position, CAST(substring(position, 2) AS BIGINT) AS n, last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) + 45 AS filed,
         sum(qty) AS qty, round(sum(price), 4) AS assets, round(sum(price * disc), 4) AS d FROM lots GROUP BY ALL)"""),
    "half": (("lots",), """SELECT make_date(year(day), CASE WHEN month(day) <= 6 THEN 1 ELSE 7 END, 1) AS effective_date, position,
        round(sum(mv), 4) AS rev FROM lots GROUP BY ALL"""),
    "idx": (("half",), """SELECT effective_date, position FROM (SELECT *, median(rev) OVER (PARTITION BY effective_date) AS med FROM half) WHERE rev >= med"""),
    "univ": (("sec", "idx"), """SELECT s.position, coalesce(h.n, 0) >= 5 AND s.cik % 11 <> 0 AS est FROM sec s
        LEFT JOIN (SELECT position, count(*) AS n FROM idx GROUP BY position) h ON h.position = s.position"""),
    # the daily P&L series of each book at the as-of date (HistFull)
    "ser": (("pb",), "SELECT book, day_idx AS i, scen_date AS d, b AS r FROM pb WHERE date = DATE '2000-06-30' AND scenarioset = 'HistFull'"),
    "serm": (("ser",), "SELECT book, last_day(d) AS month, sum(r) AS total, count(*) AS days FROM ser GROUP BY ALL"),
    # book exposures, book P&L days and the specific block
    "xb": (("pos", "expo"), """SELECT p.date, p.book, e.factor, sum(p.weight * e.loading) AS x
        FROM pos p JOIN expo e ON p.date = e.date AND p.position = e.position GROUP BY ALL"""),
    "pb": (("xb", "scn"), """SELECT x.date, x.book, s.scenarioset, s.day_idx, any_value(s.scen_date) AS scen_date,
        sum(x.x * s.shock) AS b FROM xb x JOIN scn s ON x.factor = s.factor GROUP BY ALL"""),
    "spec": (("pos", "sv"), """SELECT p.date, p.book, sum(p.weight * p.weight * v.sv) AS svar
        FROM pos p JOIN sv v ON p.date = v.date AND p.position = v.position GROUP BY ALL"""),
    # tail day of the book at 1 % (lower index) and its worst ceil(2.5 %) days
    "pbr": (("pb",), """SELECT *, row_number() OVER (PARTITION BY date, book, scenarioset ORDER BY b, day_idx) AS rk,
        count(*) OVER (PARTITION BY date, book, scenarioset) AS n FROM pb"""),
}


def solved(base: str, key: str, k: int, prefix: str = "gj") -> tuple[str, dict[str, tuple[tuple[str, ...], str]]]:
    """Inverse of a symmetric k x k matrix in plain SQL, by Gauss-Jordan elimination with one CTE per column.

    ``base`` names a CTE with ``key`` and the columns m_i_j for i <= j. Returns the name of the last CTE,
    whose columns e_i_j are the inverse, and all CTEs."""
    ctes: dict[str, tuple[tuple[str, ...], str]] = {}
    cells = [f"m_{min(i, j)}_{max(i, j)} AS a_{i}_{j}" for i in range(k) for j in range(k)]
    unit = [f"{float(i == j)}::DOUBLE AS e_{i}_{j}" for i in range(k) for j in range(k)]
    ctes[f"{prefix}_0"] = ((base,), f"SELECT {key}, {', '.join(cells + unit)} FROM {base}")
    for p in range(k):
        cols = []
        for m in "ae":
            for i in range(k):
                for j in range(k):
                    pivot = f"{m}_{p}_{j} / a_{p}_{p}"
                    cols.append(f"{pivot} AS {m}_{i}_{j}" if i == p else f"{m}_{i}_{j} - a_{i}_{p} * {pivot} AS {m}_{i}_{j}")
        ctes[f"{prefix}_{p + 1}"] = ((f"{prefix}_{p}",), f"SELECT {key}, {', '.join(cols)} FROM {prefix}_{p}")
    return f"{prefix}_{k}", ctes


def _order(names: tuple[str, ...], extra: dict) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        deps = (extra.get(n) or CTES[n])[0]
        for d in deps:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *ctes: str, **extra: tuple[tuple[str, ...], str]) -> str:
    """``WITH`` the named CTEs (and ``extra`` local ones, in order) around ``body``."""
    names = _order((*ctes, *extra), extra)
    defs = ",\n".join(f"{n} AS ({(extra.get(n) or CTES[n])[1]})" for n in names)
    return f"WITH {defs}\n{body}" if defs else body
