"""Universe diagnostics, data quality and descriptor audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.catalog.oracle import solved, sql
from riskloom.catalog.q_build import dsql, fitted, until
from riskloom.catalog.q_risk import AS, ASOF, fr
from riskloom.catalog.registry import query, tidy_sql
from riskloom.functions.quantiles import top_k
from riskloom.operators import attribution as at, quality as qa, scenarios as sc, universe as un
from riskloom.sources import tables
from riskloom.sources.tables import STYLES

WORDS = ["RING", "BOLT"]


def holdings(s, d):
    """Lots as filing rows: the part name plays the issuer, the part the cusip."""
    p = tables.table(s, d, "part").select(F.col("p_partkey"), F.col("p_name").alias("issuer"))
    b = tables.book_lots(s, d).join(p, F.col("l_partkey") == F.col("p_partkey"))
    q = F.last_day(F.add_months(F.trunc("Day", "quarter"), 2))
    return b.select("Book", q.alias("report_date"), F.date_add(q, 45).alias("filing_date"), "issuer",
                    F.concat(F.lit("c"), F.col("p_partkey")).alias("cusip"), F.col("mv").alias("value"), "l_partkey")


HOLD = (("blots",), """SELECT book, last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) AS report_date,
    last_day(CAST(date_trunc('quarter', day) + INTERVAL 2 MONTH AS DATE)) + 45 AS filing_date, p_name AS issuer, 'c' || p_partkey AS cusip, mv AS value, l_partkey FROM blots JOIN part ON l_partkey = p_partkey""")


@query("prj07_pooled_disclosure", sql(tidy_sql(r"""SELECT h.book, any_value(l.last) AS latest_report_date, count(*) FILTER (WHERE pool) AS n_dropped_rows_all_history, count(DISTINCT cusip) FILTER (WHERE pool) AS n_dropped_cusips_all_history,
    count(*) FILTER (WHERE pool AND report_date = last) AS n_dropped_latest, coalesce(sum(value) FILTER (WHERE pool AND report_date = last), 0) AS dropped_value_latest, sum(value) FILTER (WHERE report_date = last) AS total_value_latest,
    coalesce(sum(value) FILTER (WHERE pool AND report_date = last), 0) / sum(value) FILTER (WHERE report_date = last) AS dropped_value_share_latest
    FROM (SELECT *, regexp_matches(upper(issuer), '\bRING\b|\bBOLT\b') AS pool FROM hold) h JOIN (SELECT book, max(report_date) AS last FROM hold GROUP BY book) l ON l.book = h.book GROUP BY h.book""",
    "dropped_value_latest total_value_latest dropped_value_share_latest", 5), hold=HOLD), 5)
def _(s, d):
    return un.drop_pooled(holdings(s, d), WORDS)[1]


@query("prj07_pooled_kept", sql(r"SELECT book, issuer, count(*) AS n FROM hold WHERE NOT regexp_matches(upper(issuer), '\bRING\b|\bBOLT\b') GROUP BY ALL", hold=HOLD))
def _(s, d):
    return un.drop_pooled(holdings(s, d), WORDS)[0].groupBy("Book", "issuer").agg(F.count(F.lit(1)).alias("n"))


@query("prj08_canonical_ticker", "SELECT c_custkey, translate(upper(trim(c_mktsegment || '.' || c_nationkey || ' x')), '. ', '--') AS ticker FROM customer")
def _(s, d):
    c = tables.table(s, d, "customer")
    return c.select("c_custkey", un.canon_ticker(F.concat("c_mktsegment", F.lit("."), "c_nationkey", F.lit(" x"))).alias("ticker"))


_SFX = ", ".join(f"'{x}'" for x in un.NAME_SUFFIXES)


def _norm_sql(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(trim(regexp_replace(upper({c}), '[^A-Z0-9 ]', ' ', 'g')), ' +'), lambda x: x <> '' AND x NOT IN ({_SFX})), ' ')"


@query("prj09_normalised_name", f"SELECT p_partkey, {_norm_sql('''p_name || ', Inc. Holdings The ' || p_brand''')} AS name FROM part")
def _(s, d):
    p = tables.table(s, d, "part")
    return p.select("p_partkey", un.norm_name(F.concat("p_name", F.lit(", Inc. Holdings The "), "p_brand")).alias("name"))


def crosswalk(s, d):
    p = tables.table(s, d, "part")
    return p.filter(F.col("p_partkey") % 3 == 0).select(F.concat(F.lit("c"), F.col("p_partkey")).alias("cusip"), F.concat(F.lit("q."), "p_partkey").alias("ticker"))


def registry(s, d):
    p = tables.table(s, d, "part")
    return p.filter(F.col("p_size") < 10).groupBy(F.concat("p_name", F.lit(" Inc")).alias("title")).agg(F.concat(F.lit("r"), F.min("p_partkey")).alias("ticker"))


def index_names(s, d):
    p = tables.table(s, d, "part")
    return p.filter(F.col("p_type").isin("LARGE", "PROMO")).groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("r"), F.min("p_partkey")).alias("symbol"))


def ticker_snapshots(s, d):
    """Members of an index by crosswalk ticker from each half-year start: parts sold at least twice."""
    lots = tables.line_lots(s, d)
    half = F.make_date(F.year("Day"), F.when(F.month("Day") <= 6, 1).otherwise(7), F.lit(1))
    return (lots.groupBy(half.alias("effective_date"), "l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
            .select("effective_date", F.concat(F.lit("Q-"), "l_partkey").alias("member")))


MEM = {
    "hold": HOLD,
    "xw": ((), "SELECT 'C' || p_partkey AS cusip, 'Q-' || p_partkey AS t1 FROM part WHERE p_partkey % 3 = 0"),
    "rg": ((), f"SELECT {_norm_sql('p_name')} AS nm, min(upper('r' || k)) AS t2 FROM (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_size < 10 GROUP BY p_name) GROUP BY ALL"),
    "ix": ((), f"SELECT {_norm_sql('p_name')} AS nm, min(upper('r' || k)) AS t3 FROM (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_type IN ('LARGE', 'PROMO') GROUP BY p_name) GROUP BY ALL"),
    "snp": (("lots",), "SELECT make_date(year(day), CASE WHEN month(day) <= 6 THEN 1 ELSE 7 END, 1) AS eff, 'Q-' || l_partkey AS member FROM lots GROUP BY ALL HAVING count(*) >= 2"),
    "mem0": (("hold", "xw", "rg", "ix"), f"""SELECT h.book, h.report_date, h.filing_date, upper(h.cusip) AS cusip, coalesce(x.t1, r.t2, i.t3, '') AS ticker, h.issuer,
        h.value / sum(h.value) OVER (PARTITION BY h.book, h.report_date) AS weight, i.nm IS NOT NULL AS nmatch FROM hold h LEFT JOIN xw x ON x.cusip = upper(h.cusip)
        LEFT JOIN rg r ON r.nm = {_norm_sql('h.issuer')} LEFT JOIN ix i ON i.nm = {_norm_sql('h.issuer')}"""),
    "memd": (("mem0", "snp", "ix"), """SELECT m.*, nmatch OR (ticker <> '' AND ticker IN (SELECT t3 FROM ix)) AS in_now,
        EXISTS (SELECT 1 FROM snp WHERE snp.eff = c.eff AND snp.member = m.ticker) AS in_pit FROM mem0 m
        LEFT JOIN (SELECT r.report_date AS rd, max(eff) AS eff FROM (SELECT DISTINCT report_date FROM hold) r JOIN (SELECT DISTINCT eff FROM snp) e ON e.eff <= r.report_date GROUP BY ALL) c ON c.rd = m.report_date"""),
    "memb": (("memd",), """SELECT *, CASE WHEN ticker = '' AND NOT in_now THEN 'Unclassified' WHEN in_pit THEN 'S&P 500' WHEN in_now THEN 'S&P 400/600' ELSE 'Outside S&P 1500' END AS bucket FROM memd"""),
}


def members(s, d):
    return un.membership(holdings(s, d), crosswalk(s, d), registry(s, d), index_names(s, d), ticker_snapshots(s, d))


@query("mod23_membership", sql(tidy_sql("SELECT book, report_date, filing_date, cusip, ticker, issuer, weight, in_pit, in_now, bucket FROM memb", "weight", 9), **MEM), 9)
def _(s, d):
    return members(s, d)


@query("prj11_buckets", sql("SELECT bucket, in_pit, in_now, count(*) AS n FROM memb GROUP BY ALL", **MEM))
def _(s, d):
    return members(s, d).groupBy("bucket", "in_pit", "in_now").agg(F.count(F.lit(1)).alias("n"))


@query("prj10_identity_cascade", sql("SELECT ticker, nmatch AS name_match, count(*) AS n FROM mem0 GROUP BY ALL", **{k: MEM[k] for k in ("hold", "xw", "rg", "ix", "mem0")}))
def _(s, d):
    r = un.resolve_identity(holdings(s, d), crosswalk(s, d), registry(s, d), index_names(s, d))
    return r.groupBy("ticker", "name_match").agg(F.count(F.lit(1)).alias("n"))


@query("ag05_bucket_weights", sql(tidy_sql("""SELECT f.book, f.report_date, b.bucket, coalesce(w, 0) AS weight, coalesce(n, 0) AS n_names FROM (SELECT DISTINCT book, report_date FROM memb) f
    CROSS JOIN (VALUES ('Unclassified'), ('S&P 500'), ('S&P 400/600'), ('Outside S&P 1500')) b(bucket)
    LEFT JOIN (SELECT book, report_date, bucket, sum(weight) AS w, count(*) AS n FROM memb GROUP BY ALL) m ON m.book = f.book AND m.report_date = f.report_date AND m.bucket = b.bucket""", "weight"), **MEM))
def _(s, d):
    return un.bucket_weights(members(s, d))


@query("jn09_pit_membership", sql("""SELECT e.date, e.position, EXISTS (SELECT 1 FROM idx WHERE idx.effective_date = c.eff AND idx.position = e.position) AS member FROM (SELECT DISTINCT date, position FROM expo) e
    LEFT JOIN (SELECT d.date AS dd, max(i.effective_date) AS eff FROM (SELECT DISTINCT date FROM expo) d JOIN (SELECT DISTINCT effective_date FROM idx) i ON i.effective_date <= d.date GROUP BY ALL) c ON c.dd = e.date""", "expo", "idx"))
def _(s, d):
    f = fr(s, d)
    snap = f.index.select("effective_date", F.col("Position").alias("member"))
    r = f.exposures.filter(F.col("Factor") == "Market").select("Date", "Position")
    return un.member_asof(r, snap, "Date", "Position", "in_index").withColumnRenamed("in_index", "member")


# ---- funnel ------------------------------------------------------------------------------------
FUN = {
    "nm0": (("px",), """SELECT position, date, close, row_number() OVER w AS hist_days, CASE WHEN count(*) OVER v >= 20 THEN avg(close * volume) OVER v END AS adv,
        CASE WHEN count(*) OVER v >= 20 THEN avg(CASE WHEN volume > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER v END AS trade_freq FROM px
        WINDOW w AS (PARTITION BY position ORDER BY date), v AS (PARTITION BY position ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"""),
    "gridp": (("px", "shares"), "SELECT p.position, c.date FROM (SELECT position, min(last_day(date)) AS fm FROM px GROUP BY position) p JOIN (SELECT DISTINCT date FROM shares) c ON c.date >= p.fm"),
    "nm1": (("gridp", "nm0"), "SELECT g.position, g.date, n.hist_days, n.close, n.adv, n.trade_freq FROM gridp g ASOF JOIN nm0 n ON n.position = g.position AND g.date >= n.date"),
    "nm": (("nm1", "funda"), "SELECT g.*, g.close * f.shares AS mcap FROM nm1 g ASOF LEFT JOIN (SELECT position AS fp, filed, shares FROM funda WHERE shares IS NOT NULL) f ON f.fp = g.position AND g.date >= f.filed"),
    "fm1": (("nm", "expo"), """SELECT n.*, 'Common' AS sec_type, coalesce(e.c, 0) AS n_descriptors FROM nm n LEFT JOIN (SELECT date, position, count(*) AS c FROM expo WHERE factor <> 'Market' GROUP BY ALL) e ON e.date = n.date AND e.position = n.position"""),
    "fst": (("fm1",), """SELECT *, CASE WHEN mcap IS NULL OR hist_days = 0 THEN 'data unavailable' WHEN mcap < 1.5e8 THEN 'size' WHEN hist_days < 252 THEN 'history' WHEN trade_freq IS NULL OR trade_freq < 0.9 THEN 'trading frequency'
        WHEN adv IS NULL OR adv < 20000 THEN 'liquidity' WHEN n_descriptors < 6 THEN 'completeness' END AS stage FROM fm1"""),
    "fpc": (("fst",), """SELECT position, date, 100 * (rank() OVER (PARTITION BY date ORDER BY adv) + (count(*) OVER (PARTITION BY date, adv) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct, year(date) * 12 + month(date) AS mi FROM fst WHERE stage IS NULL"""),
    "fo": (("fpc",), "SELECT *, row_number() OVER (PARTITION BY position ORDER BY mi) AS k FROM fpc"),
    "fh": (("fo",), """SELECT position, date, mi, k, pct >= 30 AS kept FROM fo WHERE k = 1 UNION ALL SELECT o.position, o.date, o.mi, o.k, o.pct >= 30 OR (fh.kept AND o.mi = fh.mi + 1 AND o.pct >= 20) FROM fh JOIN fo o ON o.position = fh.position AND o.k = fh.k + 1"""),
    "fd2": (("fst", "fh", "pos"), """SELECT s.date, s.position, s.mcap, s.hist_days, s.trade_freq, s.adv, s.n_descriptors, CASE WHEN s.stage IS NULL AND NOT coalesce(h.kept, false) THEN 'stability buffer' ELSE s.stage END AS stage_dropped,
        EXISTS (SELECT 1 FROM pos p WHERE p.book = 'BUILDING' AND p.date = s.date AND p.position = s.position) AS held FROM fst s LEFT JOIN fh h ON h.position = s.position AND h.date = s.date"""),
}
CFG = {"min_mcap": 1.5e8, "min_adv": 20000.0, "enter_pctile": 30, "exit_pctile": 20}


def fsql(body, doubles, *need, digits=6):
    local: dict = {}

    def add(n):
        if n in FUN and n not in local:
            for dep in FUN[n][0]:
                if dep != n:
                    add(dep)
            local[n] = (tuple(x for x in FUN[n][0] if x != n), FUN[n][1])

    for n in need:
        add(n)
    q = sql(tidy_sql(body, doubles, digits), **local)
    return q.replace("WITH ", "WITH RECURSIVE ", 1)


def metrics(s, d):
    f = fr(s, d)
    m = un.name_metrics(f.prices, f.fundamentals, until(f))
    n = f.exposures.filter(F.col("Factor") != "Market").groupBy("Date", "Position").agg(F.count("Loading").alias("n_descriptors"))
    return m.join(n, ["Date", "Position"], "left").withColumn("n_descriptors", F.coalesce("n_descriptors", F.lit(0))).withColumn("sec_type", F.lit("Common"))


def funnel(s, d):
    held = fr(s, d).positions.filter(F.col("Book") == "BUILDING")
    return un.funnel(metrics(s, d), held, CFG)


@query("win06_liquidity_metrics", fsql("SELECT date, position, hist_days, adv, trade_freq, ln(mcap) AS ln_mcap FROM nm", "adv trade_freq ln_mcap", "nm", digits=5), 5)
def _(s, d):
    f = fr(s, d)
    return un.name_metrics(f.prices, f.fundamentals, until(f)).select("Date", "Position", "hist_days", "adv", "trade_freq", F.log("mcap").alias("ln_mcap"))


@query("prj12_failing_stage", fsql("SELECT date, position, stage FROM fst", "", "fst"))
def _(s, d):
    return metrics(s, d).select("Date", "Position", un.first_failing_stage(CFG).alias("stage"))


@query("mod24_funnel", fsql("SELECT date, position, ln(mcap) AS ln_mcap, hist_days, trade_freq, adv, n_descriptors, stage_dropped, stage_dropped IS NULL AS survived, held FROM fd2", "ln_mcap trade_freq adv", "fd2", digits=5), 5)
def _(s, d):
    return funnel(s, d).select("Date", "Position", F.log("mcap").alias("ln_mcap"), "hist_days", "trade_freq", "adv", "n_descriptors", "stage_dropped", "survived", "held")


@query("ag06_funnel_counts", fsql("SELECT date, count(*) AS population, count(*) FILTER (WHERE stage_dropped = 'data unavailable') AS data_unavailable, " + ", ".join(
    f"count(*) FILTER (WHERE stage_dropped = '{x}') AS drop_{x.replace(' ', '_')}" for x in un.STAGES) + ", count(*) FILTER (WHERE stage_dropped IS NULL) AS survivors, count(*) FILTER (WHERE stage_dropped IS NULL AND held) AS held_survivors FROM fd2 GROUP BY date", "", "fd2"))
def _(s, d):
    return un.funnel_counts(funnel(s, d))


# ---- span and drift ------------------------------------------------------------------------------
_SF = STYLES[:-1]
_SK = len(_SF)
_SQ = {
    "fw": (("expo",), f"SELECT date, position, {', '.join(f"max(loading) FILTER (WHERE factor = '{f}') AS l{i}" for i, f in enumerate(_SF))} FROM expo WHERE factor IN ({', '.join(f"'{f}'" for f in _SF)}) GROUP BY ALL"),
    "fv": (("fw",), f"SELECT *, {', '.join(f'coalesce(l{i}, 0) AS v{i}' for i in range(_SK))} FROM fw"),
    "fc": (("fv",), f"""SELECT date, {', '.join(f'avg(v{i}) AS u{i}, quantile_cont(v{i}, 0.01) AS lo{i}, quantile_cont(v{i}, 0.99) AS hi{i}' for i in range(_SK))},
        {', '.join(f'covar_samp(v{i}, v{j}) AS m_{i}_{j}' for i in range(_SK) for j in range(i, _SK))} FROM fv GROUP BY date HAVING count(*) >= 30"""),
}
_SLAST, _SGJ = solved("fc", "date", _SK, "fg")
_out = [f"l{i} IS NOT NULL AND (l{i} < lo{i} OR l{i} > hi{i})" for i in range(_SK)]
_SQ |= {
    **_SGJ,
    "fd": (("fv", "fc", _SLAST), f"SELECT v.*, {', '.join(f'lo{i}, hi{i}' for i in range(_SK))}, {' + '.join(f'(v{i} - u{i}) * e_{i}_{j} * (v{j} - u{j})' for i in range(_SK) for j in range(_SK))} AS d2 FROM fv v JOIN fc USING (date) JOIN {_SLAST} USING (date)"),
    "fe": (("fd",), "SELECT date, quantile_cont(d2, 0.99) AS edge FROM fd GROUP BY date"),
    "fsp": (("fd", "fe", "pos"), f"""SELECT p.book, d.date, d.position, p.weight, d2, edge, d2 <= edge AS inside, CAST({' + '.join(f'({o})::INT' for o in _out)} AS BIGINT) AS n_extreme,
        concat_ws(', ', {', '.join(f"CASE WHEN {o} THEN '{f}' END" for o, f in zip(_out, _SF))}) AS extreme FROM fd d JOIN fe USING (date) JOIN pos p ON p.date = d.date AND p.position = d.position"""),
}


def full_span(s, d):
    f = fr(s, d)
    return un.span(f.exposures, _SF, f.exposures.filter(F.col("Factor") == "Market"), f.positions)


@query("mod25_span", sql(tidy_sql("SELECT * FROM fsp", "weight d2 edge", 5), **_SQ), 5)
def _(s, d):
    """Mahalanobis span over all styles but one (the shares are collinear)."""
    return full_span(s, d)


@query("mod25_scatter", sql(tidy_sql("""SELECT date, 'cloud' AS kind, NULL AS book, position, NULL AS issuer, l1 AS x, l4 AS y, NULL::BOOLEAN AS inside FROM fw WHERE l1 IS NOT NULL AND l4 IS NOT NULL UNION ALL
    SELECT p.date, 'held', p.book, p.position, coalesce(issuer, ''), l1, l4, inside FROM fsp p JOIN fw USING (date, position) LEFT JOIN sec USING (position) WHERE l1 IS NOT NULL AND l4 IS NOT NULL""", "x y"), "sec", **_SQ))
def _(s, d):
    f = fr(s, d)
    return un.span_scatter(f.exposures, f.exposures.filter(F.col("Factor") == "Market"), full_span(s, d), f.securities, _SF[1], _SF[4])


_SP = {
    "sw": (("expo",), "SELECT date, position, coalesce(max(loading) FILTER (WHERE factor = 'LARGE'), 0) AS a, coalesce(max(loading) FILTER (WHERE factor = 'SMALL'), 0) AS b FROM expo GROUP BY ALL"),
    "sst": (("sw",), """SELECT date, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c, quantile_cont(a, 0.01) AS la, quantile_cont(a, 0.99) AS ha, quantile_cont(b, 0.01) AS lb, quantile_cont(b, 0.99) AS hb FROM sw GROUP BY date HAVING count(*) >= 30"""),
    "sd": (("sw", "sst"), "SELECT w.*, s.la, s.ha, s.lb, s.hb, (vb * (a - ma) * (a - ma) - 2 * c * (a - ma) * (b - mb) + va * (b - mb) * (b - mb)) / (va * vb - c * c) AS d2 FROM sw w JOIN sst s ON s.date = w.date"),
    "se": (("sd",), "SELECT date, quantile_cont(d2, 0.99) AS edge FROM sd GROUP BY date"),
    "spn": (("sd", "se", "pos"), """SELECT p.book, d.date, d.position, p.weight, d.d2, e.edge, d.d2 <= e.edge AS inside,
        CAST((CASE WHEN a < la OR a > ha THEN 1 ELSE 0 END) + (CASE WHEN b < lb OR b > hb THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme,
        concat_ws(', ', CASE WHEN a < la OR a > ha THEN 'LARGE' END, CASE WHEN b < lb OR b > hb THEN 'SMALL' END) AS extreme
        FROM sd d JOIN se e ON e.date = d.date JOIN pos p ON p.date = d.date AND p.position = d.position"""),
}


def span2(s, d):
    f = fr(s, d)
    return un.span(f.exposures, ["LARGE", "SMALL"], f.exposures.filter(F.col("Factor") == "Market"), f.positions)


@query("mod25_span_plane", sql(tidy_sql("SELECT book, date, position, weight, d2, edge, n_extreme, extreme FROM spn", "weight d2 edge", 5), **_SP), 5)
def _(s, d):
    return span2(s, d).drop("inside")


@query("mod25_inside_share", sql(tidy_sql("SELECT book, date, sum(weight) FILTER (WHERE d2 <= edge + 1e-9) / sum(weight) AS inside_share FROM spn GROUP BY ALL", "inside_share"), **_SP))
def _(s, d):
    return un.inside_share(span2(s, d).withColumn("inside", F.col("d2") <= F.col("edge") + 1e-9))


_DR = {"dr": (("pos", "expo"), f"""SELECT p.book, e.factor, sum(CASE WHEN w0 IS NULL THEN w1 * l1 ELSE 0 END) AS entered, sum(CASE WHEN w1 IS NULL THEN -w0 * l0 ELSE 0 END) AS exited,
    sum(CASE WHEN w0 IS NOT NULL AND w1 IS NOT NULL THEN (w1 - w0) * l0 ELSE 0 END) AS reweighted, sum(CASE WHEN w0 IS NOT NULL AND w1 IS NOT NULL THEN w1 * (l1 - l0) ELSE 0 END) AS loading_drift FROM
    (SELECT book, position, max(weight) FILTER (WHERE date = DATE '1999-12-31') AS w0, max(weight) FILTER (WHERE date = {AS}) AS w1 FROM pos WHERE date IN (DATE '1999-12-31', {AS}) GROUP BY ALL) p
    JOIN (SELECT position, factor, coalesce(max(loading) FILTER (WHERE date = DATE '1999-12-31'), 0) AS l0, coalesce(max(loading) FILTER (WHERE date = {AS}), 0) AS l1 FROM expo WHERE date IN (DATE '1999-12-31', {AS}) GROUP BY ALL) e ON e.position = p.position GROUP BY ALL""")}


@query("mod26_drift_attribution", sql(tidy_sql("SELECT *, entered + exited + reweighted + loading_drift AS delta FROM dr", "entered exited reweighted loading_drift delta"), **_DR))
def _(s, d):
    f = fr(s, d)
    return un.drift_attribution(f.positions, f.exposures, "1999-12-31", "2000-06-30")


@query("mod26_drift_summary", sql(tidy_sql("""SELECT book, factor, early, late, late - early AS delta, CASE WHEN late - early > 0 THEN 'up' WHEN late - early < 0 THEN 'down' ELSE 'flat' END AS lean FROM
    (SELECT book, factor, avg(x) FILTER (WHERE date < DATE '1998-01-01') AS early, avg(x) FILTER (WHERE date >= DATE '1998-01-01') AS late FROM xb WHERE factor <> 'Market' GROUP BY ALL)""", "early late delta"), "xb"))
def _(s, d):
    return un.drift_summary(at.book_factor_exposure(fr(s, d)).filter(F.col("Factor") != "Market"), "1998-01-01")


# ---- quality and audit -------------------------------------------------------------------------
def _dq(level: str, name: str, body: str, cond: str = "v > 0") -> str:
    return f"SELECT CASE WHEN {cond} THEN '{level}' ELSE 'PASS' END AS level, '{name}' AS name, CAST(v AS DOUBLE) AS value FROM ({body})"


_KEYS = [("exposures", "expo", "date, position, factor"), ("positions", "pos", "date, book, position"), ("securities", "sec", "position"), ("factor_meta", "fm", "factor"),
         ("factor_returns", "fr", "date, factor"), ("specific_var", "sv", "date, position")]
_DQ = [q for n, t, k in _KEYS for q in (
    _dq("FAIL", f"{n}: key unique", f"SELECT coalesce(sum(c - 1), 0) AS v FROM (SELECT count(*) AS c FROM {t} GROUP BY {k})"),
    _dq("FAIL", f"{n}: no null keys", f"SELECT count(*) AS v FROM {t} WHERE " + " OR ".join(f"{x.strip()} IS NULL" for x in k.split(","))))]
for n, t, c, u, ut in [("exposures", "expo", "position", "securities", "sec"), ("positions", "pos", "position", "securities", "sec"), ("specific_var", "sv", "position", "securities", "sec"),
                       ("exposures", "expo", "factor", "factor_meta", "fm"), ("factor_returns", "fr", "factor", "factor_meta", "fm")]:
    _DQ.append(_dq("FAIL", f"{n}.{c.capitalize()} in {u}", f"SELECT count(DISTINCT {c}) AS v FROM {t} WHERE {c} NOT IN (SELECT {c} FROM {ut})"))
_DQ += [
    _dq("FAIL", "positions: weights sum to 1 per book and date", "SELECT count(*) AS v FROM (SELECT abs(sum(weight) - 1) AS d FROM pos GROUP BY book, date) WHERE d > 1e-6"),
    _dq("WARN", "positions: no negative weights", "SELECT count(*) AS v FROM pos WHERE weight < 0"), _dq("FAIL", "specific_var: non-negative", "SELECT count(*) AS v FROM sv WHERE sv < 0"),
    _dq("FAIL", "exposures: no null loadings", "SELECT count(*) AS v FROM expo WHERE loading IS NULL"), _dq("WARN", "exposures: loadings within the coverage cap", "SELECT count(*) AS v FROM expo WHERE abs(loading) > 15"),
    _dq("WARN", "factor_returns: |return| <= 50%", "SELECT count(*) AS v FROM fr WHERE abs(ret) > 0.5"),
    *[_dq("WARN", f"{n}: monthly calendar gap-free", f"SELECT date_diff('month', min(date), max(date)) + 1 - count(DISTINCT date) AS v FROM {t}") for n, t in (("exposures", "expo"), ("positions", "pos"))],
    _dq("WARN", "factor_returns: daily calendar", "SELECT max(g) AS v FROM (SELECT date - lag(date) OVER (ORDER BY date) AS g FROM (SELECT DISTINCT date FROM fr))", "v > 7"),
    *[_dq("WARN", f"held positions have {n} on the same date", f"SELECT avg(CASE WHEN (date, position) IN (SELECT (date, position) FROM {t}) THEN 0.0::DOUBLE ELSE 1 END) AS v FROM (SELECT DISTINCT date, position FROM pos)", "v > 0.05") for n, t in (("exposures", "expo"), ("specific_var", "sv"))],
    _dq("WARN", "exposures: majority of style loadings per name and date", "SELECT count(*) AS v FROM (SELECT count(DISTINCT factor) AS c FROM expo WHERE factor <> 'Market' GROUP BY date, position) WHERE c < 4"),
    _dq("WARN", "securities: Sector populated", "SELECT avg(CASE WHEN sector = 'Unknown' THEN 1.0::DOUBLE ELSE 0 END) AS v FROM sec"),
    _dq("WARN", "exposures: style medians near zero", "SELECT max(abs(m)) AS v FROM (SELECT median(loading) AS m FROM expo WHERE factor <> 'Market' AND date = (SELECT max(date) FROM expo) AND position IN (SELECT position FROM univ WHERE est) GROUP BY factor)", "v > 0.5"),
    _dq("WARN", "size-proxy loadings of the held book", "SELECT 0.0 AS v", "v > 0.25"),
]


@query("mod27_dq_suite", sql(tidy_sql(" UNION ALL ".join(_DQ), "value"), "expo", "pos", "sec", "fm", "fr", "sv", "univ"))
def _(s, d):
    f = fr(s, d)
    return qa.run_checks(f, f.universe)


@query("mod27_dq_regression")
def _(s, d):
    """Breadth and R2 range of the fitted days."""
    return qa.regression_checks(fitted(s, d))[0]


@query("mod27_dq_psd")
def _(s, d):
    """Smallest eigenvalue of the factor covariance."""
    from riskloom.operators import measures as ms

    return qa.psd_check(ms.factor_cov(fr(s, d).scenarios.filter(F.col("ScenarioSet") == "HistFull")).drop("ScenarioSet"))


@query("jn16_coverage_join", sql(tidy_sql("SELECT book, date, avg(CASE WHEN (date, position) IN (SELECT (date, position) FROM sv) THEN 0.0::DOUBLE ELSE 1 END) AS uncovered FROM pos GROUP BY ALL", "uncovered"), "pos", "sv"))
def _(s, d):
    f = fr(s, d)
    h = f.specific_var.select("Date", "Position", F.lit(True).alias("h"))
    return f.positions.join(h, ["Date", "Position"], "left").groupBy("Book", "Date").agg(F.avg(F.col("h").isNull().cast("double")).alias("uncovered"))


@query("jn17_factor_correlations", sql(tidy_sql("SELECT x.factor AS a, y.factor AS b, corr(x.ret, y.ret) AS rho, count(*) AS n FROM panel x JOIN panel y ON x.date = y.date AND x.factor < y.factor GROUP BY ALL", "rho"), "panel"))
def _(s, d):
    return qa.factor_correlations(sc.complete_panel(fr(s, d).factor_returns))


@query("ag19_factor_summary", sql(tidy_sql("""SELECT factor, stddev_samp(ret) AS vol, stddev_samp(ret) FILTER (WHERE date > (SELECT max(date) - INTERVAL 12 MONTH FROM panel)) AS vol_1y, min(ret) AS min_return,
    min(date) FILTER (WHERE ret = mn) AS min_date, exp(sum(ln(1 + ret))) - 1 AS cum_growth FROM (SELECT *, min(ret) OVER (PARTITION BY factor) AS mn FROM panel) GROUP BY factor""", "vol vol_1y min_return cum_growth", 8), "panel"), 8)
def _(s, d):
    return qa.factor_summary(sc.complete_panel(fr(s, d).factor_returns))


@query("ag19_mean_abs_correlation", sql(tidy_sql("SELECT avg(abs(rho)) AS mean_abs_rho, count(*) AS pairs FROM (SELECT corr(x.ret, y.ret) AS rho FROM panel x JOIN panel y ON x.date = y.date AND x.factor < y.factor GROUP BY x.factor, y.factor)", "mean_abs_rho"), "panel"))
def _(s, d):
    return qa.factor_correlations(sc.complete_panel(fr(s, d).factor_returns)).agg(F.avg(F.abs("rho")).alias("mean_abs_rho"), F.count(F.lit(1)).alias("pairs"))


@query("ag20_factor_profile", sql(tidy_sql(f"""SELECT factor, quantile_cont(loading, 0.01) AS p01, quantile_cont(loading, 0.25) AS p25, quantile_cont(loading, 0.5) AS p50, quantile_cont(loading, 0.75) AS p75, quantile_cont(loading, 0.99) AS p99,
    count(*) AS n, count(*) FILTER (WHERE abs(loading) > 3) AS n_beyond_3, least(min(loading), -3.5) AS lo, greatest(max(loading), 3.5) AS hi FROM expo WHERE date = {AS} AND factor = 'LARGE' GROUP BY factor""", "p01 p25 p50 p75 p99 lo hi"), "expo"))
def _(s, d):
    return qa.factor_profile(fr(s, d).exposures, ASOF, "LARGE")[0]


@query("ag20_histogram", sql(f"""SELECT CAST(least(floor((loading - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM (SELECT loading, least(min(loading) OVER (), -3.5) AS lo, greatest(max(loading) OVER (), 3.5) AS hi FROM expo WHERE date = {AS} AND factor = 'LARGE') GROUP BY ALL""", "expo"))
def _(s, d):
    return qa.factor_profile(fr(s, d).exposures, ASOF, "LARGE")[1]


@query("ag22_book_breadth", sql(tidy_sql("SELECT book, min(n) AS n_min, median(n) AS n_median, max(n) AS n_max FROM (SELECT book, date, count(DISTINCT position) AS n FROM pos GROUP BY ALL) GROUP BY book", "n_median"), "pos"))
def _(s, d):
    n = fr(s, d).positions.groupBy("Book", "Date").agg(F.count_distinct("Position").alias("n"))
    return n.groupBy("Book").agg(F.min("n").alias("n_min"), F.median("n").alias("n_median"), F.max("n").alias("n_max"))


@query("ag23_managers", sql("SELECT book, cik, entityname, firmtype, first_filing_date, last_filing_date, n_filings, n_positions_distinct FROM mgr", "mgr"))
def _(s, d):
    return fr(s, d).managers.drop("n_distinct_cusips_parsed", "dropped_value_share_latest")


@query("mod28_collinear_pairs", sql(tidy_sql("SELECT * FROM (SELECT x.factor AS a, y.factor AS b, corr(x.ret, y.ret) AS rho, count(*) AS n FROM panel x JOIN panel y ON x.date = y.date AND x.factor < y.factor GROUP BY ALL) WHERE abs(rho) >= 0.3", "rho"), "panel"))
def _(s, d):
    return qa.collinear_pairs(sc.complete_panel(fr(s, d).factor_returns), 0.3)


_HB = {"hb": (("sr", "panel", "pos"), f"""SELECT p.book, b.position, b.factor, p.weight, c / vx AS beta, (c / vx) / sqrt(greatest(vu - c * c / vx, 0) / (n * vx)) AS t, n FROM
    (SELECT s.position, f.factor, count(*) AS n, covar_samp(s.sret, f.ret) AS c, var_samp(f.ret) AS vx, var_samp(s.sret) AS vu FROM sr s JOIN panel f ON f.date = s.date AND f.factor <> 'Market' GROUP BY ALL HAVING count(*) >= 120) b
    JOIN pos p ON p.position = b.position AND p.date = {AS}""")}


@query("mod28_hidden_betas", sql(tidy_sql("SELECT * FROM hb", "weight beta t", 5), **_HB), 5)
def _(s, d):
    f = fr(s, d)
    return qa.hidden_betas(f.specific_returns, sc.complete_panel(f.factor_returns), f.positions.filter(F.col("Date") == F.lit(ASOF)))


@query("mod28_hidden_beta_summary", sql(tidy_sql("""SELECT *, book_beta / weight_tested AS wavg_beta, CASE WHEN abs(book_beta) >= 0.10 AND share_sig >= 0.4 THEN 'HIDDEN BETA' WHEN abs(book_beta) >= 0.05 THEN 'watch' ELSE 'ok' END AS flag FROM
    (SELECT book, factor, sum(weight * beta) AS book_beta, sum(weight) AS weight_tested, avg(CASE WHEN abs(t) > 2 THEN 1.0::DOUBLE ELSE 0 END) AS share_sig, count(*) AS n_names FROM hb GROUP BY ALL)""", "book_beta weight_tested share_sig wavg_beta"), **_HB))
def _(s, d):
    f = fr(s, d)
    return qa.hidden_beta_summary(qa.hidden_betas(f.specific_returns, sc.complete_panel(f.factor_returns), f.positions.filter(F.col("Date") == F.lit(ASOF))))


@query("mod28_loading_coverage", sql(tidy_sql(f"""SELECT p.book, e.factor, sum(p.weight) AS weight_covered, any_value(t.w) - sum(p.weight) AS weight_missing, any_value(t.k) - count(*) AS n_missing FROM pos p JOIN expo e ON e.position = p.position AND e.date = {AS}
    JOIN (SELECT book, sum(weight) AS w, count(*) AS k FROM pos WHERE date = {AS} GROUP BY book) t ON t.book = p.book WHERE p.date = {AS} GROUP BY ALL""", "weight_covered weight_missing"), "pos", "expo"))
def _(s, d):
    f = fr(s, d)
    return qa.loading_coverage(f.exposures, f.positions.filter(F.col("Date") == F.lit(ASOF)), ASOF)
