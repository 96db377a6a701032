"""Window and time-series queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window, functions as F

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_risk import ASOF, HF, fr
from riskloom.catalog.registry import query, tidy_sql
from riskloom.functions.quantiles import average_rank_pct
from riskloom.operators import measures as ms, timeseries as ts


def book_series(f):
    """(Book, i, d, r): the daily P&L of each book's as-of holdings over the full history."""
    p = f.positions.filter(F.col("Date") == F.lit(ASOF))
    x = (p.join(f.exposures, ["Date", "Position"]).groupBy("Book", "Factor")
         .agg(F.sum(F.col("Weight") * F.col("Loading")).alias("x")))
    days = ms.day_rows(x, f.scenarios.filter(F.col("ScenarioSet") == "HistFull"), ["Book"])
    return days.select("Book", F.col("day_idx").alias("i"), F.col("scen_date").alias("d"), F.col("p").alias("r"))


RET = (("px",), "SELECT position, date, close, close / lag(close) OVER (PARTITION BY position ORDER BY date) - 1 AS ret FROM px")
PRET = (("prox",), "SELECT series, date, close / lag(close) OVER (PARTITION BY series ORDER BY date) - 1 AS ret FROM prox")
JR = (("ret", "pret"), """SELECT r.position, r.date, r.ret, coalesce(r.ret, 0) AS s, coalesce(m.ret, 0) AS m,
    coalesce(t.ret, 0) AS t, coalesce(x.ret, 0) AS x FROM ret r
    LEFT JOIN pret m ON m.series = 'MKT' AND m.date = r.date LEFT JOIN pret t ON t.series = 'RATE' AND t.date = r.date
    LEFT JOIN pret x ON x.series = 'INDEX' AND x.date = r.date""")
MOM = (("jr",), """SELECT position, date, count(*) OVER w AS n, var_samp(m) OVER w AS vm, var_samp(s) OVER w AS vs,
    covar_samp(s, m) OVER w AS csm, var_samp(t) OVER w AS vt, covar_samp(s, t) OVER w AS cst, covar_samp(t, m) OVER w AS ctm,
    var_samp(x) OVER w AS vx, covar_samp(s, x) OVER w AS csx, covar_samp(x, m) OVER w AS cxm FROM jr
    WINDOW w AS (PARTITION BY position ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
BETA = {"ret": RET, "pret": PRET, "jr": JR, "mom": MOM}


def proxy(f, name):
    return ts.returns(f.proxies.filter(F.col("Series") == name), ["Series"])


def daily_betas(f):
    r = ts.returns(f.prices, ["Position"])
    return ts.betas(r.select("Position", "Date", "ret"), proxy(f, "MKT"),
                    {"RateBeta": proxy(f, "RATE"), "NdxBeta": proxy(f, "INDEX")})


@query("win01_daily_return", sql(tidy_sql("SELECT position, date, ret FROM ret", "ret"), ret=RET))
def _(s, d):
    return ts.returns(fr(s, d).prices, ["Position"]).select("Position", "Date", "ret")


@query("win02_beta_residual_vol", sql(tidy_sql(
    """SELECT position, date, CASE WHEN n >= 120 THEN csm / vm END AS beta,
       CASE WHEN n >= 120 THEN sqrt(252) * sqrt(vs - csm * csm / vm) END AS residvol FROM mom""", "beta residvol", 5), **BETA), 5)
def _(s, d):
    return daily_betas(fr(s, d)).select("Position", "Date", "Beta", "ResidVol")


@query("win03_partial_betas", sql(tidy_sql(
    """SELECT position, date, CASE WHEN n >= 120 THEN (cst - ctm * csm / vm) / (vt - ctm * ctm / vm) END AS ratebeta,
       CASE WHEN n >= 120 THEN (csx - cxm * csm / vm) / (vx - cxm * cxm / vm) END AS ndxbeta FROM mom""",
    "ratebeta ndxbeta", 5), **BETA), 5)
def _(s, d):
    return daily_betas(fr(s, d)).select("Position", "Date", "RateBeta", "NdxBeta")


@query("win04_momentum", sql(tidy_sql(
    """SELECT position, date, ln(lag(close, 20) OVER w / lag(close, 251) OVER w) AS momentum FROM px
       WINDOW w AS (PARTITION BY position ORDER BY date)""", "momentum"), "px"))
def _(s, d):
    return ts.momentum(fr(s, d).prices)


@query("win05_log_dollar_volume", sql(tidy_sql(
    """SELECT position, date, CASE WHEN count(*) OVER w >= 21 THEN ln(avg(close * volume) OVER w + 1) END AS logadv FROM px
       WINDOW w AS (PARTITION BY position ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""", "logadv"), "px"))
def _(s, d):
    return ts.log_dollar_volume(fr(s, d).prices)


@query("win07_ewma_specific_var", sql(tidy_sql(
    """SELECT last_day(date) AS date, position, arg_max(e, date) AS specificvar FROM (
       SELECT position, date, sum(sret * sret * k) OVER w / sum(k) OVER w AS e FROM (
         SELECT *, power(2, (row_number() OVER (PARTITION BY position ORDER BY date) - 1) / 63.0) AS k FROM sr)
       WINDOW w AS (PARTITION BY position ORDER BY date)) GROUP BY ALL""", "specificvar", 9), "sr"), 9)
def _(s, d):
    return ts.specific_variance(fr(s, d).specific_returns)


_PCT = (("mvs",), """SELECT position, date, (rank() OVER (PARTITION BY date ORDER BY mv)
    + (count(*) OVER (PARTITION BY date, mv) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct,
    (year(date) * 12 + month(date)) AS mi FROM (SELECT position, date, sum(mv) AS mv FROM mvs GROUP BY ALL)""")


def month_pct(f):
    m = f.positions.groupBy("Position", "Date").agg(F.round(F.sum("MV"), 4).alias("mv"))
    return average_rank_pct(m, ["Date"], "mv").withColumn("mi", F.year("Date") * 12 + F.month("Date"))


@query("win23_average_rank_pct", sql(tidy_sql("SELECT position, date, CAST(pct AS DOUBLE) AS pct FROM pct", "pct"), pct=_PCT))
def _(s, d):
    return month_pct(fr(s, d)).select("Position", "Date", "pct")


@query("win08_hysteresis", sql(
    """WITH RECURSIVE o AS (SELECT position, date, pct, mi, row_number() OVER (PARTITION BY position ORDER BY mi) AS k FROM pct),
       h AS (SELECT position, date, mi, k, pct >= 0.55 AS inside FROM o WHERE k = 1 UNION ALL
       SELECT o.position, o.date, o.mi, o.k, o.pct >= 0.55 OR (h.inside AND o.mi = h.mi + 1 AND o.pct >= 0.5)
       FROM h JOIN o ON o.position = h.position AND o.k = h.k + 1) SELECT position, date, inside FROM h""",
    pct=_PCT).replace("\nWITH RECURSIVE ", ",\n").replace("WITH lots", "WITH RECURSIVE lots", 1))
def _(s, d):
    return ts.hysteresis(month_pct(fr(s, d)), ["Position"], "mi", "pct", 0.55, 0.5).select("Position", "Date", "inside")


Z99 = NormalDist().inv_cdf(0.99)
_SIG = (("ser",), """SELECT *, sqrt(power(0.94, i) * var_pop(CASE WHEN i < 250 THEN r END) OVER (PARTITION BY book)
    + 0.06 * coalesce(sum(r * r * power(0.94, -i)) OVER (PARTITION BY book ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    * power(0.94, i - 1)) AS sigma FROM ser""")
_THR = {
    "equal": (("ser",), """SELECT book, i, r, CASE WHEN i >= 250 THEN quantile_cont(r, 0.01) OVER w END AS thr FROM ser
        WINDOW w AS (PARTITION BY book ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"""),
    "ewma": (("sig",), f"SELECT book, i, r, CASE WHEN i >= 250 THEN {-Z99!r} * sigma END AS thr FROM sig"),
    "fhs": (("sig",), """SELECT book, i, r, CASE WHEN i >= 250 THEN sigma * quantile_cont(r / sigma, 0.01) OVER w END AS thr FROM sig
        WINDOW w AS (PARTITION BY book ORDER BY i ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)"""),
}

for _id, _m in (("win09", "equal"), ("win10", "ewma"), ("win11", "fhs")):
    def _make(m):
        def f(s, d):
            t = ts.var_thresholds(book_series(fr(s, d)), ["Book"], "i", "r", 250, 0.99, m, 0.94)
            return t.select("Book", "i", "thr")
        return f

    query(f"{_id}_var_threshold_{_m}", sql(tidy_sql("SELECT book, CAST(i AS BIGINT) AS i, thr FROM thr", "thr"),
                                           **({"sig": _SIG} if _m != "equal" else {}), thr=_THR[_m]))(_make(_m))

    def _mk(m):
        return lambda s, d: ts.backtest(book_series(fr(s, d)), ["Book"], "i", "r", 250, 0.99, m, 0.94)

    query(f"mod14_backtest_{_m}", sql(tidy_sql(
        """SELECT book, 'ok' AS status, tested, exceptions, 0.01 * tested::DOUBLE AS expected, exceptions / tested AS rate, lr AS kupiec_lr,
           lr > 3.841 AS kupiec_reject, CASE WHEN cdf < 0.95 THEN 'green' WHEN cdf < 0.9999 THEN 'amber' ELSE 'red' END AS basel_zone,
           cdf AS binom_cdf FROM (SELECT *, -2 * ((tested - exceptions) * ln(0.99::DOUBLE) + exceptions * ln(0.01::DOUBLE)
           - (tested - exceptions) * ln(1 - exceptions / tested) - CASE WHEN exceptions = 0 THEN 0 ELSE exceptions * ln(exceptions / tested) END) AS lr,
           (SELECT sum(exp(lgamma(tested + 1) - lgamma(k + 1) - lgamma(tested - k + 1) + k * ln(0.01::DOUBLE) + (tested - k) * ln(0.99::DOUBLE)))
            FROM (SELECT unnest(range(0, 3000)) AS k) WHERE k <= exceptions) AS cdf FROM
           (SELECT book, count(*) - 250 AS tested, count(*) FILTER (WHERE r < thr) AS exceptions FROM thr GROUP BY book))""",
        "expected rate kupiec_lr binom_cdf"), **({"sig": _SIG} if _m != "equal" else {}), thr=_THR[_m]))(_mk(_m))


@query("mod14_exception_dates", sql(
    """SELECT book, d AS exception_date, rk FROM (SELECT t.book, s.d, row_number() OVER (PARTITION BY t.book ORDER BY s.d) AS rk
       FROM thr t JOIN ser s ON s.book = t.book AND s.i = t.i WHERE t.r < t.thr)""", "ser", thr=_THR["equal"]))
def _(s, d):
    t = ts.var_thresholds(book_series(fr(s, d)), ["Book"], "i", "r", 250, 0.99, "equal")
    w = Window.partitionBy("Book").orderBy("d")
    return (t.filter(F.col("r") < F.col("thr")).withColumn("rk", F.row_number().over(w))
            .select("Book", F.col("d").alias("exception_date"), "rk"))


_DD = (("ser",), """SELECT *, equity / peak - 1 AS dd FROM (SELECT *, max(equity) OVER (PARTITION BY book ORDER BY i) AS peak FROM
    (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY book ORDER BY i)) AS equity FROM ser))""")


@query("win12_drawdown_path", sql(tidy_sql("SELECT book, d AS date, equity, dd AS drawdown FROM ddp", "equity drawdown"), ddp=_DD))
def _(s, d):
    p = ts.drawdown_path(book_series(fr(s, d)), ["Book"], "d", "r")
    return p.select("Book", F.col("d").alias("Date"), "equity", F.col("dd").alias("drawdown"))


@query("mod15_drawdown", sql(tidy_sql(
    """SELECT p.book, any_value(t.n) AS n, 'ok' AS status, any_value(t.mdd) AS max_drawdown, min(p.d) FILTER (WHERE p.i <= t.ti AND p.equity >= t.pk) AS peak_date,
       any_value(t.td) AS trough_date, min(p.d) FILTER (WHERE p.i >= t.ti AND p.equity >= t.pk) AS recovery_date,
       CAST(any_value(t.ti) - min(p.i) FILTER (WHERE p.i <= t.ti AND p.equity >= t.pk) AS BIGINT) AS drawdown_obs,
       min(p.d) FILTER (WHERE p.i >= t.ti AND p.equity >= t.pk) IS NOT NULL AS recovered, any_value(l.longest) AS longest_underwater_obs
       FROM ddp p JOIN (SELECT book, count(*) AS n, min(dd) AS mdd, arg_min(i, dd) AS ti, arg_min(d, dd) AS td, arg_min(peak, dd) AS pk FROM ddp GROUP BY book) t USING (book)
       JOIN (SELECT book, max(c) AS longest FROM (SELECT book, g, count(*) AS c FROM (SELECT *, sum(CASE WHEN equity < peak - 1e-15 THEN 0 ELSE 1 END)
       OVER (PARTITION BY book ORDER BY i) AS g FROM ddp) WHERE equity < peak - 1e-15 GROUP BY ALL) GROUP BY book) l USING (book) GROUP BY p.book""",
    "max_drawdown"), ddp=_DD))
def _(s, d):
    return ts.drawdown(book_series(fr(s, d)), ["Book"], "d", "r")


def monthly(f):
    return ts.monthly_sum(book_series(f), ["Book"], "d", "r")


_Z = (("serm", "ser"), """SELECT m.book, m.month, m.total / (v.sd * sqrt(m.days)) AS z, m.total FROM serm m
    JOIN (SELECT book, stddev_samp(r) AS sd FROM ser GROUP BY book) v USING (book)""")


def z_scores(f):
    s = book_series(f)
    v = s.groupBy("Book").agg(F.stddev_samp("r").alias("sd"))
    return monthly(f).join(v, "Book").select("Book", "month", (F.col("total") / (F.col("sd") * F.sqrt("days"))).alias("z"), "total")


@query("win13_rolling_bias", sql(tidy_sql(
    """SELECT book, month, b, sqrt(2.0 / 24) AS band FROM (SELECT book, month, stddev_samp(z) OVER w AS b, count(*) OVER w AS n FROM zs
       WINDOW w AS (PARTITION BY book ORDER BY month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE n = 24""", "b band"), zs=_Z))
def _(s, d):
    return ts.rolling_bias(z_scores(fr(s, d)), ["Book"], "month")


@query("win14_autocorrelation", sql(tidy_sql(
    """SELECT book, CAST(k AS BIGINT) AS lag, corr(total, l) AS autocorr FROM (SELECT book, 1 AS k, total, lag(total, 1) OVER (PARTITION BY book ORDER BY month) AS l FROM serm
       UNION ALL SELECT book, 2, total, lag(total, 2) OVER (PARTITION BY book ORDER BY month) FROM serm) WHERE l IS NOT NULL GROUP BY ALL""", "autocorr"), "serm"))
def _(s, d):
    m = monthly(fr(s, d))
    return ts.autocorr(m, ["Book"], "month", "total", 1).unionByName(ts.autocorr(m, ["Book"], "month", "total", 2))


@query("win15_bias_statistic", sql(tidy_sql(
    "SELECT book, count(*) AS n, stddev_samp(z) AS bias, sqrt(2.0 / count(*)) AS half_width FROM zs GROUP BY book", "bias half_width"), zs=_Z))
def _(s, d):
    return ts.bias_stat(z_scores(fr(s, d)), ["Book"])


@query("win16_sign_persistence", sql(tidy_sql(
    """SELECT book, count(*) AS months, avg(CASE WHEN l IS NOT NULL THEN CASE WHEN sign(total) = sign(l) THEN 1.0::DOUBLE ELSE 0 END END) AS persistence,
       avg(CASE WHEN total > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate FROM (SELECT *, lag(total) OVER (PARTITION BY book ORDER BY month) AS l FROM serm) GROUP BY book""",
    "persistence hit_rate"), "serm"))
def _(s, d):
    return ts.sign_persistence(monthly(fr(s, d)), ["Book"], "month", "total")


@query("win21_month_resample", sql(tidy_sql("SELECT * FROM serm", "total"), "serm"))
def _(s, d):
    return monthly(fr(s, d))


@query("ag18_hit_rate_information_ratio", sql(tidy_sql(
    """SELECT book, count(*) AS n, avg(total) / stddev_samp(total) * sqrt(12) AS ir, avg(CASE WHEN total > 0 THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate
       FROM serm GROUP BY book""", "ir hit_rate"), "serm"))
def _(s, d):
    m = monthly(fr(s, d))
    h = m.groupBy("Book").agg(F.avg((F.col("total") > 0).cast("double")).alias("hit_rate"))
    return ts.info_ratio(m, ["Book"], "total").join(h, "Book")


@query("win22_calendar_gaps", sql(
    """SELECT a.position, a.n_dates, a.first_date, a.last_date, a.span - a.months AS missing_months, g.max_gap_days FROM
       (SELECT position, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, count(DISTINCT last_day(date)) AS months,
        (year(max(date)) * 12 + month(max(date))) - (year(min(date)) * 12 + month(min(date))) + 1 AS span FROM px GROUP BY position) a
       JOIN (SELECT position, max(gap) AS max_gap_days FROM (SELECT position, date - lag(date) OVER (PARTITION BY position ORDER BY date) AS gap FROM px) GROUP BY position) g USING (position)""",
    "px"))
def _(s, d):
    px = fr(s, d).prices
    w = Window.partitionBy("Position").orderBy("Date")
    g = px.withColumn("gap", F.datediff("Date", F.lag("Date").over(w)))
    a = g.groupBy("Position").agg(F.count_distinct("Date").alias("n_dates"), F.min("Date").alias("first_date"),
                                  F.max("Date").alias("last_date"), F.collect_set(F.last_day("Date")).alias("have"),
                                  F.max("gap").alias("max_gap_days"))
    want = F.transform(F.sequence(F.trunc("first_date", "month"), F.trunc("last_date", "month"), F.expr("interval 1 month")), F.last_day)
    return a.select("Position", "n_dates", "first_date", "last_date",
                    F.size(F.array_except(want, "have")).alias("missing_months"), "max_gap_days")
