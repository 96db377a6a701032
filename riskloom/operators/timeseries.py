"""Order-dependent analytics over bounded series (a name's or a book's trade days).

Every window is keyed by a name or book and runs over its calendar. Trailing moments are differences
of running sums, one pass per row whatever the window length.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def returns(px: DataFrame, by: list[str], on: str = "Date", close: str = "Close", out: str = "ret") -> DataFrame:
    """close / previous close - 1 over non-null closes."""
    p = px.filter(F.col(close).isNotNull())
    return p.withColumn(out, F.col(close) / F.lag(close).over(_w(by, on)) - 1)


def mask_return(c: Column, limit: float = 0.5) -> Column:
    """A move beyond the limit is a data error: NULL, never clipped."""
    return F.when(F.abs(c) <= limit, c)


def rolling_sums(df: DataFrame, by: list[str], on: str, cols: dict[str, Column], rows: int) -> DataFrame:
    """Trailing ``rows``-row sums of the expressions, by differencing running sums."""
    w = _w(by, on)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({f"_c_{n}": F.sum(F.coalesce(c, F.lit(0.0))).over(run) for n, c in cols.items()})
    return (d.withColumns({n: F.col(f"_c_{n}") - F.coalesce(F.lag(f"_c_{n}", rows).over(w), F.lit(0.0)) for n in cols})
            .drop(*[f"_c_{n}" for n in cols]))


def betas(ret: DataFrame, market: DataFrame, proxies: dict[str, DataFrame], window: int = 252,
          min_rows: int = 120, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trailing beta, annualised residual vol and partial betas per (Position, Date).

    ``ret(Position, Date, ret)``; ``market``/``proxies`` are ``(Date, ret)``. A missing return reads 0
    inside the window. A proxy is residualised against the market first, in closed form. Columns of ``ret`` in ``keep``
    ride along.
    """
    d = ret.join(F.broadcast(market.select("Date", F.col("ret").alias("m"))), "Date", "left")  # one row per day
    for n, p in proxies.items():
        d = d.join(F.broadcast(p.select("Date", F.col("ret").alias(f"p_{n}"))), "Date", "left")
    s, m = F.coalesce("ret", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    cols = {"n_": F.lit(1.0), "s_": s, "m_": m, "ss": s * s, "mm": m * m, "sm": s * m,
            "rn": F.when(F.col("ret").isNotNull(), 1.0)}
    for n in proxies:
        r = F.coalesce(f"p_{n}", F.lit(0.0))
        cols |= {f"r_{n}": r, f"rr_{n}": r * r, f"sr_{n}": s * r, f"rm_{n}": r * m}
    d = rolling_sums(d, ["Position"], "Date", cols, window)
    n, div = F.col("n_"), F.try_divide

    def cov(ab: str, a: str, b: str) -> Column:
        return div(F.col(ab) - F.col(a) * F.col(b) / n, n - 1)

    v_m, v_s, c_sm = cov("mm", "m_", "m_"), cov("ss", "s_", "s_"), cov("sm", "s_", "m_")
    ok = (n >= min_rows) & (v_m > 1e-18)
    rn = F.col("rn")
    own = F.sqrt(F.greatest(div(F.col("ss") - div(F.col("s_") ** 2, rn), rn - 1), F.lit(0.0)))
    out = [F.when(ok, div(c_sm, v_m)).alias("Beta"),
           F.when(n >= min_rows, math.sqrt(252) * F.when(
               v_m > 1e-18, F.sqrt(F.greatest(v_s - div(c_sm * c_sm, v_m), F.lit(0.0)))).otherwise(own)).alias("ResidVol")]
    for p in proxies:
        c_sr, c_rm = cov(f"sr_{p}", "s_", f"r_{p}"), cov(f"rm_{p}", f"r_{p}", "m_")
        den = cov(f"rr_{p}", f"r_{p}", f"r_{p}") - div(c_rm * c_rm, v_m)
        out.append(F.when(ok & (den > 1e-18), div(c_sr - div(c_rm * c_sm, v_m), den)).alias(p))
    return d.select("Position", "Date", *keep, *out)


def momentum(px: DataFrame, skip: int = 20, back: int = 251, keep: tuple[str, ...] = ()) -> DataFrame:
    """Log relative strength ln(P[-21] / P[-252]) once 252 rows exist."""
    w = _w(["Position"], "Date")
    return px.select("Position", "Date", *keep, F.log(F.lag("Close", skip).over(w) / F.lag("Close", back).over(w)).alias("Momentum"))


def log_dollar_volume(px: DataFrame, rows: int = 63, min_rows: int = 21, keep: tuple[str, ...] | None = None) -> DataFrame:
    """ln(mean dollar volume + 1) over the last ``rows`` non-null volume rows. With ``keep`` the rows without a volume
    stay, too, without a value."""
    d = px.withColumn("dv", F.col("Close") * F.col("Volume")).withColumn("_none", F.col("dv").isNull())
    if keep is None:
        d = d.filter(~F.col("_none"))
    d = rolling_sums(d, ["Position", "_none"], "Date", {"sv": F.col("dv"), "nv": F.lit(1.0)}, rows)
    return d.select("Position", "Date", *(keep or ()), F.when(~F.col("_none") & (F.col("nv") >= min_rows), F.log(F.col("sv") / F.col("nv") + 1)).alias("LogADV"))


def month_snapshots(df: DataFrame, by: list[str], on: str, until: Column, max_months: int | None = None) -> DataFrame:
    """State of each key at every month-end from its first row to ``until``: the last row on or
    before the month-end, carried forward through empty months."""
    pay = [c for c in df.columns if c not in by]
    m = df.groupBy(*by, F.last_day(on).alias("_m")).agg(F.max_by(F.struct(*pay), F.col(on)).alias("_r"))
    nxt = F.lead("_m").over(_w(by, "_m"))
    end = F.coalesce(F.add_months(nxt, -1), until)
    d = m.withColumn("_end", F.greatest(F.last_day(end), F.col("_m")))
    return (d.select(*by, "_r", F.explode(F.sequence(F.trunc("_m", "month"), F.trunc("_end", "month"),
                                                     F.expr("interval 1 month"))).alias("_x"))
            .select(F.last_day("_x").alias("Date"), *by, *[F.col(f"_r.{c}").alias("as_of" if c == on else c) for c in pay]))


def month_adv(px: DataFrame) -> DataFrame:
    """(Date, Position) -> trailing 63-row mean dollar volume at the month's last row (min 20)."""
    w = Window.partitionBy("Position").orderBy("Date").rowsBetween(-62, 0)
    dv = F.col("Close") * F.col("Volume")
    d = px.select("Position", "Date",
                  F.when(F.count(dv).over(w) >= 20, F.avg(dv).over(w)).alias("ADV"))
    return (d.groupBy(F.last_day("Date").alias("Date"), "Position")
            .agg(F.round(F.max_by("ADV", F.col("Date")), 4).alias("ADV")))


BLOCK = 512  # rows whose decay factors are multiplied out; beyond, blocks hand their state on


def decayed_sum(df: DataFrame, by: list[str], idx: str, value: Column, lam: float, out: str) -> DataFrame:
    """Adds ``out`` = sum over i <= t of lam^(t - i) value_i, where ``idx`` counts 0, 1, ... per series.

    Powers stay inside blocks of ``BLOCK`` rows, so a series of any length neither overflows nor
    vanishes; the state at each block's start is a fold over one number per block."""
    d = df.withColumns({"_b": F.floor(F.col(idx) / BLOCK), "_j": (F.col(idx) % BLOCK).cast("double"), "_v": value})
    end = d.groupBy(*by, "_b").agg(F.sum(F.col("_v") * F.pow(F.lit(lam), BLOCK - 1 - F.col("_j"))).alias("_e"))
    blocks = F.sort_array(F.collect_list(F.struct("_b", "_e")))  # one per block of the calendar
    fold = F.aggregate(blocks, F.struct(F.lit(0.0).alias("c"), F.array().cast("array<struct<b:bigint,c:double>>").alias("s")),
                       lambda a, e: F.struct((a["c"] * lam**BLOCK + e["_e"]).alias("c"),
                                             F.concat(a["s"], F.array(F.struct(e["_b"].alias("b"), a["c"].alias("c")))).alias("s")))
    start = end.groupBy(*by).agg(fold["s"].alias("_s")).select(*by, F.explode("_s").alias("_x")).select(*by, F.col("_x.b").alias("_b"), F.col("_x.c").alias("_c"))
    w = Window.partitionBy(*by, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(F.col("_v") * F.pow(F.lit(lam), -F.col("_j"))).over(w)
    return d.join(start, [*by, "_b"]).withColumn(out, F.pow(F.lit(lam), F.col("_j")) * (lam * F.col("_c") + inside)).drop("_b", "_j", "_v", "_c")


def ewma_variance(df: DataFrame, by: list[str], on: str, value: str, halflife: float = 63, out: str = "ewma") -> DataFrame:
    """Exponentially weighted mean of squares per row, weights adjusted for the short start."""
    lam = 0.5 ** (1.0 / halflife)
    d = df.filter(F.col(value).isNotNull()).withColumn("_t", F.row_number().over(_w(by, on)) - 1)
    d = decayed_sum(d, by, "_t", F.col(value) ** 2, lam, out)
    return d.withColumn(out, F.col(out) * (1 - lam) / (1 - F.pow(F.lit(lam), F.col("_t") + 1.0))).drop("_t")


def specific_variance(sr: DataFrame, halflife: float = 63) -> DataFrame:
    """Month-end snapshot of the EWMA specific variance: each month's last trade-day state."""
    e = ewma_variance(sr, ["Position"], "Date", "SpecificReturn", halflife)
    return (e.groupBy(F.last_day("Date").alias("Date"), "Position")
            .agg(F.max_by("ewma", F.col("Date")).alias("SpecificVar")))


def hysteresis(df: DataFrame, by: list[str], month_idx: str, pct: str, enter: float, exit_: float, out: str = "inside") -> DataFrame:
    """Membership with a buffer: in at >= enter, stays in while >= exit, out below.

    ``month_idx`` numbers months densely; a missing month resets. Equivalent to the last decisive
    event (enter / exit) inside an unbroken run of months."""
    w = _w(by, month_idx)
    d = df.withColumn("_run", F.col(month_idx) - F.row_number().over(w))
    ev = F.when(F.col(pct) >= enter, F.lit(True)).when((F.col(pct) < exit_) | F.col(pct).isNull(), F.lit(False))
    wr = Window.partitionBy(*by, "_run").orderBy(month_idx).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.coalesce(F.last(ev, ignorenulls=True).over(wr), F.lit(False))).drop("_run")


# ---- VaR thresholds and backtest ------------------------------------------------------------
def ewma_sigma(s: DataFrame, by: list[str], idx: str, value: str, window: int, lam: float) -> DataFrame:
    """Predictive EWMA volatility: sigma2_t = lam sigma2_{t-1} + (1 - lam) r_{t-1}^2, seeded with the
    population variance of the first ``window`` rows. ``idx`` counts 0, 1, ... per series."""
    seed = s.filter(F.col(idx) < window).groupBy(*by).agg(F.var_pop(value).alias("_seed"))
    d = decayed_sum(s, by, idx, F.coalesce(F.col(value) ** 2, F.lit(0.0)), lam, "_d").join(seed, by)
    past = F.coalesce(F.lag("_d").over(_w(by, idx)), F.lit(0.0))
    return d.withColumn("sigma", F.sqrt(F.pow(F.lit(lam), F.col(idx).cast("double")) * F.col("_seed") + (1 - lam) * past)).drop("_d", "_seed")


def var_thresholds(s: DataFrame, by: list[str], idx: str, value: str, window: int = 250, alpha: float = 0.99,
                   method: str = "fhs", lam: float = 0.94) -> DataFrame:
    """Out-of-sample daily VaR threshold ``thr`` (negative) from rows before the day.

    ``equal``: quantile of the prior window; ``ewma``: -z sigma; ``fhs``: sigma times the quantile of
    prior standardised residuals."""
    p = 1.0 - alpha
    w = _w(by, idx).rowsBetween(-window, -1)
    ready = F.col(idx) >= window
    if method == "equal":
        return s.withColumn("thr", F.when(ready, F.percentile(value, F.lit(p)).over(w)))
    d = ewma_sigma(s, by, idx, value, window, lam)
    if method == "ewma":
        return d.withColumn("thr", F.when(ready, -NormalDist().inv_cdf(alpha) * F.col("sigma")))
    if method != "fhs":
        raise ValueError(f"unknown method {method!r}")
    d = d.withColumn("_res", F.when(F.col("sigma") > 0, F.col(value) / F.col("sigma")))
    return d.withColumn("thr", F.when(ready, F.col("sigma") * F.percentile("_res", F.lit(p)).over(w))).drop("_res")


def kupiec_lr(n_exc: Column, n_obs: Column, p: float) -> Column:
    """Proportion-of-failures likelihood ratio: twice the sum, over failures and passes, of the count
    times the log of its ratio to the expected count; a count of zero adds nothing."""
    n = n_obs.cast("double")
    part = lambda k, rate: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    failures = n_exc.cast("double")
    return F.when(n > 0, 2.0 * (part(failures, p) + part(n - failures, 1.0 - p))).otherwise(0.0)


def binomial_cdf(n_exc: Column, n_obs: Column, p: float) -> Column:
    """P(X <= n_exc) over n_obs trials, terms chained in logs so nothing overflows."""
    x, n = n_exc.cast("int"), n_obs.cast("double")
    start = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("c"))

    def step(acc, k):
        t = acc["t"] + F.log((n - k + 1) / k) + math.log(p) - math.log1p(-p)
        return F.struct(t.alias("t"), (acc["c"] + F.exp(t)).alias("c"))

    ks = F.when(x >= 1, F.sequence(F.lit(1), x)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ks, start, step, lambda a: a["c"])


def basel_zone(cdf: Column) -> Column:
    return F.when(cdf < 0.95, "green").when(cdf < 0.9999, "amber").otherwise("red")


CHI2_1DF_95 = 3.841


def backtest(s: DataFrame, by: list[str], idx: str, value: str, window: int = 250, alpha: float = 0.99,
             method: str = "fhs", lam: float = 0.94) -> DataFrame:
    """Exceptions, rate, Kupiec test and traffic light per series; too short reads ``insufficient``."""
    p = 1.0 - alpha
    t = var_thresholds(s, by, idx, value, window, alpha, method, lam)
    a = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("thr").isNotNull() & (F.col(value) < F.col("thr")), 1).otherwise(0)).alias("exceptions"))
    tested = F.greatest(F.col("n") - window, F.lit(0))
    a = a.withColumn("tested", tested)
    lr = kupiec_lr(F.col("exceptions"), F.col("tested"), p)
    cdf = binomial_cdf(F.col("exceptions"), F.col("tested"), p)
    ok = F.col("tested") > 0
    return a.select(*by, F.when(ok, "ok").otherwise("insufficient").alias("status"), "tested", "exceptions",
                    F.when(ok, p * F.col("tested")).alias("expected"),
                    F.when(ok, F.col("exceptions") / F.col("tested")).alias("rate"),
                    F.when(ok, lr).alias("kupiec_lr"), F.when(ok, lr > CHI2_1DF_95).alias("kupiec_reject"),
                    F.when(ok, basel_zone(cdf)).alias("basel_zone"), F.when(ok, cdf).alias("binom_cdf"))


# ---- drawdown --------------------------------------------------------------------------------
def drawdown_path(s: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Equity curve, running peak and drawdown per row; ``wiped`` from the first return of -1 or less on,
    where equity is zero for good."""
    w = _w(by, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = s.withColumn("wiped", F.max(F.coalesce(F.col(value) <= -1, F.lit(False))).over(run))
    growth = F.exp(F.coalesce(F.sum(F.when(F.col(value) > -1, F.log1p(value))).over(run), F.lit(0.0)))
    d = d.withColumn("equity", F.when(F.col("wiped"), 0.0).otherwise(growth))
    d = d.withColumn("peak", F.max("equity").over(run)).withColumn("dd", F.coalesce(F.try_divide("equity", "peak"), F.lit(0.0)) - 1)
    return d.withColumn("i", F.row_number().over(w) - 1)


def drawdown(s: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Maximum drawdown with peak, trough and recovery rows and the longest underwater run; the status is
    ``wiped_out`` if a return of -1 or less ended the series' equity."""
    p = drawdown_path(s, by, order, value)
    tr = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("wiped").alias("ruined"), F.min(F.struct("dd", "i")).alias("t"),
                            F.min_by(order, F.struct("dd", "i")).alias("trough"),
                            F.min_by("peak", F.struct("dd", "i")).alias("pk"))
    j = p.join(tr, by)
    a = j.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("ruined").alias("ruined"), F.first("t.dd").alias("max_drawdown"), F.first("trough").alias("trough_date"),
        F.first("t.i").alias("trough_i"),
        F.min(F.when((F.col("i") <= F.col("t.i")) & (F.col("equity") >= F.col("pk")), F.col("i"))).alias("peak_i"),
        F.min(F.when((F.col("i") <= F.col("t.i")) & (F.col("equity") >= F.col("pk")), F.col(order))).alias("peak_date"),
        F.min(F.when((F.col("i") >= F.col("t.i")) & (F.col("equity") >= F.col("pk")), F.col(order))).alias("recovery_date"))
    # islands: rows under water since the last row at the peak
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    under = F.col("equity") < F.col("peak") - 1e-15
    u = p.withColumn("_u", under).withColumn("_g", F.sum(F.when(F.col("_u"), 0).otherwise(1)).over(w))
    run = u.filter("_u").groupBy(*by, "_g").agg(F.count(F.lit(1)).alias("r")).groupBy(*by).agg(F.max("r").alias("longest"))
    out = a.join(run, by, "left")
    ok = F.col("n") >= 2
    return out.select(*by, "n", F.when(ok & F.col("ruined"), "wiped_out").when(ok, "ok").otherwise("insufficient").alias("status"),
                      *[F.when(ok, F.col(c)).alias(c) for c in ("max_drawdown", "peak_date", "trough_date", "recovery_date")],
                      F.when(ok, F.col("trough_i") - F.col("peak_i")).alias("drawdown_obs"),
                      F.when(ok, F.col("recovery_date").isNotNull()).alias("recovered"),
                      F.when(ok, F.coalesce("longest", F.lit(0))).alias("longest_underwater_obs"))


# ---- series statistics -----------------------------------------------------------------------
def rolling_bias(z: DataFrame, by: list[str], on: str, value: str = "z", window: int = 24) -> DataFrame:
    """Std of the trailing ``window`` standardised returns, full frames only, with its 2-sigma band."""
    d = z.filter(F.col(value).isNotNull())
    w = _w(by, on).rowsBetween(-(window - 1), 0)
    return (d.select(*by, on, F.when(F.count(value).over(w) == window, F.stddev_samp(value).over(w)).alias("b"),
                     F.lit(math.sqrt(2.0 / window)).alias("band")).filter(F.col("b").isNotNull()))


def autocorr(u: DataFrame, by: list[str], on: str, value: str, lag: int) -> DataFrame:
    d = u.filter(F.col(value).isNotNull()).withColumn("_l", F.lag(value, lag).over(_w(by, on)))
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(F.when(F.col("_l").isNotNull(), F.col(value)), F.col("_l")).alias("c"))
    return a.select(*by, F.lit(lag).alias("lag"), F.when((F.col("n") > lag + 2) & ~F.isnan("c"), F.col("c")).alias("autocorr"))


def bias_stat(z: DataFrame, by: list[str], value: str = "z", min_n: int = 6) -> DataFrame:
    a = z.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("b"))
    ok = F.col("n") >= min_n
    return a.select(*by, "n", F.when(ok, F.col("b")).alias("bias"), F.when(ok, F.sqrt(F.lit(2.0) / F.col("n"))).alias("half_width"))


def sign_persistence(u: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Share of months whose sign repeats the previous one (more than 3 months) and the hit rate."""
    d = u.filter(F.col(value).isNotNull()).withColumn("_l", F.lag(value).over(_w(by, on)))
    same = F.when(F.col("_l").isNotNull(), (F.signum(value) == F.signum("_l")).cast("double"))
    a = d.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), F.avg(same).alias("p"),
                           F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"))
    return a.select(*by, "months", F.when(F.col("months") > 3, F.col("p")).alias("persistence"), "hit_rate")


def info_ratio(u: DataFrame, by: list[str], value: str, periods: int = 12) -> DataFrame:
    a = u.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return a.select(*by, "n", F.when((F.col("n") >= 3) & (F.col("s") > 0), F.col("m") / F.col("s") * math.sqrt(periods)).alias("ir"))


def monthly_sum(df: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Month totals of months with at least one observation, and their day counts."""
    d = df.filter(F.col(value).isNotNull())
    return d.groupBy(*by, F.last_day(on).alias("month")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("days"))
