"""Style descriptors: robust cross-sectional scores and their assembly into loadings.

Cross-sections range over names, so centres and scales come from aggregates joined back (exact
bucketed medians, conditional moments), never from a window over a whole date. They are one row per date (and factor), so they
are broadcast: names are not shuffled on a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.frames import staged
from riskloom.functions.joins import asof_join, broadcast_if_small
from riskloom.functions.quantiles import exact_quantiles
from riskloom.operators import timeseries as ts

# fixed values of the model
STYLE_FACTORS = ["Beta", "Size", "Value", "Momentum", "Leverage", "Liquidity", "ResidVol", "EarnYield",
                 "NonLinSize", "RateBeta", "NdxBeta"]
MAD_TO_SIGMA = 1.4826
COVERAGE_CAP = 10.0
MCAP_FLOOR = 1e7
MIN_ESTIMATION = 10
MIN_IMPUTE_FIT = 30


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def clean(c: Column) -> Column:
    """NaN and infinities read NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def robust_scale(df: DataFrame, by: list[str], value: str, ref: Column) -> DataFrame:
    """(by) -> med, scale (1.4826 MAD) over the reference rows."""
    r = df.filter(ref & F.col(value).isNotNull())
    med = staged(exact_quantiles(r, by, value, {"med": 0.5}))  # read by the deviations and beside them
    dev = r.join(F.broadcast(med), by).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    mad = exact_quantiles(dev, by, "_d", {"mad": 0.5})
    return staged(med.join(mad, by).select(*by, "med", (MAD_TO_SIGMA * F.col("mad")).alias("scale")))  # read by the moments and the scores


def robust_z(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """Median/MAD score clipped at 3 and re-standardised; NULL in a degenerate cross-section."""
    s = robust_scale(df, by, value, F.lit(True))
    d = df.join(F.broadcast(s), by, "left").withColumn("_z", F.when(F.col("scale") > 1e-12, clip(
        F.try_divide(F.col(value) - F.col("med"), F.col("scale")), -3, 3)))
    m = d.groupBy(*by).agg(F.avg("_z").alias("_mu"), F.stddev_samp("_z").alias("_sd"))
    return (d.join(F.broadcast(m), by, "left").withColumn(out, (F.col("_z") - F.col("_mu")) / (F.col("_sd") + 1e-12))
            .drop("med", "scale", "_z", "_mu", "_sd"))


def split_z(df: DataFrame, by: list[str], value: str, ref: str, out: str = "z") -> DataFrame:
    """Score against the reference (estimation) rows: they are clipped at 3, coverage rows only at
    the cap; both share the reference's clipped mean and deviation."""
    s = robust_scale(df, by, value, F.col(ref))
    d = df.join(F.broadcast(s), by, "left").withColumn("_z", F.when(
        F.col("scale") > 1e-12, F.try_divide(F.col(value) - F.col("med"), F.col("scale"))))
    c3 = clip(F.col("_z"), -3, 3)
    m = d.groupBy(*by).agg(F.avg(F.when(F.col(ref), c3)).alias("_mu"), F.stddev_samp(F.when(F.col(ref), c3)).alias("_sd"))
    zo = F.when(F.col(ref), c3).otherwise(clip(F.col("_z"), -COVERAGE_CAP, COVERAGE_CAP))
    return (d.join(F.broadcast(m), by, "left").withColumn(out, F.when(F.col("_sd") > 1e-12, F.try_divide(zo - F.col("_mu"), F.col("_sd"))))
            .drop("med", "scale", "_z", "_mu", "_sd"))


def with_reference(df: DataFrame, by: list[str], est: str = "is_estimation", out: str = "ref") -> DataFrame:
    """Reference flag: the estimation rows, or all rows where fewer than ten exist."""
    n = df.groupBy(*by).agg(F.sum(F.col(est).cast("int")).alias("_ne"))
    return df.join(F.broadcast(n), by).withColumn(out, F.col(est) | (F.col("_ne") < MIN_ESTIMATION)).drop("_ne")


def fit_line(df: DataFrame, by: list[str], y: Column, x: Column, use: Column) -> DataFrame:
    """Per group OLS y = slope x + icpt over the rows where ``use``."""
    yy, xx = F.when(use, y), F.when(use, x)
    return df.groupBy(*by).agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("icpt"),
                               F.sum(F.when(use & y.isNotNull() & x.isNotNull(), 1).otherwise(0)).alias("n_fit"))


def price_descriptors(px: DataFrame, market: DataFrame, proxies: dict[str, DataFrame], until: Column) -> DataFrame:
    """(Date, Position) month-end Beta, ResidVol, partial betas, Momentum, LogADV and Close, each under
    its own history gate, as of the last row on or before the month-end."""
    # dealt by name once; every window follows a name's days and each step carries the columns of those before it, so that
    # nothing is dealt again by name and day
    d = ts.momentum(px.repartition("Position"), keep=("Close", "Volume"))
    d = ts.returns(ts.log_dollar_volume(d, keep=("Close", "Momentum")), ["Position"])
    d = ts.betas(d, market, proxies, keep=("Close", "Momentum", "LogADV"))
    d = (d.filter(F.col("Position").isNotNull() & F.col("Date").isNotNull())
         .select("Position", "Date", "Beta", "ResidVol", *proxies, "Momentum", "LogADV", "Close"))
    return ts.month_snapshots(d, ["Position"], "Date", until).drop("as_of")


def fundamental_descriptors(close: DataFrame, funda: DataFrame) -> DataFrame:
    """Size, Value, EarnYield, Leverage from the filing in force at each month-end; ``close`` keeps its other columns."""
    f = asof_join(close, funda, ["Position"], "Date", "filed")
    mcap = F.col("Close") * F.col("Shares")
    f = f.withColumn("mcap", F.when(mcap > MCAP_FLOOR, mcap))
    liab = F.coalesce("Liabilities", F.col("Assets") - F.col("Equity"))
    return f.select("Date", "Position", *[c for c in close.columns if c not in ("Date", "Position", "Close")], F.log(F.col("mcap") + 1).alias("Size"),
                    (F.col("Equity") / (F.col("mcap") + 1)).alias("Value"),
                    (F.col("NetIncome") / (F.col("mcap") + 1)).alias("EarnYield"),
                    F.try_divide(liab, F.col("Assets") + 1).alias("Leverage"))


def impute_size(raw: DataFrame) -> DataFrame:
    """Coverage rows without a share count take log-mcap from the date's estimation line on log-ADV."""
    est = F.col("is_estimation")
    line = fit_line(raw, ["Date"], F.col("Size"), F.col("LogADV"), est)
    need = ~est & F.col("Size").isNull() & F.col("LogADV").isNotNull() & (F.col("n_fit") >= MIN_IMPUTE_FIT)
    d = raw.join(F.broadcast(line), "Date", "left").withColumn("imputed", F.coalesce(need, F.lit(False)))
    return d.withColumn("Size", F.when(F.col("imputed"), F.col("slope") * F.col("LogADV") + F.col("icpt"))
                        .otherwise(F.col("Size"))).drop("slope", "icpt", "n_fit")


def size_residual(df: DataFrame, value: Column, size: Column, out: str) -> DataFrame:
    """value - (slope size + icpt), fitted on reference rows with missing read as 0."""
    z = F.lit(0.0)
    line = fit_line(df, ["Date"], F.coalesce(value, z), F.coalesce(size, z), F.col("ref"))
    return (df.join(F.broadcast(line), "Date", "left")
            .withColumn(out, value - (F.col("slope") * size + F.col("icpt"))).drop("slope", "icpt", "n_fit"))


def build_loadings(raw: DataFrame) -> DataFrame:
    """Raw descriptors (Date, Position, is_estimation, columns) -> (Date, Position, Factor, Loading)."""
    both = F.col("LogADV").isNotNull() & F.col("Size").isNotNull()
    d = raw.withColumn("Liquidity", F.when(both, F.col("LogADV") - F.col("Size")))
    d = with_reference(impute_size(d), ["Date"])
    first = [s for s in STYLE_FACTORS if s != "NonLinSize"]
    long = d.select("Date", "Position", "ref", *[clean(F.col(c)).alias(c) for c in first]).unpivot(
        ["Date", "Position", "ref"], first, "Factor", "v")
    # each score reads its input several times (median, deviation, moments): stage in between
    z = staged(split_z(staged(long), ["Date", "Factor"], "v", "ref"))
    # every name has a row for every factor
    wide = z.filter(F.col("Factor").isin("Size", "Liquidity")).groupBy("Date", "Position", "ref").pivot("Factor", ["Size", "Liquidity"]).agg(F.first("z"))
    s3 = clip(F.col("Size"), -3, 3)
    wide = staged(wide.withColumn("s3", s3))
    nl = size_residual(wide, F.col("s3") ** 3, F.col("s3"), "v").withColumn("Factor", F.lit("NonLinSize"))
    lq = size_residual(wide, F.col("Liquidity"), F.col("Size"), "v").withColumn("Factor", F.lit("Liquidity"))
    cols = ["Date", "Position", "ref", "Factor", "v"]
    second = split_z(staged(nl.select(cols).unionByName(lq.select(cols))), ["Date", "Factor"], "v", "ref")
    second = second.withColumn("z", F.when(F.col("Factor") == "NonLinSize", clip(F.col("z"), -3, 3)).otherwise(F.col("z")))
    out = z.filter(F.col("Factor") != "Liquidity").select("Date", "Position", "Factor", "z").unionByName(
        second.select("Date", "Position", "Factor", "z"))
    return out.filter(F.col("z").isNotNull()).withColumnRenamed("z", "Loading")


def raw_descriptors(px: DataFrame, market: DataFrame, proxies: dict[str, DataFrame], funda: DataFrame,
                    universe: DataFrame, until: Column) -> DataFrame:
    """Price and fundamental descriptors of every name and month-end with the estimation flag."""
    # the filings have a row for every price row, so the price columns ride along instead of being joined back
    f = fundamental_descriptors(price_descriptors(px, market, proxies, until), funda)
    return (f.join(broadcast_if_small(universe.select("Position", "is_estimation")), "Position")
            .withColumn("is_estimation", F.coalesce("is_estimation", F.lit(False))))


def leaf_augment(loadings: DataFrame, securities: DataFrame, factor_returns: DataFrame) -> DataFrame:
    """Add Market = 1 for every (Date, Position) and Ind:<sector> = 1 where that industry earned a return."""
    names = loadings.select("Date", "Position").distinct()
    mkt = names.select("*", F.lit("Market").alias("Factor"), F.lit(1.0).alias("Loading"))
    paid = factor_returns.filter(F.col("Factor").startswith("Ind:")).select("Factor").distinct()
    ind = (names.join(securities.select("Position", F.concat(F.lit("Ind:"), "Sector").alias("Factor")), "Position")
           .join(F.broadcast(paid), "Factor", "left_semi").select("Date", "Position", "Factor", F.lit(1.0).alias("Loading")))
    return loadings.select("Date", "Position", "Factor", "Loading").unionByName(mkt).unionByName(ind)


def coverage_gate(loadings: DataFrame, styles: int) -> DataFrame:
    """Names carrying a majority of the style loadings per date."""
    n = loadings.groupBy("Date", "Position").agg(F.count("Loading").alias("n_descriptors"))
    return n.filter(F.col("n_descriptors") >= styles // 2 + 1)
