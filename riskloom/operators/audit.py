"""The descriptor audit over trailing windows, at every month-end.

Both questions (which factors move together, which factor hides in the residuals) are ratios of cross-products, and
cross-products add up: each month's sums are made once, centred on the whole history's means so that nothing cancels,
and dealt to the month-ends whose window sees them. A window costs its months, not its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def _month_end(index: Column) -> Column:
    return F.last_day(F.make_date(((index - 1) / 12).cast("int"), F.pmod(index - 1, F.lit(12)) + 1, F.lit(1)))


def trailing(rows: DataFrame, keys: list[str], sums: dict[str, Column], window: int) -> DataFrame:
    """(keys, end) -> the ``sums`` over the ``window`` months up to month ``end``; ``rows`` has month."""
    m = rows.groupBy(*keys, "month").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    m = m.withColumn("end", F.explode(F.sequence("month", F.col("month") + window - 1)))
    return m.groupBy(*keys, "end").agg(*[F.sum(n).alias(n) for n in sums])


def _centred(df: DataFrame, by: str, value: str) -> DataFrame:
    mean = df.groupBy(by).agg(F.avg(value).alias("_mean"))
    return df.join(broadcast_if_small(mean), by).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def _cov(xy: str, x: str, y: str) -> Column:
    return F.col(xy) - F.col(x) * F.col(y) / F.col("n")


def rolling_correlations(panel: DataFrame, window: int = 12, min_obs: int = 20) -> DataFrame:
    """(Date, a, b, rho, n) for a < b at every month-end of ``panel(Date, Factor, Return)``, over the trailing ``window``
    months; windows with fewer than ``min_obs`` days or a constant factor are left out."""
    p = _centred(panel, "Factor", "Return").withColumn("month", month_index(F.col("Date")))
    a = p.select("Date", "month", F.col("Factor").alias("a"), F.col("Return").alias("x"))
    b = p.select("Date", F.col("Factor").alias("b"), F.col("Return").alias("y"))
    x, y = F.col("x"), F.col("y")
    s = trailing(a.join(broadcast_if_small(b), "Date").filter("a < b"), ["a", "b"],
                 {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}, window)
    s = s.join(broadcast_if_small(p.select(F.col("month").alias("end")).distinct()), "end").filter(F.col("n") >= min_obs)
    vx, vy = _cov("xx", "x", "x"), _cov("yy", "y", "y")
    rho = F.when((vx > 1e-18) & (vy > 1e-18), F.try_divide(_cov("xy", "x", "y"), F.sqrt(vx * vy)))
    return s.select(_month_end(F.col("end")).alias("Date"), "a", "b", rho.alias("rho"), F.col("n").cast("long").alias("n")).filter("rho IS NOT NULL")


def rolling_pairs(panel: DataFrame, threshold: float = 0.6, window: int = 12, min_obs: int = 20) -> DataFrame:
    """The collinear pairs of every month-end's window."""
    return rolling_correlations(panel, window, min_obs).filter(F.abs("rho") >= threshold)


def rolling_hidden_betas(specific_returns: DataFrame, panel: DataFrame, held: DataFrame, window: int = 12, min_obs: int = 120) -> DataFrame:
    """OLS of each held name's residual on each factor alone, over the ``window`` months up to every date it is held:
    Date, Book, Position, Factor, Weight, beta, t, n. ``held(Date, Book, Position, Weight)`` has month-ends. Names with
    fewer than ``min_obs`` common days in the window are left out."""
    names = held.select("Position", month_index(F.col("Date")).alias("end")).distinct()
    f = _centred(panel.filter(F.col("Factor") != "Market").select("Date", "Factor", "Return"), "Factor", "Return")
    u = specific_returns.select("Date", "Position", "SpecificReturn").filter(F.col("SpecificReturn").isNotNull())
    u = _centred(u.join(names.select("Position").distinct(), "Position", "left_semi"), "Position", "SpecificReturn")
    j = u.join(broadcast_if_small(f), "Date").withColumn("month", month_index(F.col("Date")))
    x, y = F.col("Return"), F.col("SpecificReturn")
    s = trailing(j, ["Position", "Factor"], {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}, window)
    s = s.join(names, ["Position", "end"], "left_semi").filter(F.col("n") >= min_obs)
    df = F.col("n") - 1
    c, vx, vu = _cov("xy", "x", "y") / df, _cov("xx", "x", "x") / df, _cov("yy", "y", "y") / df
    s = s.withColumns({"c": c, "vx": vx, "vu": vu}).filter(F.col("vx") > 0)
    beta = F.col("c") / F.col("vx")
    se = F.sqrt(F.greatest(F.col("vu") - F.col("c") * beta, F.lit(0.0)) / (F.col("n") * F.col("vx")))
    s = s.select("Position", "Factor", "end", beta.alias("beta"), F.try_divide(beta, se).alias("t"), F.col("n").cast("long").alias("n"))
    h = held.select("Date", "Book", "Position", "Weight").withColumn("end", month_index(F.col("Date")))
    return h.join(s, ["Position", "end"]).select("Date", "Book", "Position", "Factor", "Weight", "beta", "t", "n")


def rolling_beta_summary(betas: DataFrame) -> DataFrame:
    """Per Date, Book and Factor: the unmodelled exposure, its share of significant names and the flag."""
    a = betas.groupBy("Date", "Book", "Factor").agg(
        F.sum(F.col("Weight") * F.col("beta")).alias("book_beta"), F.sum("Weight").alias("weight_tested"),
        F.avg((F.abs("t") > 2).cast("double")).alias("share_sig"), F.count(F.lit(1)).alias("n_names"))
    b = F.abs("book_beta")
    flag = F.when((b >= 0.10) & (F.col("share_sig") >= 0.4), "HIDDEN BETA").when(b >= 0.05, "watch").otherwise("ok")
    return a.withColumns({"wavg_beta": F.try_divide("book_beta", "weight_tested"), "flag": flag})
