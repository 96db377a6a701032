"""Residual diagnostics: every verdict on a book's specific P&L in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.operators import attribution as at, timeseries as ts
from riskloom.operators.desk import verdict_rag
from riskloom.operators.regression import residual_regression

CHECKS = ("ir", "vol_ratio", "autocorr1", "autocorr2", "r2", "bias_book", "bias_specific")


def residual_checks(window: DataFrame, vols: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """(Book, name, value, half_width, status) over the artifact rows of ``window`` (``attribution.window_of``), and one row
    ``overall`` per book with its worst status.

    Is the residual large (information ratio, realized over predicted volatility, bias statistics) and is it
    correlated (autocorrelation by month, R2 on the factors by day)? ``vols(Date, Book, book_vol,
    specific_vol)`` are the vols predicted at month-ends, ``factors(Date, names)`` the factor returns. A check that has too
    few observations has no row."""
    u = window.filter((F.col("Kind") == "contribution") & (F.col("Source") == "Specific"))
    month = ts.monthly_sum(u, ["Book"], "Date", "Value")
    bounds = window.groupBy("Book").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    seen = vols.join(broadcast_if_small(bounds), "Book").filter((F.col("Date") >= F.col("lo")) & (F.col("Date") < F.col("hi")))
    none = F.lit(None).cast("double")
    rows = [ts.info_ratio(month, ["Book"], "total").select("Book", F.lit("ir").alias("name"), F.col("ir").alias("value"), none.alias("half_width"))]
    ratio = (u.groupBy("Book").agg(F.stddev_samp("Value").alias("s")).join(seen.groupBy("Book").agg(F.avg("specific_vol").alias("p")), "Book"))
    rows.append(ratio.select("Book", F.lit("vol_ratio"), F.when(F.col("p") > 0, F.try_divide("s", "p")), none))
    rows += [ts.autocorr(month, ["Book"], "month", "total", k).select("Book", F.lit(f"autocorr{k}"), "autocorr", none) for k in (1, 2)]
    fit = residual_regression(u.select("Book", "Date", F.col("Value").alias("u")), factors, names)
    rows.append(fit.groupBy("Book").agg(F.max("r2").alias("r2")).select("Book", F.lit("r2"), "r2", none))
    z = at.calibration(window.drop("lo", "hi"), seen.drop("lo", "hi"))
    rows.append(ts.bias_stat(z, ["Book", "block"]).select("Book", F.concat(F.lit("bias_"), F.col("block")), "bias", "half_width"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    out = out.filter(F.col("value").isNotNull())
    half = F.coalesce("half_width", F.lit(0.3))
    out = out.withColumn("status", verdict_rag(F.col("name"), F.col("value"), half))
    worst = F.max(F.when(F.col("status") == "red", 2).when(F.col("status") == "amber", 1).otherwise(0))
    total = out.groupBy("Book").agg(worst.alias("w")).select("Book", F.lit("overall").alias("name"), none.alias("value"), none.alias("half_width"),
                                                             F.element_at(F.array(F.lit("green"), F.lit("amber"), F.lit("red")), F.col("w") + 1).alias("status"))
    return out.unionByName(total)
