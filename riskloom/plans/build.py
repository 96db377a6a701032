"""The frame-build pipeline: landed tables -> the model frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.frames import Frames, staged
from riskloom.operators import descriptors as de, regression as rg, timeseries as ts
from riskloom.operators.universe import range_label


def filing_weights(holdings: DataFrame) -> DataFrame:
    """Collapse lots to (Book, filing_date, Position) and weight them within each filing."""
    p = holdings.groupBy("Book", "filing_date", "Position").agg(F.sum("MV").alias("MV"))
    t = p.groupBy("Book", "filing_date").agg(F.sum("MV").alias("_t"))
    return p.join(t, ["Book", "filing_date"]).withColumn("Weight", F.col("MV") / F.col("_t")).drop("_t")


def positions_on_calendar(weights: DataFrame, until: Column) -> DataFrame:
    """Each book's latest filing in force at every month-end; only that filing's names are held, so
    exits expire. A filing's validity is exploded into its month-ends and met by equality."""
    f = weights.select("Book", "filing_date").distinct()
    nxt = F.lead("filing_date").over(Window.partitionBy("Book").orderBy("filing_date"))
    f = f.withColumns({"_n": nxt}).withColumn("_u", F.greatest(F.coalesce("_n", until), F.col("filing_date")))
    m = f.select("Book", "filing_date", "_n", F.explode(F.sequence(F.trunc("filing_date", "month"), F.trunc("_u", "month"),
                                                                    F.expr("interval 1 month"))).alias("_x"))
    m = m.withColumn("Date", F.last_day("_x")).filter(
        (F.col("Date") <= until) & (F.col("Date") >= F.col("filing_date")) & (F.col("_n").isNull() | (F.col("Date") < F.col("_n"))))
    return weights.join(F.broadcast(m.select("Book", "filing_date", "Date")), ["Book", "filing_date"])


def coverage_universe(held: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed names and held names once each; only seed names are estimated on."""
    s = seed.select("Position", F.lit(True).alias("is_estimation"))
    u = s.unionByName(held.select("Position").distinct().join(s, "Position", "left_anti").withColumn("is_estimation", F.lit(False)))
    return u.dropDuplicates(["Position"])


def build_frames(holdings: DataFrame, prices: DataFrame, market: DataFrame, proxies: dict[str, DataFrame], funda: DataFrame,
                 securities: DataFrame, seed: DataFrame, min_names: int = rg.MIN_NAMES) -> Frames:
    """Holdings (Book, filing_date, Position, MV), prices, proxies, fundamentals and securities ->
    exposures, positions, securities, factor_meta, factor_returns, specific_returns, specific_var."""
    spark = holdings.sparkSession
    until = prices.agg(F.last_day(F.max("Date"))).scalar()
    uni = coverage_universe(holdings, seed)
    raw = staged(de.raw_descriptors(prices, market, proxies, funda, uni, until))
    styles = staged(de.build_loadings(raw))
    ret = ts.returns(prices, ["Position"]).select("Position", "Date", ts.mask_return(F.col("ret")).alias("ret"))
    design = staged(rg.designs(styles, securities, uni.filter("is_estimation"), min_names=min_names))
    stats = staged(rg.regress_factors(design, ret, min_names=min_names))
    fr = stats.select("Date", "Factor", "Return")
    expo = staged(de.leaf_augment(styles, securities, fr))
    sr = staged(rg.residuals(ret, expo, fr))
    pos = positions_on_calendar(filing_weights(holdings), until)
    pos = pos.join(ts.month_adv(prices), ["Date", "Position"], "left").select("Date", "Book", "Position", "Weight", "MV", "ADV")
    meta = fr.select("Factor").distinct().select("Factor", F.when(F.col("Factor") == "Market", "Market").when(
        F.col("Factor").startswith("Ind:"), "Industry").otherwise("Style").alias("FactorGroup"))
    return Frames(spark, {"exposures": expo, "positions": pos, "securities": securities, "factor_meta": meta, "factor_returns": fr,
                          "specific_returns": sr, "specific_var": ts.specific_variance(sr), "regression_stats": stats})


def with_sectors(securities: DataFrame, code: str) -> DataFrame:
    from riskloom.functions.sectors import SECTOR_RANGES

    return range_label(securities, code, SECTOR_RANGES, "Sector")
