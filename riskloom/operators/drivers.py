"""What drove a breach: names, their largest factor, hidden betas, and one common thread behind several.

A name that leaves its band is explained in steps. Its P&L splits into factor and specific parts
(``attribution.position_surprises``); the factor part has a largest contributor, the name's loading at T times what the
factor returned; and if that factor stayed within its own band, the name moved further with it than its
loading says: a hidden beta. Breaches of the specific kind are then tested for moving together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.operators.attribution import comovement


def aggregate_drivers(rows: DataFrame) -> DataFrame:
    """Linkage rows with the driver of Specific and Book total: they have no exposure that could migrate, so a breach is the
    forecast itself (``vol_underforecast``), measured by its own z."""
    breach = (F.col("kind") != "factor") & (F.col("verdict") != "within") & (F.col("sd_base") > 0)
    return rows.withColumns({"driver": F.when(breach, "vol_underforecast").otherwise(F.col("driver")),
                             "factor_sigma": F.when(breach, F.col("z")).otherwise(F.col("factor_sigma"))})


def breach_drivers(surprises: DataFrame, linkage: DataFrame, exposures: DataFrame, panel: DataFrame, lo, hi) -> DataFrame:
    """Names outside their band, with the factor that contributed most over (lo, hi] under the loadings at ``lo``:
    top_factor, top_pnl (of the book), that factor's verdict and hidden_beta.

    A beta is hidden if factors drove the breach, alone or in part, while the factor's own row is within."""
    moved = panel.filter((F.col("Date") > F.lit(lo).cast("date")) & (F.col("Date") <= F.lit(hi).cast("date"))).groupBy("Factor").agg(F.sum("Return").alias("moved"))
    e = exposures.filter(F.col("Date") == F.lit(lo).cast("date")).join(broadcast_if_small(moved), "Factor", "left")
    pnl = F.col("Loading") * F.coalesce("moved", F.lit(0.0))
    top = e.groupBy("Position").agg(F.max(F.struct(F.abs(pnl).alias("size"), F.col("Factor"), pnl.alias("pnl"))).alias("top"))
    named = linkage.filter("kind = 'factor'").select("Book", F.col("name").alias("top_factor"), F.col("verdict").alias("factor_verdict"))
    b = surprises.filter("verdict <> 'within'").join(top, "Position", "left")
    b = b.withColumns({"top_factor": F.col("top.Factor"), "top_pnl": F.col("top.pnl") * F.col("Weight")}).join(broadcast_if_small(named), ["Book", "top_factor"], "left")
    hidden = F.col("driver").isin("factor_move", "mixed") & F.coalesce(F.col("factor_verdict") == "within", F.lit(False))
    return b.select("Book", "Position", "Weight", "realized", "factor_pnl", "specific_pnl", "z", "verdict", "driver", "dust",
                    "top_factor", "top_pnl", "factor_verdict", F.coalesce(hidden, F.lit(False)).alias("hidden_beta"))


def breach_comovement(breaches: DataFrame, frames: Mapping[str, DataFrame], lo, hi, min_obs: int = 20) -> DataFrame:
    """Per book: whether the names with a specific or mixed breach moved together over (lo, hi], and the sector that at
    least two of them share (the commonest; of equals the first by name). Names under the weight floor take no part."""
    names = breaches.filter(F.col("driver").isin("specific_move", "mixed") & ~F.col("dust")).select("Book", "Position")
    sectors = names.join(frames["securities"].select("Position", "Sector"), "Position", "left").groupBy("Book", F.coalesce("Sector", F.lit("?")).alias("Sector")).agg(
        F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("Book").orderBy(F.col("k").desc(), "Sector")  # sectors of a book
    shared = sectors.withColumn("r", F.row_number().over(w)).filter("r = 1").select("Book", F.when(F.col("k") >= 2, F.col("Sector")).alias("shared_sector"))
    return comovement(frames["specific_returns"], names, lo, hi, min_obs).join(shared, "Book", "left")
