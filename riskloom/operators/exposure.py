"""Net exposures, book weights and the specific block, at any grain.

Names are collapsed to factor scalars *before* any scenario is met (eager aggregation): a cell then
costs factors x days, however many names it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["Branch", "Date", "Book"]
SEC_DIMS = ["Country", "Sector", "Issuer", "Position"]
FAC_DIMS = ["FactorGroup", "Factor"]
TOTAL = "TOTAL"
NA = "N/A"


def with_branches(positions: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """Positions with a ``Branch`` column: ``Base`` plus one overriding copy per trade branch.

    ``trades(Branch, Date, Book, Position, Weight)`` replaces the base weight of a name, adds an
    unheld one, and drops it at weight 0. All branches run in the same plan.
    """
    base = positions.withColumn("Branch", F.lit("Base"))
    if trades is None:
        return base
    scope = trades.select("Branch", "Date", "Book").distinct()
    copies = positions.join(F.broadcast(scope), ["Date", "Book"])
    t = trades.select("Branch", "Date", "Book", "Position", F.col("Weight").alias("_tw"))
    over = (copies.join(t, ["Branch", "Date", "Book", "Position"], "full_outer")
            .withColumn("Weight", F.coalesce("_tw", "Weight")).drop("_tw")
            .filter(F.col("Weight") != 0))
    return base.unionByName(over.select(base.columns))


def with_security(df: DataFrame, securities: DataFrame, dims: list[str]) -> DataFrame:
    """Attach security attributes; a name without a row reads ``N/A``."""
    attrs = [d for d in dims if d != "Position" and d not in df.columns]
    if not attrs:
        return df
    s = securities.select("Position", *attrs)
    out = df.join(s, "Position", "left")
    return out.withColumns({a: F.coalesce(a, F.lit(NA)) for a in attrs})


def leaf_rows(positions: DataFrame, exposures: DataFrame, securities: DataFrame,
              factor_meta: DataFrame, dims: list[str]) -> DataFrame:
    """``keys, dims, Factor, x, n``: loading x weight of each position and factor, not yet summed."""
    p = with_security(positions, securities, [d for d in dims if d in SEC_DIMS])
    sec = [d for d in dims if d in SEC_DIMS]
    e = exposures.select("Date", "Position", "Factor", "Loading")
    j = p.select("Branch", "Date", "Book", "Position", "Weight", *[d for d in sec if d != "Position"])
    j = j.join(e, ["Date", "Position"])
    x = j.select(*KEYS, *sec, "Factor", (F.col("Loading") * F.col("Weight")).alias("x"), F.lit(1).cast("long").alias("n"))
    if "FactorGroup" in dims:
        fm = factor_meta.select("Factor", "FactorGroup")
        x = x.join(F.broadcast(fm), "Factor", "left").withColumn(
            "FactorGroup", F.coalesce("FactorGroup", F.lit(NA)))
    return x


def leaf_exposure(rows: DataFrame, dims: list[str]) -> DataFrame:
    """``(keys, dims, Factor) -> x, n``: :func:`leaf_rows` summed at the finest grain asked for."""
    return rows.groupBy(*KEYS, *dict.fromkeys([*dims, "Factor"])).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def cell_dims(dims: list[str]) -> list[str]:
    return [f"c_{d}" for d in dims]


def cell_rows(leaf: DataFrame, dims: list[str], grain: list[str]) -> DataFrame:
    """Rows of the cells of one grain: dims outside it read TOTAL."""
    cols = [(F.col(d) if d in grain else F.lit(TOTAL)).alias(f"c_{d}") for d in dims]
    return leaf.select(*KEYS, *cols, "Factor", "x", "n")


def roll_up(leaf: DataFrame, dims: list[str], grain: list[str]) -> DataFrame:
    """Cells of one grain; the factor scalars stay apart."""
    return cell_rows(leaf, dims, grain).groupBy(*KEYS, *cell_dims(dims), "Factor").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def weight_block(positions: DataFrame, specific_var: DataFrame, exposures: DataFrame,
                 securities: DataFrame, sec_dims: list[str]) -> DataFrame:
    """``(keys, sec_dims) -> svar, net_w, gross_w``, once per (Date, Position).

    Specific risk never meets factor rows, so it cannot fan out."""
    p = with_security(positions, securities, sec_dims)
    p = p.join(exposures.select("Date", "Position"), ["Date", "Position"], "left_semi")
    p = p.join(specific_var.select("Date", "Position", "SpecificVar"), ["Date", "Position"], "left")
    w = F.col("Weight")
    return p.groupBy(*KEYS, *sec_dims).agg(
        F.sum(w * w * F.col("SpecificVar")).alias("svar"),
        F.sum(w).alias("net_w"), F.sum(F.abs(w)).alias("gross_w"))


def net_exposure(positions: DataFrame, exposures: DataFrame, by: list[str]) -> DataFrame:
    """Net exposure of plain positions by any of their columns and Factor."""
    j = positions.join(exposures.select("Date", "Position", "Factor", "Loading"), ["Date", "Position"])
    return j.groupBy(*by).agg(F.sum(F.col("Loading") * F.col("Weight")).alias("x"))


def isin_filters(filters: dict[str, list]) -> Column | None:
    """AND across dimensions, IN within one; empty lists do not filter."""
    cond = None
    for d, members in filters.items():
        if not members:
            continue
        c = F.col(d).isin(*members)
        cond = c if cond is None else (cond & c)
    return cond
