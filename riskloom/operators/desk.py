"""Desk analytics: stress, hedges, limits, liquidity, what-if comparisons and cross-checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.functions.linalg import solve_by_key
from riskloom.operators import measures as ms

# fixed values: default desk limits (metric, scope, warn, limit)
DEFAULT_LIMITS = [
    ("Scenario VaR 99", "book", 0.045, 0.055),
    ("Scenario ES 97.5", "book", 0.050, 0.065),
    ("Top-5 risk share", "book", 0.400, 0.500),
    ("single_name_weight", "concentration", 0.080, 0.100),
    ("sector_weight", "concentration", 0.300, 0.400),
]


def rag(value: Column, warn: Column, limit: Column) -> Column:
    """Traffic light of an upper-bound limit."""
    return (F.when(value.isNull() | limit.isNull(), "unknown").when(value >= limit, "breach")
            .when(value >= warn, "amber").otherwise("green"))


def parse_limits(configs: DataFrame, config: str = "config") -> DataFrame:
    """Limit table of each Book's JSON text: (Book, scope, metric, warn, limit, calibrated_for, scenario_set).

    The text has the sections ``book`` and ``concentration``, each metric -> {warn, limit}. Keys that
    begin with ``_`` are comments; what a text leaves out (all of it, if it is no JSON) is the default."""
    levels = "map<string,struct<warn:double,limit:double>>"
    c = configs.select("Book", F.from_json(F.col(config), f"calibrated_for string, scenario_set string, book {levels}, concentration {levels}").alias("c"))
    head = c.select("Book", F.col("c.calibrated_for").alias("calibrated_for"), F.coalesce("c.scenario_set", F.lit("HistFull")).alias("scenario_set"))
    own = None
    for scope in ("book", "concentration"):
        part = c.select("Book", F.lit(scope).alias("scope"), F.explode(f"c.{scope}").alias("metric", "v"))
        own = part if own is None else own.unionByName(part)
    own = own.filter(~F.col("metric").startswith("_")).select("Book", "scope", "metric", F.col("v.warn").alias("w"), F.col("v.limit").alias("l"))
    preset = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(sc).alias("scope"), F.lit(w).alias("w0"), F.lit(lim).alias("l0")) for m, sc, w, lim in DEFAULT_LIMITS])
    base = head.select("Book", F.explode(preset).alias("d")).select("Book", "d.*")
    return (base.join(own, ["Book", "scope", "metric"], "full_outer").join(head, "Book")
            .select("Book", "scope", "metric", F.coalesce("w", "w0").alias("warn"), F.coalesce("l", "l0").alias("limit"), "calibrated_for", "scenario_set"))


def severity(status: Column) -> Column:
    return F.when(status == "green", 0).when(status == "unknown", 1).when(status == "amber", 2).otherwise(3)


def check_limits(measured: DataFrame, limits: DataFrame, calibrated_for: str | None = None) -> DataFrame:
    """``measured(Book, metric, value, detail)`` against ``limits(Book, metric, warn, limit)``.

    A limit row with Book ``*`` applies to every book without its own; the verdict discloses whether
    the threshold was set for another book."""
    own = limits.filter(F.col("Book") != "*").select("Book", "metric", F.col("warn").alias("w1"), F.col("limit").alias("l1"))
    any_ = limits.filter(F.col("Book") == "*").select("metric", F.col("warn").alias("w2"), F.col("limit").alias("l2"))
    j = measured.join(F.broadcast(own), ["Book", "metric"], "left").join(F.broadcast(any_), "metric", "left")
    warn, lim = F.coalesce("w1", "w2"), F.coalesce("l1", "l2")
    cross = F.lit(False) if calibrated_for is None else F.col("l1").isNull() & (F.col("Book") != calibrated_for)
    return j.filter(lim.isNotNull()).select("Book", "metric", "value", warn.alias("warn"), lim.alias("limit"),
                                            rag(F.col("value"), warn, lim).alias("status"), (lim - F.col("value")).alias("headroom"),
                                            "detail", cross.alias("cross_book"))


def overall_status(checks: DataFrame) -> DataFrame:
    return checks.groupBy("Book").agg(F.max_by("status", severity(F.col("status"))).alias("status"),
                                      F.sum((F.col("status") == "breach").cast("long")).alias("breaches"))


def concentration_values(positions: DataFrame, securities: DataFrame) -> DataFrame:
    """Largest name and largest sector weight per book of one date, with their labels."""
    p = positions.join(securities.select("Position", "Ticker", "Sector"), "Position", "left")
    n = p.groupBy("Book").agg(F.max("Weight").alias("value"), F.max_by("Ticker", F.struct("Weight", "Position")).alias("detail"))
    g = p.groupBy("Book", "Sector").agg(F.sum("Weight").alias("w"))
    s = g.groupBy("Book").agg(F.max("w").alias("value"), F.max_by("Sector", F.struct("w", "Sector")).alias("detail"))
    return (n.select("Book", F.lit("single_name_weight").alias("metric"), "value", "detail")
            .unionByName(s.select("Book", F.lit("sector_weight").alias("metric"), "value", "detail")))


def latest_positions(positions: DataFrame, asof) -> DataFrame:
    """Each book's holdings at its latest date on or before ``asof``."""
    p = positions.filter(F.col("Date") <= F.lit(asof))
    d = p.groupBy("Book").agg(F.max("Date").alias("Date"))
    return p.join(F.broadcast(d), ["Book", "Date"], "left_semi")


# ---- stress ------------------------------------------------------------------------------------
def factor_stress(x: DataFrame, vols: DataFrame, shocks: DataFrame) -> DataFrame:
    """Per ShockId, book and factor: x, sigma, vol, shock return and P&L. ``shocks(ShockId, Factor, sigma)``."""
    return (x.join(F.broadcast(vols), "Factor").join(F.broadcast(shocks), "Factor")
            .withColumn("shock_return", F.col("sigma") * F.col("fvol"))
            .withColumn("pnl", F.col("x") * F.col("shock_return")))


def conditional_shocks(cov: DataFrame, shocks: DataFrame) -> DataFrame:
    """Expected move of every factor given the shocked ones, per ShockId: (ShockId, Factor,
    implied_return, implied_sigma, shocked).

    ``cov(Factor, Factor2, cov)`` is factors squared. Only the block of the shocked factors is solved;
    its solution meets the covariance rows in a join."""
    vol = cov.filter(F.col("Factor") == F.col("Factor2")).select("Factor", F.sqrt(F.greatest("cov", F.lit(0.0))).alias("vol"))
    s = shocks.join(broadcast_if_small(vol), "Factor").select("ShockId", "Factor", (F.col("sigma") * F.col("vol")).alias("move"))
    block = (s.join(s.select("ShockId", F.col("Factor").alias("Factor2")), "ShockId").join(broadcast_if_small(cov), ["Factor", "Factor2"])
             .groupBy("ShockId").agg(F.sort_array(F.collect_list(F.struct("Factor", "Factor2", "cov"))).alias("e")))
    moves = s.groupBy("ShockId").agg(F.sort_array(F.collect_list(F.struct("Factor", "move"))).alias("m"))
    one = F.lit(1.0)
    systems = block.join(moves, "ShockId").select(
        "ShockId", F.size("m").alias("k"), F.col("e.cov").alias("a"), F.col("m.move").alias("b"), one.alias("sw"), one.alias("swy"), one.alias("swyy"),
        F.lit(1).cast("long").alias("n"), F.col("m.Factor").alias("names"))

    def solve(t: dict) -> pd.DataFrame:
        return pd.DataFrame({"ShockId": t["key"], "Factor2": list(t["names"]), "load": np.linalg.solve(t["A"], t["b"])})

    load = solve_by_key(systems, "ShockId", solve, "ShockId string, Factor2 string, load double", ["names"])
    implied = (cov.join(broadcast_if_small(load), "Factor2").groupBy("ShockId", "Factor").agg(F.sum(F.col("cov") * F.col("load")).alias("implied_return"))
               .join(broadcast_if_small(vol), "Factor"))
    hit = s.select("ShockId", "Factor", F.lit(True).alias("shocked"))
    return implied.join(hit, ["ShockId", "Factor"], "left").select(
        "ShockId", "Factor", "implied_return", F.when(F.col("vol") > 0, F.col("implied_return") / F.col("vol")).alias("implied_sigma"),
        F.coalesce("shocked", F.lit(False)).alias("shocked"))


def reverse_stress(x: DataFrame, vols: DataFrame, loss: float = 0.05) -> DataFrame:
    """Sigma of each factor alone that loses ``loss``; smallest |sigma| first."""
    d = F.col("x") * F.col("fvol")
    j = x.join(F.broadcast(vols), "Factor").withColumn("sigma_to_breach", F.when(F.abs(d) > 1e-12, F.try_divide(F.lit(-loss), d)))
    return j.withColumn("abs_sigma", F.abs("sigma_to_breach"))


# ---- liquidity ---------------------------------------------------------------------------------
def days_to_liquidate(mv: Column, adv: Column, participation: float) -> Column:
    cap = participation * adv
    return F.when(cap > 0, F.try_divide(mv, cap))


def liquidity(positions: DataFrame, participation: float = 0.20, horizon: float = 5.0) -> DataFrame:
    """Per (Date, Book): share liquid within the horizon, weighted and worst days, no-ADV disclosure."""
    p = positions.withColumn("days", days_to_liquidate(F.col("MV"), F.col("ADV"), participation))
    ok, within = F.col("days").isNotNull(), F.col("days") <= horizon
    z = F.lit(0.0)
    a = p.groupBy("Date", "Book").agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("MV").alias("_mv"), F.sum(F.when(within, F.col("MV")).otherwise(z)).alias("_in"),
        F.sum(F.when(within, F.col("Weight")).otherwise(z)).alias("pct_weight_within_horizon"),
        F.sum(F.when(ok, F.col("Weight") * F.col("days"))).alias("_wd"), F.sum(F.when(ok, F.col("Weight"))).alias("_w"),
        F.max("days").alias("max_days"), F.sum((~ok).cast("long")).alias("n_no_adv"),
        F.sum(F.when(~ok, F.col("Weight")).otherwise(z)).alias("weight_no_adv"))
    return a.select("Date", "Book", "n_names", F.try_divide("_in", "_mv").alias("pct_mv_within_horizon"), "pct_weight_within_horizon",
                    F.try_divide("_wd", "_w").alias("weighted_avg_days"), "max_days", "n_no_adv", "weight_no_adv")


# ---- filings: what changed ----------------------------------------------------------------------
def filing_diff(w0: DataFrame, w1: DataFrame, by: list[str], threshold: float = 0.005) -> DataFrame:
    """Entered, exited and resized names between two holdings ``(by, Position, Weight)``."""
    j = (w0.select(*by, "Position", F.col("Weight").alias("w_before"))
         .join(w1.select(*by, "Position", F.col("Weight").alias("w_after")), [*by, "Position"], "full_outer"))
    d = F.coalesce("w_after", F.lit(0.0)) - F.coalesce("w_before", F.lit(0.0))
    kind = (F.when(F.col("w_before").isNull(), "entered").when(F.col("w_after").isNull(), "exited")
            .when(F.abs(d) > threshold, "resized"))
    return j.withColumns({"change": kind, "delta": d}).filter(F.col("change").isNotNull())


def previous_distinct_book(positions: DataFrame) -> DataFrame:
    """(Book, Date, previous): the latest earlier date whose name set differs, else the earliest.

    Name sets are compared by an order-free fingerprint."""
    from pyspark.sql import Window

    h = F.xxhash64("Position")
    fp = positions.groupBy("Book", "Date").agg(F.struct(F.count(F.lit(1)).alias("c"), F.bit_xor(h).alias("x"),
                                                        F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).alias("f"))
    w = Window.partitionBy("Book").orderBy("Date")
    # the date before the current run of equal sets began
    d = fp.withColumn("_p", F.when(F.lag("f").over(w).isNull() | (F.lag("f").over(w) != F.col("f")), F.lag("Date").over(w)))
    prev = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select("Book", "Date", F.coalesce(prev, F.min("Date").over(Window.partitionBy("Book"))).alias("previous"))


# ---- independent recompute ----------------------------------------------------------------------
def array_recompute(x: DataFrame, shocks: DataFrame, by: list[str]) -> DataFrame:
    """VaR 99 and worst loss by a path that shares nothing with the vector measures: long day rows,
    grouped sums and Spark's percentile."""
    p = (x.join(broadcast_if_small(shocks.select("ScenarioSet", "day_idx", "Factor", "shock")), "Factor")
         .groupBy(*by, "ScenarioSet", "day_idx").agg(F.sum(F.col("x") * F.col("shock")).alias("p")))
    return p.groupBy(*by, "ScenarioSet").agg((-F.percentile("p", F.lit(0.01))).alias("ref_var99"), (-F.min("p")).alias("ref_worst"))


def top_names(positions: DataFrame, k: int = 3) -> DataFrame:
    from riskloom.functions.quantiles import top_k

    return top_k(positions, ["Book"], [F.col("Weight").desc(), "Position"], k)


def verdict_rag(name: Column, v: Column, half: Column) -> Column:
    """Verdict colour of a residual diagnostic by its name (IR, vol ratio, autocorrelation, R2, bias)."""
    return (F.when(name == "ir", F.when(v >= 0.3, "green").when(v <= -0.3, "red").otherwise("amber"))
            .when(name == "vol_ratio", F.when((v >= 0.8) & (v <= 1.25), "green").when((v > 1.5) | (v < 0.6), "red").otherwise("amber"))
            .when(name.startswith("autocorr"), F.when(F.abs(v) < 0.2, "green").when(F.abs(v) > 0.35, "red").otherwise("amber"))
            .when(name == "r2", F.when(v < 0.10, "green").when(v > 0.25, "red").otherwise("amber"))
            .otherwise(F.when(F.abs(v - 1) <= half, "green").when(F.abs(v - 1) > 1.5 * half, "red").otherwise("amber")))
