"""Scenario measures over long P&L rows.

``x(cell, Factor)`` meets the shock vectors on Factor and the vectors are summed per (cell, set). A
cell's day vector is bounded by the calendar, so one array per (cell, set) yields the whole ladder:
quantiles, tail means, read-offs and dates; it becomes rows only on request. Contributions that are linear in the exposure (marginal
VaR, ES, volatility) never touch days at cell grain: the book's tail gives one gradient per factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.operators.exposure import KEYS
from riskloom.operators.scenarios import shock_vectors

Z99, Z_ES975 = 2.326, 2.338


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows that are few but expensive. A fixed partition count keeps adaptive
    coalescing (which judges bytes, not work) from folding them into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def pnl_vectors(x: DataFrame, shocks: DataFrame, cell: list[str]) -> DataFrame:
    """``(cell, ScenarioSet) -> pv`` (and the book's ``bv`` when ``x`` carries ``bx``).

    Cells are hashed once; each (cell, factor) row meets its shock vectors by a broadcast and the
    vectors are summed where they are. Days never become rows, so nothing else is shuffled."""
    sv = broadcast_if_small(shock_vectors(shocks))
    pair = "bx" in x.columns
    cols = ["x", "bx"] if pair else ["x"]
    j = spread(x.select(*cell, "Factor", *cols), *cell).join(sv, "Factor")
    a = j.groupBy(*cell, "ScenarioSet").agg(F.collect_list(F.struct(*cols, "ShockVec")).alias("l"))

    def total(weight: str) -> Column:
        zero = F.transform(F.get("l", 0)["ShockVec"], lambda s: F.lit(0.0))
        return F.aggregate("l", zero, lambda acc, e: F.zip_with(
            acc, e["ShockVec"], lambda t, s: t + e[weight] * s))

    out = a.select(*cell, "ScenarioSet", total("x").alias("pv"),
                   *([total("bx").alias("bv")] if pair else []))
    return out


def scenario_dates(shocks: DataFrame) -> DataFrame:
    """(ScenarioSet) -> dv: the date of each vector element."""
    d = shocks.select("ScenarioSet", "day_idx", "scen_date").distinct()
    return d.groupBy("ScenarioSet").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("day_idx", "scen_date"))), lambda s: s["scen_date"]).alias("dv"))


def day_rows(x: DataFrame, shocks: DataFrame, cell: list[str]) -> DataFrame:
    """``(cell, ScenarioSet, day_idx, scen_date) -> p``: the vectors unpacked, one row per day."""
    v = pnl_vectors(x, shocks, cell).join(broadcast_if_small(scenario_dates(shocks)), "ScenarioSet")
    return v.select(*cell, "ScenarioSet", F.posexplode(F.arrays_zip("pv", "dv")).alias("day_idx", "e")).select(
        *cell, "ScenarioSet", "day_idx", F.col("e.dv").alias("scen_date"), F.col("e.pv").alias("p"))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + e)


def mean_of(v: Column) -> Column:
    return _total(v) / F.size(v)


def cov_of(a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """Sample covariance of two aligned vectors about their means; NULL for a single element."""
    n = F.size(a)
    s = F.aggregate(F.zip_with(a, b, lambda p, q: (p - ma) * (q - mb)), F.lit(0.0), lambda t, e: t + e)
    return F.when(n > 1, s / (n - 1))


def quantile_of(v: Column, n: Column, p: float, field: str | None = None) -> Column:
    """Linear interpolation inside a sorted array."""
    pos = F.lit(p) * (n - 1)
    lo = F.floor(pos).cast("int")

    def at(i: Column) -> Column:
        e = F.get(v, i)
        return e[field] if field else e

    a, b = at(lo), at(F.least(lo + 1, (n - 1).cast("int")))
    return a + (b - a) * (pos - F.floor(pos))


def tail_mean(v: Column, n: Column, alpha: float, field: str | None = None) -> Column:
    k = F.ceil(F.lit(alpha) * n).cast("int")
    head = F.slice(v, 1, k)
    return F.aggregate(head, F.lit(0.0), lambda a, e: a + (e[field] if field else e)) / k


def read_off(v: Column, n: Column, p: float) -> Column:
    """Element at the lower index floor(p (n-1))."""
    return F.get(v, F.floor(F.lit(p) * (n - 1)).cast("int"))


def ladder(vectors: DataFrame, dates: DataFrame | None = None, exceedance: bool = False) -> DataFrame:
    """From ``pnl_vectors``: mean, vol, VaR ladder, ES, worst loss (and its date), n per cell."""
    d = vectors.withColumns({"v": F.array_sort("pv"), "mean": mean_of(F.col("pv"))})
    v, n = F.col("v"), F.size("v")
    d = d.withColumn("vol", F.sqrt(cov_of(F.col("pv"), F.col("pv"), F.col("mean"), F.col("mean"))))
    cols = {
        "scn_n": n.cast("long"),
        "var99": -quantile_of(v, n, 0.01), "var975": -quantile_of(v, n, 0.025),
        "var95": -quantile_of(v, n, 0.05), "worst": -F.get(v, 0),
        "es975": -tail_mean(v, n, 0.025), "es99": -tail_mean(v, n, 0.01),
    }
    if exceedance:
        cols["exceed"] = F.when(F.col("vol").isNotNull(), F.size(
            F.filter("pv", lambda e: F.abs(e) > 2 * F.col("vol"))) / n)
    d = d.withColumns(cols)
    if dates is not None:
        d = d.join(broadcast_if_small(dates), "ScenarioSet").withColumn(
            "worst_date", F.get("dv", (F.array_position("pv", F.get(v, 0)) - 1).cast("int"))).drop("dv")
    return d.drop("v", "pv")


def factor_cov(shocks: DataFrame) -> DataFrame:
    """``(ScenarioSet, Factor, Factor2) -> cov``: factors x factors, never names x names."""
    a = shocks.select("ScenarioSet", "day_idx", "Factor", F.col("shock").alias("s1"))
    b = shocks.select("ScenarioSet", "day_idx", F.col("Factor").alias("Factor2"), F.col("shock").alias("s2"))
    return (a.join(b, ["ScenarioSet", "day_idx"])
            .groupBy("ScenarioSet", "Factor", "Factor2").agg(F.covar_samp("s1", "s2").alias("cov")))


def factor_vol(shocks: DataFrame) -> DataFrame:
    return shocks.groupBy("ScenarioSet", "Factor").agg(F.stddev_samp("shock").alias("fvol"))


def book_gradients(bx: DataFrame, shocks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Book scalars and per-factor gradients from book exposures ``bx(keys, Factor, x)``.

    One row per (keys, set, Factor): ``g_var`` (minus the shock on the book's 1 % read-off day),
    ``g_es`` (minus the mean shock over its worst ceil(2.5 %) days), ``g_cov`` (covariance of the
    factor with the book), plus the book's read-off VaR, interpolated VaR and variance.
    """
    v, n = F.col("v"), F.size("v")
    mean = mean_of(F.col("pv"))
    pairs = F.transform("pv", lambda e, i: F.struct(e.alias("p"), i.alias("day_idx")))
    a = (pnl_vectors(bx, shocks, keys).withColumns({"v": F.array_sort(pairs), "mu": mean})
         .withColumn("b_var", cov_of(F.col("pv"), F.col("pv"), F.col("mu"), F.col("mu")))
         .select(*keys, "ScenarioSet", "b_var", read_off(v, n, 0.01)["day_idx"].alias("tail_day"),
                 (-read_off(v, n, 0.01)["p"]).alias("b_read99"),
                 (-quantile_of(v, n, 0.01, "p")).alias("b_var99"),
                 F.slice(v, 1, F.ceil(F.lit(0.025) * n).cast("int")).alias("tail")))
    t = a.select(*keys, "ScenarioSet", "b_var", "b_read99", "b_var99", "tail_day",
                 F.explode("tail").alias("e")).withColumn("day_idx", F.col("e.day_idx")).drop("e")
    s = broadcast_if_small(shocks.select("ScenarioSet", "day_idx", "Factor", "shock"))
    # the read-off day lies inside the worst ceil(2.5 %) days (floor(1 % (n-1)) < ceil(2.5 % n))
    g = t.join(s, ["ScenarioSet", "day_idx"]).groupBy(*keys, "ScenarioSet", "Factor").agg(
        (-F.max(F.when(F.col("day_idx") == F.col("tail_day"), F.col("shock")))).alias("g_var"),
        (-F.avg("shock")).alias("g_es"), F.max("b_var").alias("b_var"),
        F.max("b_read99").alias("b_read99"), F.max("b_var99").alias("b_var99"))
    cov = broadcast_if_small(factor_cov(shocks).withColumnRenamed("Factor", "F1"))
    gc = (bx.select(*keys, F.col("Factor").alias("Factor2"), F.col("x").alias("_x")).join(cov, "Factor2")
          .groupBy(*keys, "ScenarioSet", F.col("F1").alias("Factor"))
          .agg(F.sum(F.col("_x") * F.col("cov")).alias("g_cov")))
    return g.join(gc, [*keys, "ScenarioSet", "Factor"])


def marginals(x: DataFrame, grads: DataFrame, cell: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Linear contributions of each cell: ``m_var``, ``m_es``, ``m_cov`` and the book scalars."""
    j = x.join(grads, [*keys, "Factor"])
    return j.groupBy(*cell, "ScenarioSet").agg(
        F.sum(F.col("x") * F.col("g_var")).alias("m_var"),
        F.sum(F.col("x") * F.col("g_es")).alias("m_es"),
        F.sum(F.col("x") * F.col("g_cov")).alias("m_cov"),
        F.max("b_var").alias("b_var"), F.max("b_read99").alias("b_read99"),
        F.max("b_var99").alias("b_var99"))


def with_book(x: DataFrame, bx: DataFrame, cell: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Densify cells over the book's factors; the book exposure ``bx`` rides beside ``x``."""
    cells = x.select(*cell).distinct()
    big = bx.select(*keys, "Factor", F.col("x").alias("bx"))
    return (cells.join(big, keys).join(x.select(*cell, "Factor", "x"), [*cell, "Factor"], "left")
            .withColumn("x", F.coalesce("x", F.lit(0.0))))


def incrementals(xb: DataFrame, shocks: DataFrame, cell: list[str]) -> DataFrame:
    """Book-without-cell statistics per (cell, set): read-off VaR and variance of b - p."""
    v = pnl_vectors(xb, shocks, cell).withColumn("rv", F.zip_with("bv", "pv", lambda b, p: b - p))
    v = v.withColumns({"rm": mean_of(F.col("rv")), "bm": mean_of(F.col("bv"))})
    v = v.withColumns({"ex_var": cov_of(F.col("rv"), F.col("rv"), F.col("rm"), F.col("rm")),
                       "bk_var": cov_of(F.col("bv"), F.col("bv"), F.col("bm"), F.col("bm")),
                       "rs": F.array_sort("rv"), "bs": F.array_sort("bv")})
    n = F.size("rs")
    return v.select(*cell, "ScenarioSet", "ex_var", "bk_var",
                    (-read_off(F.col("rs"), n, 0.01)).alias("ex_read99"),
                    (-read_off(F.col("bs"), n, 0.01)).alias("bk_read99"))


def cell_variance(x: DataFrame, shocks: DataFrame, cell: list[str]) -> DataFrame:
    """x'Fx per (cell, set) from the factor covariance: factors squared per cell, no days."""
    cov = broadcast_if_small(factor_cov(shocks))
    half = (x.repartition(*cell).select(*cell, "Factor", "x").join(cov, "Factor")
            .groupBy(*cell, "ScenarioSet", "Factor2").agg(F.sum(F.col("x") * F.col("cov")).alias("fx")))
    other = x.select(*cell, F.col("Factor").alias("Factor2"), F.col("x").alias("x2"))
    return (half.join(other, [*cell, "Factor2"]).groupBy(*cell, "ScenarioSet")
            .agg(F.sum(F.col("fx") * F.col("x2")).alias("cell_var")))
