"""Data-quality suite and descriptor audit: one aggregate per check, unioned into tidy rows."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom import schema
from riskloom.functions.joins import broadcast_if_small
from riskloom.functions.linalg import cross_products, solve_by_key
from riskloom.functions.quantiles import exact_quantiles

CHECKED = ["exposures", "positions", "securities", "factor_meta", "factor_returns", "specific_var"]
COVERAGE_CAP = 10.0


def _row(df: DataFrame, name: str, bad: Column, level: str = "FAIL", value: Column | None = None) -> DataFrame:
    """One (level, name, value) row from a one-row aggregate ``df``."""
    return df.select(F.when(bad, level).otherwise("PASS").alias("level"), F.lit(name).alias("name"),
                     (value if value is not None else F.lit(None)).cast("double").alias("value"))


def key_checks(f: Mapping[str, DataFrame]) -> list[DataFrame]:
    out = []
    for n in CHECKED:
        keys = schema.KEYS[n]
        dup = f[n].groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("v"))
        out.append(_row(dup, f"{n}: key unique", F.col("v") > 0, value=F.col("v")))
        null = None
        for k in keys:
            null = F.col(k).isNull() if null is None else null | F.col(k).isNull()
        nk = f[n].agg(F.count_if(null).alias("v"))
        out.append(_row(nk, f"{n}: no null keys", F.col("v") > 0, value=F.col("v")))
    return out


def orphan_checks(f: Mapping[str, DataFrame]) -> list[DataFrame]:
    pairs = [("exposures", "Position", "securities"), ("positions", "Position", "securities"), ("specific_var", "Position", "securities"),
             ("exposures", "Factor", "factor_meta"), ("factor_returns", "Factor", "factor_meta")]
    out = []
    for n, c, u in pairs:
        o = f[n].select(c).distinct().join(f[u].select(c), c, "left_anti").agg(F.count(F.lit(1)).alias("v"))
        out.append(_row(o, f"{n}.{c} in {u}", F.col("v") > 0, value=F.col("v")))
    return out


def range_checks(f: Mapping[str, DataFrame]) -> list[DataFrame]:
    pos, sv, e, fr = f["positions"], f["specific_var"], f["exposures"], f["factor_returns"]
    w = pos.groupBy("Book", "Date").agg(F.abs(F.sum("Weight") - 1).alias("d")).agg(F.count_if(F.col("d") > 1e-6).alias("v"))
    lim = COVERAGE_CAP * 1.5
    return [
        _row(w, "positions: weights sum to 1 per book and date", F.col("v") > 0, value=F.col("v")),
        _row(pos.agg(F.count_if(F.col("Weight") < 0).alias("v")), "positions: no negative weights", F.col("v") > 0, "WARN", F.col("v")),
        _row(sv.agg(F.count_if(F.col("SpecificVar") < 0).alias("v")), "specific_var: non-negative", F.col("v") > 0, value=F.col("v")),
        _row(e.agg(F.count_if(F.col("Loading").isNull()).alias("v")), "exposures: no null loadings", F.col("v") > 0, value=F.col("v")),
        _row(e.agg(F.count_if(F.abs("Loading") > lim).alias("v")), "exposures: loadings within the coverage cap", F.col("v") > 0, "WARN", F.col("v")),
        _row(fr.agg(F.count_if(F.abs("Return") > 0.5).alias("v")), "factor_returns: |return| <= 50%", F.col("v") > 0, "WARN", F.col("v")),
    ]


def calendar_checks(f: Mapping[str, DataFrame]) -> list[DataFrame]:
    out = []
    for n in ("exposures", "positions"):
        a = f[n].agg(F.count_distinct("Date").alias("d"), F.min("Date").alias("a"), F.max("Date").alias("b")).select(
            (F.months_between(F.last_day("b"), F.last_day("a")).cast("long") + 1 - F.col("d")).alias("v"))
        out.append(_row(a, f"{n}: monthly calendar gap-free", F.col("v") > 0, "WARN", F.col("v")))
    days = f["factor_returns"].select("Date").distinct()
    gap = days.withColumn("g", F.datediff("Date", F.lag("Date").over(Window.partitionBy(F.lit(0)).orderBy("Date")))).agg(F.max("g").alias("v"))
    out.append(_row(gap, "factor_returns: daily calendar", F.col("v") > 7, "WARN", F.col("v")))
    return out


def coverage_checks(f: Mapping[str, DataFrame]) -> list[DataFrame]:
    held = f["positions"].select("Date", "Position").distinct()
    out = []
    for n in ("exposures", "specific_var"):
        h = f[n].select("Date", "Position").distinct().withColumn("_h", F.lit(True))
        v = held.join(h, ["Date", "Position"], "left").agg(F.avg(F.col("_h").isNull().cast("double")).alias("v"))
        out.append(_row(v, f"held positions have {n} on the same date", F.col("v") > 0.05, "WARN", F.col("v")))
    st = f["factor_meta"].filter(F.col("FactorGroup") == "Style").select("Factor")
    gate = st.agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("g")).scalar()
    c = (f["exposures"].join(F.broadcast(st), "Factor", "left_semi").groupBy("Date", "Position").agg(F.count_distinct("Factor").alias("c"))
         .withColumn("g", gate).agg(F.count_if(F.col("c") < F.col("g")).alias("v")))
    out.append(_row(c, "exposures: majority of style loadings per name and date", F.col("v") > 0, "WARN", F.col("v")))
    s = f["securities"].agg(F.avg((F.col("Sector") == "Unknown").cast("double")).alias("v"))
    out.append(_row(s, "securities: Sector populated", F.col("v") > 0, "WARN", F.col("v")))
    return out


def model_checks(f: Mapping[str, DataFrame], estimation: DataFrame | None = None) -> list[DataFrame]:
    """Style medians near 0 on the latest date over the estimation names; size-proxy disclosure."""
    e = f["exposures"]
    last = e.agg(F.max("Date")).scalar()
    d = e.filter(F.col("Date") == last).join(F.broadcast(f["factor_meta"].filter(F.col("FactorGroup") == "Style").select("Factor")), "Factor", "left_semi")
    if estimation is not None:
        d = d.join(estimation.filter("is_estimation").select("Position"), "Position", "left_semi")
    med = exact_quantiles(d, ["Factor"], "Loading", {"m": 0.5}).agg(F.max(F.abs("m")).alias("v"))
    out = [_row(med, "exposures: style medians near zero", F.col("v") > 0.5, "WARN", F.col("v"))]
    pos = f["positions"]
    pl = pos.filter(F.col("Date") == pos.agg(F.max("Date")).scalar())
    have = e.filter(F.col("Date") == last).groupBy("Position").agg(
        F.count_if(F.col("Factor") == "Size").alias("s"), F.count_if(F.col("Factor") == "Value").alias("v")).filter("s > 0 and v = 0")
    w = (pl.join(have.select("Position", F.lit(True).alias("p")), "Position", "left").groupBy("Book")
         .agg(F.sum(F.when(F.col("p"), F.col("Weight")).otherwise(0.0)).alias("w")).agg(F.max("w").alias("v")))
    out.append(_row(w, "size-proxy loadings of the held book", F.col("v") > 0.25, "WARN", F.col("v")))
    return out


def regression_checks(stats: DataFrame) -> list[DataFrame]:
    d = stats.groupBy("Date").agg(F.first("R2").alias("R2"), F.first("N").alias("N"))
    v = d.agg(F.min("N").alias("n"), F.count_if((F.col("R2") < 0) | (F.col("R2") > 1)).alias("v"))
    return [_row(v, "regression_stats: breadth and R2 range", (F.col("n") < 30) | (F.col("v") > 0), "WARN", F.col("v"))]


def psd_check(cov: DataFrame) -> DataFrame:
    """Smallest eigenvalue of the factor covariance (K x K) must not be negative."""
    c = cov.groupBy().agg(F.array_sort(F.collect_list(F.struct("Factor", "Factor2", "cov"))).alias("c"))

    def eig(batches):
        for pdf in batches:
            out = []
            for m in pdf["c"]:
                k = int(round(len(m) ** 0.5))
                v = float(np.linalg.eigvalsh(np.array([e["cov"] for e in m]).reshape(k, k)).min())
                out.append(["FAIL" if v < -1e-12 else "PASS", "factor covariance PSD", v])
            yield pd.DataFrame(out, columns=["level", "name", "value"])

    return c.mapInPandas(eig, "level string, name string, value double")


def run_checks(f: Mapping[str, DataFrame], estimation: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    rows = key_checks(f) + orphan_checks(f) + range_checks(f) + calendar_checks(f) + coverage_checks(f) + model_checks(f, estimation)
    if stats is not None:
        rows += regression_checks(stats)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ---- descriptor audit ----------------------------------------------------------------------------
def factor_correlations(panel: DataFrame) -> DataFrame:
    """(a < b) -> rho over complete days; factors squared, bounded."""
    x = panel.select("Date", F.col("Factor").alias("a"), F.col("Return").alias("ra"))
    y = panel.select("Date", F.col("Factor").alias("b"), F.col("Return").alias("rb"))
    return (x.join(y, "Date").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n")))


def collinear_pairs(panel: DataFrame, threshold: float = 0.6) -> DataFrame:
    return factor_correlations(panel).filter(F.abs("rho") >= threshold)


def hidden_betas(specific_returns: DataFrame, panel: DataFrame, held: DataFrame, min_obs: int = 120) -> DataFrame:
    """Univariate OLS of each held name's residual on each factor: beta, t, n per (Book, Position, Factor)."""
    f = panel.filter(F.col("Factor") != "Market").select("Date", "Factor", "Return")
    u = specific_returns.join(held.select("Position").distinct(), "Position", "left_semi")
    j = u.join(F.broadcast(f), "Date")
    a = j.groupBy("Position", "Factor").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("SpecificReturn", "Return").alias("c"),
                                            F.var_samp("Return").alias("vx"), F.var_samp("SpecificReturn").alias("vu"))
    a = a.filter((F.col("n") >= min_obs) & (F.col("vx") > 0))
    b = F.col("c") / F.col("vx")
    # residual variance of u - b x about its mean: vu - c^2 / vx
    se = F.sqrt(F.greatest(F.col("vu") - F.col("c") * b, F.lit(0.0)) / (F.col("n") * F.col("vx")))
    a = a.withColumns({"beta": b, "t": F.try_divide(b, se)})
    return a.join(held.select("Book", "Position", "Weight"), "Position").select("Book", "Position", "Factor", "Weight", "beta", "t", "n")


def hidden_beta_summary(betas: DataFrame) -> DataFrame:
    a = betas.groupBy("Book", "Factor").agg(
        F.sum(F.col("Weight") * F.col("beta")).alias("book_beta"), F.sum("Weight").alias("weight_tested"),
        F.avg((F.abs("t") > 2).cast("double")).alias("share_sig"), F.count(F.lit(1)).alias("n_names"))
    bb = F.abs("book_beta")
    flag = F.when((bb >= 0.10) & (F.col("share_sig") >= 0.4), "HIDDEN BETA").when(bb >= 0.05, "watch").otherwise("ok")
    return a.withColumns({"wavg_beta": F.try_divide("book_beta", "weight_tested"), "flag": flag})


def loading_coverage(exposures: DataFrame, held: DataFrame, date) -> DataFrame:
    """Held weight with and without each loading on a date; industries count as one row."""
    e = exposures.filter(F.col("Date") == F.lit(date)).select(
        "Position", F.when(F.col("Factor").startswith("Ind:"), "Industry").otherwise(F.col("Factor")).alias("Factor")).distinct()
    tot = held.groupBy("Book").agg(F.sum("Weight").alias("w"), F.count(F.lit(1)).alias("k"))
    c = held.join(e, "Position").groupBy("Book", "Factor").agg(F.sum("Weight").alias("weight_covered"), F.count(F.lit(1)).alias("c"))
    return c.join(tot, "Book").select("Book", "Factor", "weight_covered", (F.col("w") - F.col("weight_covered")).alias("weight_missing"),
                                      (F.col("k") - F.col("c")).alias("n_missing"))


def factor_summary(panel: DataFrame) -> DataFrame:
    """Full and trailing-year vols, worst day and cumulative growth per factor."""
    last = panel.agg(F.add_months(F.max("Date"), -12)).scalar()
    p = panel.withColumn("_l", last)
    return p.groupBy("Factor").agg(
        F.stddev_samp("Return").alias("vol"), F.stddev_samp(F.when(F.col("Date") > F.col("_l"), F.col("Return"))).alias("vol_1y"),
        F.min("Return").alias("min_return"), F.min_by("Date", F.struct("Return", "Date")).alias("min_date"),
        (F.exp(F.sum(F.log1p("Return"))) - 1).alias("cum_growth"))


def factor_profile(exposures: DataFrame, date, factor: str, bins: int = 40) -> tuple[DataFrame, DataFrame]:
    """(quantiles and extremes, 40-bin histogram over at least [-3.5, 3.5]) of one loading cross-section."""
    e = exposures.filter((F.col("Date") == F.lit(date)) & (F.col("Factor") == factor)).select("Factor", "Position", "Loading")
    q = exact_quantiles(e, ["Factor"], "Loading", {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99})
    x = e.groupBy("Factor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("Loading") > 3).alias("n_beyond_3"),
                                F.least(F.min("Loading"), F.lit(-3.5)).alias("lo"), F.greatest(F.max("Loading"), F.lit(3.5)).alias("hi"))
    j = e.join(F.broadcast(x), "Factor")
    b = F.least(F.floor((F.col("Loading") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    h = j.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return q.join(x, "Factor"), h


def factor_profiles(exposures: DataFrame) -> DataFrame:
    """(Date, Factor) -> n, five quantiles, extent, names beyond 3 and their share, for every cross-section at once."""
    e = exposures.filter(F.col("Loading").isNotNull()).select("Date", "Factor", "Loading")
    q = exact_quantiles(e, ["Date", "Factor"], "Loading", {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99})
    x = e.groupBy("Date", "Factor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("Loading") > 3).alias("n_beyond_3"),
                                        F.least(F.min("Loading"), F.lit(-3.5)).alias("lo"), F.greatest(F.max("Loading"), F.lit(3.5)).alias("hi"))
    return q.join(x, ["Date", "Factor"]).withColumn("share_beyond_3", F.col("n_beyond_3") / F.col("n"))


def factor_extremes(exposures: DataFrame, securities: DataFrame, k: int = 8, bound: float = 3.0) -> DataFrame:
    """The ``k`` names furthest beyond ``bound`` on either side of every cross-section: Date, Factor, side, rank, Position,
    Ticker, Loading. Only names beyond the bound are ranked, and ranks are cut before they travel."""
    from pyspark.sql import Window

    e = exposures.filter(F.abs("Loading") > bound).withColumn("side", F.when(F.col("Loading") > 0, "high").otherwise("low"))
    w = Window.partitionBy("Date", "Factor", "side").orderBy(F.abs("Loading").desc(), "Position")
    e = e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return e.join(securities.select("Position", "Ticker"), "Position", "left").select(
        "Date", "Factor", "side", "rank", "Position", F.coalesce("Ticker", "Position").alias("Ticker"), "Loading")


def held_overlay(exposures: DataFrame, profiles: DataFrame, held: DataFrame, securities: DataFrame, bins: int = 40) -> DataFrame:
    """Held names on the profile: Date, Factor, Book, Position, Ticker, Weight, Loading and their bin among ``bins`` equal ones
    over the profile's extent."""
    j = held.select("Date", "Book", "Position", "Weight").join(exposures.select("Date", "Position", "Factor", "Loading"), ["Date", "Position"])
    j = j.join(broadcast_if_small(profiles.select("Date", "Factor", "lo", "hi")), ["Date", "Factor"])
    b = F.least(F.floor((F.col("Loading") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return j.join(securities.select("Position", "Ticker"), "Position", "left").select(
        "Date", "Factor", "Book", "Position", F.coalesce("Ticker", "Position").alias("Ticker"), "Weight", "Loading", b.cast("long").alias("bin"))


# ---- details of the checks -------------------------------------------------------------------------
def offending(f: Mapping[str, DataFrame]) -> DataFrame:
    """(name, key): every row that a countable check objects to, named by its key."""
    def key(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
        return df.select(F.lit(name).alias("name"), F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]).alias("key"))

    out = []
    for n in CHECKED:
        keys = schema.KEYS[n]
        out.append(key(f[n].groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), f"{n}: key unique", keys))
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        out.append(key(f[n].filter(null), f"{n}: no null keys", keys))
    for n, c, u in [("exposures", "Position", "securities"), ("positions", "Position", "securities"), ("specific_var", "Position", "securities"),
                    ("exposures", "Factor", "factor_meta"), ("factor_returns", "Factor", "factor_meta")]:
        out.append(key(f[n].select(c).distinct().join(f[u].select(c), c, "left_anti"), f"{n}.{c} in {u}", [c]))
    out.append(key(f["positions"].filter("Weight < 0"), "positions: no negative weights", schema.KEYS["positions"]))
    out.append(key(f["specific_var"].filter("SpecificVar < 0"), "specific_var: non-negative", schema.KEYS["specific_var"]))
    out.append(key(f["exposures"].filter(F.abs("Loading") > COVERAGE_CAP * 1.5), "exposures: loadings within the coverage cap", schema.KEYS["exposures"]))
    out.append(key(f["factor_returns"].filter(F.abs("Return") > 0.5), "factor_returns: |return| <= 50%", schema.KEYS["factor_returns"]))
    held = f["positions"].select("Date", "Position").distinct()
    for n in ("exposures", "specific_var"):
        out.append(key(held.join(f[n].select("Date", "Position"), ["Date", "Position"], "left_anti"), f"held positions have {n} on the same date", ["Date", "Position"]))
    r = out[0]
    for o in out[1:]:
        r = r.unionByName(o)
    return r


def check_details(f: Mapping[str, DataFrame], k: int = 5) -> DataFrame:
    """(name, n, rank, key): how many rows each check objects to and the first ``k`` of them by key. Ranks are cut in each
    task before rows travel; checks without an objection have no row."""
    from pyspark.sql import Window

    rows = offending(f)
    n = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("key"))).filter(F.col("rank") <= k)
    return first.join(broadcast_if_small(n), "name").select("name", "n", "rank", "key")


def detail_text(details: DataFrame) -> DataFrame:
    """(name, detail): one sentence per check with objections."""
    d = details.groupBy("name").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("l"))  # the first k
    text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, F.lit(" row: ")).otherwise(F.lit(" rows: ")), F.concat_ws("; ", "l.key"),
                    F.when(F.col("n") > F.size("l"), F.lit("; ...")).otherwise(F.lit("")))
    return d.select("name", text.alias("detail"))
