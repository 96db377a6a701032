"""A book's risk in two states: before and after trades, before and after a filing.

Holdings are read once: every name carries its loadings as one map, so that exposures, name
contributions and the split of a drift all come from the same written table. The risk block is one row per
(Branch, Date, Book), however many states are compared; states meet by equality of their keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.frames import Frames, cleaned, staged
from riskloom.functions.joins import broadcast_if_small
from riskloom.operators import measures as ms
from riskloom.operators.desk import previous_distinct_book
from riskloom.operators.exposure import KEYS

RISK = ("model_vol_1d", "scenario_var_99", "scenario_var_975", "es_975", "es_99", "specific_vol", "total_var_99", "top5_ctr_share", "gross", "net")
SOURCES = ("entered", "exited", "reweighted", "loading_drift")


def loaded(positions: DataFrame, exposures: DataFrame, specific_var: DataFrame) -> DataFrame:
    """``positions`` with SpecificVar and ``loads`` (map Factor -> Loading, null for a name without loadings on the
    date): three inputs dealt once by (Date, Position)."""
    loads = (exposures.groupBy("Date", "Position")
             .agg(F.map_from_entries(F.collect_list(F.struct("Factor", "Loading"))).alias("loads")))  # at most one entry per factor
    sv = specific_var.select("Date", "Position", "SpecificVar")
    return positions.join(loads, ["Date", "Position"], "left").join(sv, ["Date", "Position"], "left")


def _sum_product(a: str, b: str) -> Column:
    """Sum over the keys of map ``a`` of the products with map ``b``; keys that ``b`` lacks count zero."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.col(b)[e["key"]], F.lit(0.0)))


def book_risk(holdings: DataFrame, shocks: DataFrame, interpolated: bool = True, top: int = 5) -> DataFrame:
    """One row per (Branch, Date, Book): the metrics ``RISK`` under the one scenario set of ``shocks``.

    ``holdings`` comes from :func:`loaded`; names without loadings take no part. The top share is that of the
    ``top`` largest contributions to total VaR, linear in the tail day; their scale is the interpolated VaR or, if
    not ``interpolated``, the P&L of the tail day itself."""
    h = holdings.filter(F.col("loads").isNotNull())
    w, sv, z = F.col("Weight"), F.coalesce("SpecificVar", F.lit(0.0)), ms.Z99
    x = (h.select(*KEYS, "Weight", F.explode("loads").alias("Factor", "l")).groupBy(*KEYS, "Factor").agg(F.sum(F.col("l") * w).alias("x")))
    spec = h.groupBy(*KEYS).agg(F.sum(w * w * sv).alias("S"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"))
    vec = staged(ms.pnl_vectors(x, shocks, KEYS))
    pairs = F.array_sort(F.transform("pv", lambda e, i: F.struct(e.alias("p"), i.alias("day_idx"))))
    tail = vec.select(*KEYS, "ScenarioSet", ms.read_off(pairs, F.size("pv"), 0.01).alias("t"))
    days = shocks.groupBy("ScenarioSet", "day_idx").agg(F.map_from_entries(F.collect_list(F.struct("Factor", "shock"))).alias("day"))
    book = (ms.ladder(vec).join(spec, KEYS).join(tail, [*KEYS, "ScenarioSet"])
            .withColumns({"day_idx": F.col("t.day_idx"), "read99": -F.col("t.p")}).drop("t").join(broadcast_if_small(days), ["ScenarioSet", "day_idx"]))
    book = staged(book)
    scale = F.col("var99") if interpolated else F.col("read99")
    n = h.join(broadcast_if_small(book.select(*KEYS, "day", scale.alias("scale"))), KEYS)
    n = n.select(*KEYS, (-w * _sum_product("loads", "day") * F.col("scale") + z * z * w * w * sv).alias("m"))  # times the total VaR
    first = Window.partitionBy(*KEYS).orderBy(F.col("m").desc())
    best = n.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top).groupBy(*KEYS).agg(F.sum("m").alias("best"))
    share = best.join(n.groupBy(*KEYS).agg(F.sum("m").alias("all")), KEYS).select(
        *KEYS, F.when(F.col("all") != 0, F.try_divide("best", "all")).alias("top5_ctr_share"))
    b = book.join(share, KEYS, "left")
    s = F.col("S")
    return b.select(*KEYS, F.sqrt(F.col("vol") ** 2 + s).alias("model_vol_1d"), F.col("var99").alias("scenario_var_99"),
                    F.col("var975").alias("scenario_var_975"), F.col("es975").alias("es_975"), F.col("es99").alias("es_99"),
                    F.sqrt(s).alias("specific_vol"), F.sqrt(F.col("var99") ** 2 + z * z * s).alias("total_var_99"), "top5_ctr_share", "gross", "net")


def _long(risk: DataFrame, keys: list[str], value: str) -> DataFrame:
    return risk.unpivot(keys, list(RISK), "metric", value)


# ---- what if ------------------------------------------------------------------------------------
class TradeError(ValueError):
    """Trades that the model cannot price."""


def whatif(frames: Mapping[str, DataFrame], trades: DataFrame, scenario_set: str = "HistFull") -> Frames:
    """All branches of ``trades(Branch, Date, Book, Position, Weight)`` against their base, in one plan; each table is built
    on first use.

    ``risk``: Branch, Date, Book, metric, before, after, delta. ``holdings``: every name of a branch with its weight
    before and after and whether it was held, resized, added or dropped. ``unpriced``: held names
    without loadings on the date, which no metric sees; priced and unpriced weights add up to the book.
    Trades in names without loadings on their date, or without a book on it, are refused."""
    name = ["Date", "Book", "Position"]
    trades = staged(trades.select("Branch", *name, "Weight"))
    asked = trades.select("Date", "Position").distinct()
    pairs = trades.select("Date", "Book").distinct()
    with cleaned(trades.sparkSession):
        seen = frames["exposures"].select("Date", "Position").join(broadcast_if_small(asked), ["Date", "Position"], "left_semi").distinct()
        bad = asked.join(seen, ["Date", "Position"], "left_anti").limit(5).collect()
        if bad:
            raise TradeError(f"not in the universe on the date: {sorted((str(r[0]), r[1]) for r in bad)}")
        seen = frames["positions"].select("Date", "Book").join(broadcast_if_small(pairs), ["Date", "Book"], "left_semi").distinct()
        bad = pairs.join(seen, ["Date", "Book"], "left_anti").limit(5).collect()
        if bad:
            raise TradeError(f"no book on the date: {sorted((str(r[0]), r[1]) for r in bad)}")
    base = frames["positions"].select(*name, "Weight").join(broadcast_if_small(pairs), ["Date", "Book"], "left_semi")
    expo = frames["exposures"].join(broadcast_if_small(pairs.select("Date").distinct()), "Date", "left_semi")
    scope = trades.select("Branch", "Date", "Book").distinct()
    traded = base.join(broadcast_if_small(trades.select(*name).distinct()), name, "left_semi").select(*name)  # as often as the book holds them

    def branches() -> DataFrame:
        """Base and all branches with their loadings. Written are the base and the traded names alone: a branch's other names are
        the base's rows again, made where they are read."""
        new = trades.filter(F.col("Weight").isNotNull())
        rows = base.select(F.lit("Base").alias("Branch"), *name, "Weight", F.lit(False).alias("new")).unionByName(
            new.join(traded, name, "left").select("Branch", *name, "Weight", F.lit(True).alias("new")))
        h = staged(loaded(rows, expo, frames["specific_var"]))
        old = h.filter("NOT new").drop("new")
        kept = (old.drop("Branch").join(broadcast_if_small(scope), ["Date", "Book"])
                .join(broadcast_if_small(new.select("Branch", *name)), ["Branch", *name], "left_anti"))
        return old.unionByName(kept.unionByName(h.filter("new").drop("new")).filter(F.col("Weight") != 0))

    def risk() -> DataFrame:
        r = staged(book_risk(branches(), frames["scenarios"].filter(F.col("ScenarioSet") == scenario_set)))
        after = _long(r.filter("Branch <> 'Base'"), KEYS, "after")
        before = _long(r.filter("Branch = 'Base'").drop("Branch"), ["Date", "Book"], "before")
        return after.join(before, ["Date", "Book", "metric"]).select(
            "Branch", "Date", "Book", "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))

    ticker = broadcast_if_small(frames["securities"].select("Position", "Ticker"))
    known = expo.select("Date", "Position").distinct().withColumn("priced", F.lit(True))
    held = (base.withColumnRenamed("Weight", "old").join(known, ["Date", "Position"], "left")
            .select(*name, "old", F.coalesce("priced", F.lit(False)).alias("priced")))
    t = trades.select("Branch", *name, F.col("Weight").alias("new"))
    # trades come to the books' names; those in names that are not held are rows of their own
    void = t.join(broadcast_if_small(traded.distinct()), name, "left_anti").select("Branch", *name, F.lit(None).cast("double").alias("old"), F.lit(True).alias("priced"), "new")
    names = held.join(broadcast_if_small(scope), ["Date", "Book"]).join(broadcast_if_small(t), ["Branch", *name], "left").unionByName(void)
    old, new = F.coalesce("old", F.lit(0.0)), F.coalesce("new", "old")
    change = F.when(F.col("new").isNull(), "held").when(F.col("old").isNull(), "added").when(F.col("new") == 0, "dropped").otherwise("resized")
    names = names.join(ticker, "Position", "left").select("Branch", "Date", "Book", "Position", F.coalesce("Ticker", "Position").alias("Ticker"), old.alias("old"),
                                                          new.alias("new"), change.alias("change"), "priced")
    unpriced = (held.filter("NOT priced").join(ticker, "Position", "left")
                .select("Date", "Book", "Position", F.coalesce("Ticker", "Position").alias("Ticker"), F.col("old").alias("Weight")))
    return Frames(trades.sparkSession, {"risk": risk, "holdings": names, "unpriced": unpriced})


# ---- what changed -------------------------------------------------------------------------------
def state_pairs(positions: DataFrame) -> DataFrame:
    """(Book, Date, previous): every date of a book with its previous distinct book; a book's first state has none."""
    return previous_distinct_book(positions).filter(F.col("previous") < F.col("Date"))


def what_changed(frames: Mapping[str, DataFrame], pairs: DataFrame | None = None, scenario_set: str = "HistFull",
                 threshold: float = 0.005) -> DataFrame:
    """What is different in each book since ``previous``, for every row of ``pairs(Book, Date, previous)`` (default
    :func:`state_pairs`): Book, Date, previous, part, item, label, change, before, after, delta and the four sources.

    Part ``position``: names entered, exited, and resized by more than ``threshold``. Part ``factor``: net exposure
    and the sources of its change, which add up to delta. Part ``risk``: the metrics of :func:`book_risk`."""
    pairs = staged(state_pairs(frames["positions"]) if pairs is None else pairs)
    h = staged(loaded(frames["positions"].withColumn("Branch", F.lit("Base")), frames["exposures"], frames["specific_var"]))
    key = ["Book", "Date", "Position"]
    old = (h.withColumnRenamed("Date", "previous").join(broadcast_if_small(pairs), ["Book", "previous"])
           .select(*key, F.col("Weight").alias("w0"), F.col("loads").alias("l0")))
    new = h.join(broadcast_if_small(pairs.select("Book", "Date")), ["Book", "Date"], "left_semi").select(*key, F.col("Weight").alias("w1"), F.col("loads").alias("l1"))
    both = staged(old.join(new, key, "full_outer"))
    w0, w1, zero = F.col("w0"), F.col("w1"), F.lit(0.0)
    void = F.lit(None).cast("double")

    move = F.coalesce(w1, zero) - F.coalesce(w0, zero)
    kind = F.when(w0.isNull(), "entered").when(w1.isNull(), "exited").when(F.abs(move) > threshold, "resized")
    names = both.withColumn("change", kind).filter(F.col("change").isNotNull()).join(frames["securities"].select("Position", "Issuer"), "Position", "left")
    names = names.select("Book", "Date", F.lit("position").alias("part"), F.col("Position").alias("item"), F.col("Issuer").alias("label"), "change",
                         w0.alias("before"), w1.alias("after"), move.alias("delta"), *[void.alias(c) for c in SOURCES])

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    m0, m1 = F.coalesce("l0", none), F.coalesce("l1", none)
    f = both.select("Book", "Date", "w0", "w1", m0.alias("m0"), m1.alias("m1"), F.explode(F.array_union(F.map_keys(m0), F.map_keys(m1))).alias("Factor"))
    f = f.withColumns({"a": F.coalesce(F.col("m0")[F.col("Factor")], zero), "b": F.coalesce(F.col("m1")[F.col("Factor")], zero)})
    a, b, kept = F.col("a"), F.col("b"), w0.isNotNull() & w1.isNotNull()
    f = f.groupBy("Book", "Date", "Factor").agg(
        F.sum(F.coalesce(w0, zero) * a).alias("before"), F.sum(F.coalesce(w1, zero) * b).alias("after"),
        F.sum(F.when(w0.isNull(), w1 * b).otherwise(zero)).alias("entered"), F.sum(F.when(w1.isNull(), -w0 * a).otherwise(zero)).alias("exited"),
        F.sum(F.when(kept, (w1 - w0) * a).otherwise(zero)).alias("reweighted"), F.sum(F.when(kept, w1 * (b - a)).otherwise(zero)).alias("loading_drift"))
    factors = f.join(broadcast_if_small(frames["factor_meta"]), "Factor", "left").select(
        "Book", "Date", F.lit("factor").alias("part"), F.col("Factor").alias("item"), F.col("FactorGroup").alias("label"), F.lit(None).cast("string").alias("change"),
        "before", "after", (F.col("entered") + F.col("exited") + F.col("reweighted") + F.col("loading_drift")).alias("delta"), *SOURCES)

    shocks = frames["scenarios"].filter(F.col("ScenarioSet") == scenario_set)
    risk = staged(book_risk(h, shocks, interpolated=False).drop("Branch"))
    r1 = _long(risk.join(broadcast_if_small(pairs), ["Book", "Date"]), ["Book", "Date", "previous"], "after")
    r0 = _long(risk.withColumnRenamed("Date", "previous"), ["Book", "previous"], "before")
    risks = r1.join(r0, ["Book", "previous", "metric"]).select(
        "Book", "Date", F.lit("risk").alias("part"), F.col("metric").alias("item"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("change"),
        "before", "after", (F.col("after") - F.col("before")).alias("delta"), *[void.alias(c) for c in SOURCES])
    out = names.unionByName(factors).unionByName(risks)
    return pairs.join(out, ["Book", "Date"])
