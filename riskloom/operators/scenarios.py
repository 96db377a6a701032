"""Scenario sets as one long table ``(ScenarioSet, day_idx, scen_date, Factor, shock)``.

Historical simulation, event replay, hypothetical shocks and point-in-time history differ only in
where the shock comes from. The table is bounded by factors x calendar days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# fixed values: the default replay windows and sigma shocks of the model
EVENT_WINDOWS = {
    "Evt:COVID2020": ("2020-02-01", "2020-05-31"),
    "Evt:Rates2022": ("2022-01-01", "2022-10-31"),
    "Evt:Selloff2018": ("2018-10-01", "2018-12-31"),
}
HYPO_SHOCKS = {
    "Hypo:ValueRotation": {"Value": 2.0, "Momentum": -2.0},
    "Hypo:RiskOff": {"Beta": -2.0, "ResidVol": 2.0, "Momentum": 1.0},
    "Hypo:MomentumCrash": {"Momentum": -3.0},
}
MIN_PIT_OBS = 60


def complete_panel(factor_returns: DataFrame, exposures: DataFrame | None = None) -> DataFrame:
    """Factor returns on days where every scenario factor has one (complete cases).

    With ``exposures``, scenario factors are those some name loads on, and Market."""
    fr = factor_returns.filter(F.col("Return").isNotNull() & ~F.isnan("Return"))
    if exposures is not None:
        loaded = exposures.select("Factor").distinct()
        fr = fr.filter(F.col("Factor") == "Market").unionByName(
            fr.filter(F.col("Factor") != "Market").join(loaded, "Factor", "left_semi"))
    k = fr.select(F.count_distinct("Factor").alias("k")).scalar()
    full = (fr.groupBy("Date").agg(F.count_distinct("Factor").alias("n"))
            .filter(F.col("n") == k).select("Date"))
    return fr.join(full, "Date", "left_semi").select("Date", "Factor", "Return")


def _indexed(df: DataFrame) -> DataFrame:
    """Number the days of each set and factor from 0 in date order (bounded by the calendar)."""
    w = Window.partitionBy("ScenarioSet", "Factor").orderBy("scen_date")
    return df.select("ScenarioSet", (F.row_number().over(w) - 1).alias("day_idx"), "scen_date",
                     "Factor", "shock")


def scenario_sets(factor_returns: DataFrame, events: dict | None = None, hypos: dict | None = None,
                  exposures: DataFrame | None = None) -> DataFrame:
    """HistFull, the event windows and the hypothetical sigma shocks."""
    events = EVENT_WINDOWS if events is None else events
    hypos = HYPO_SHOCKS if hypos is None else hypos
    panel = complete_panel(factor_returns, exposures)
    names = F.array(F.struct(F.lit("HistFull").alias("s"), F.lit(None).cast("date").alias("a"),
                             F.lit(None).cast("date").alias("b")),
                    *[F.struct(F.lit(n).alias("s"), F.lit(a).cast("date").alias("a"),
                               F.lit(b).cast("date").alias("b")) for n, (a, b) in events.items()])
    hist = (panel.select("*", F.explode(names).alias("w"))
            .filter(F.col("w.a").isNull() | F.col("Date").between(F.col("w.a"), F.col("w.b")))
            .select(F.col("w.s").alias("ScenarioSet"), F.col("Date").alias("scen_date"), "Factor",
                    F.col("Return").alias("shock")))
    out = _indexed(hist)
    if hypos:
        out = out.unionByName(hypothetical_sets(panel, hypos))
    return out


def hypothetical_sets(panel: DataFrame, hypos: dict[str, dict[str, float]]) -> DataFrame:
    """Length-one sets: sigma x vol per factor, 0 where unlisted, stamped with the last day."""
    st = panel.groupBy("Factor").agg(F.stddev_samp("Return").alias("vol"), F.max("Date").alias("scen_date"))
    parts = []
    for name, sig in hypos.items():
        parts.append(F.struct(F.lit(name).alias("s"), F.create_map(
            *[x for f, v in sig.items() for x in (F.lit(f), F.lit(float(v)))]).alias("m")))
    d = st.select("*", F.explode(F.array(*parts)).alias("h"))
    sigma = F.coalesce(F.try_element_at("h.m", F.col("Factor")), F.lit(0.0))
    return d.select(F.col("h.s").alias("ScenarioSet"), F.lit(0).alias("day_idx"), "scen_date", "Factor",
                    (sigma * F.col("vol")).alias("shock"))


def pit_month_ends(panel: DataFrame, min_obs: int = MIN_PIT_OBS) -> DataFrame:
    """Month-ends of the panel's span with at least ``min_obs`` days on or before them."""
    days = panel.select("Date").distinct()
    # a month-end is covered only once the panel reaches it
    span = days.agg(F.min("Date").alias("a"), F.max("Date").alias("b")).select(
        F.explode(F.sequence(F.last_day("a"), F.last_day("b"), F.expr("interval 1 month"))).alias("m"), "b")
    ends = span.select(F.last_day("m").alias("pit_date"), "b").filter(F.col("pit_date") <= F.col("b"))
    per = days.groupBy(F.last_day("Date").alias("pit_date")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("pit_date").rowsBetween(Window.unboundedPreceding, 0)
    cum = (ends.join(per, "pit_date", "left")
           .withColumn("obs", F.sum(F.coalesce("n", F.lit(0))).over(w)))
    return cum.filter(F.col("obs") >= min_obs).select("pit_date", "obs")


def pit_sets(factor_returns: DataFrame, dates: list[str] | None = None,
             exposures: DataFrame | None = None, min_obs: int = MIN_PIT_OBS) -> DataFrame:
    """``PIT:yyyy-mm-dd`` sets: all complete days on or before the month-end."""
    panel = complete_panel(factor_returns, exposures)
    ends = pit_month_ends(panel, min_obs)
    if dates is not None:
        ends = ends.filter(F.col("pit_date").isin(*[F.lit(d).cast("date") for d in dates]))
    last = panel.agg(F.last_day(F.max("Date"))).scalar()
    months = F.sequence(F.last_day("Date"), last, F.expr("interval 1 month"))
    j = (panel.select("*", F.explode(months).alias("m"))
         .select("Date", "Factor", "Return", F.last_day("m").alias("pit_date"))
         .join(ends.select("pit_date"), "pit_date", "left_semi"))
    return _indexed(j.select(F.concat(F.lit("PIT:"), F.date_format("pit_date", "yyyy-MM-dd")).alias("ScenarioSet"),
                             F.col("Date").alias("scen_date"), "Factor", F.col("Return").alias("shock")))


def scenario_axis(scenarios: DataFrame) -> DataFrame:
    """Per set, the ordered day axis as epoch days (element i dates element i of a P&L vector)."""
    d = scenarios.select("ScenarioSet", "day_idx", F.unix_date("scen_date").alias("e")).distinct()
    return d.groupBy("ScenarioSet").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("day_idx", "e"))), lambda s: s["e"]).alias("DateVec"))


def shock_vectors(scenarios: DataFrame) -> DataFrame:
    """(ScenarioSet, Factor) -> ShockVec array, for array consumers at the edge."""
    return scenarios.groupBy("ScenarioSet", "Factor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("day_idx", "shock"))), lambda s: s["shock"]).alias("ShockVec"))


def factor_vols(scenarios: DataFrame) -> DataFrame:
    return scenarios.groupBy("ScenarioSet", "Factor").agg(F.stddev_samp("shock").alias("vol"))
