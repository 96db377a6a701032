"""Fixed risk queries and saved views: presets of :func:`riskloom.plans.pivot.pivot`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.quantiles import top_k
from riskloom.plans.pivot import PivotError, pivot


def book_tile(frames, date, scenario_set: str) -> DataFrame:
    return pivot(frames, ["Book"], ["Total VaR 99", "Scenario VaR 99", "Scenario worst loss", "Specific vol"],
                 filters={"Date": [date], "ScenarioSet": [scenario_set]})


def scenario_board(frames, date, book: str) -> DataFrame:
    return pivot(frames, ["ScenarioSet"], ["Scenario VaR 99", "Scenario worst loss", "Total VaR 99"], filters={"Date": [date], "Book": [book]})


def exposures(frames, date, book: str) -> DataFrame:
    return pivot(frames, ["FactorGroup", "Factor"], ["Net exposure"], filters={"Date": [date], "Book": [book]})


def breakdown(frames, date, scenario_set: str, book: str, by: str) -> DataFrame:
    """Exposure, VaR and worst loss by country, sector, issuer or position (with its ticker)."""
    dim = by.capitalize()
    if dim not in ("Country", "Sector", "Issuer", "Position"):
        raise PivotError(f"cannot break down by {by!r}")
    out = pivot(frames, [dim], ["Net exposure", "Scenario VaR 99", "Scenario worst loss"],
                filters={"Date": [date], "Book": [book], "ScenarioSet": [scenario_set]})
    if dim == "Position":
        out = out.join(frames["securities"].select("Position", "Ticker"), "Position", "left")
    return out


def trends(frames, scenario_set: str, measures: list[str], by: str | None = None, book: str | None = None) -> DataFrame:
    """Measures over the whole calendar in one grouped query, optionally broken down."""
    f = {"ScenarioSet": [scenario_set], **({"Book": [book]} if book else {})}
    return pivot(frames, ["Date", *([] if book else ["Book"]), *([by] if by else [])], measures, filters=f)


def position_detail(frames, date, position: str) -> DataFrame:
    """Attributes, weight per book and specific variance as of the date, and the date's loadings."""
    one = F.col("Position") == position
    upto = F.col("Date") <= F.lit(date)
    s = frames["securities"].filter(one).select("Position", "Ticker", "Issuer", "Sector", "Country")
    w = frames["positions"].filter(one & upto).groupBy("Position", "Book").agg(F.max_by("Weight", F.col("Date")).alias("Weight"))
    v = frames["specific_var"].filter(one & upto).groupBy("Position").agg(F.max_by("SpecificVar", F.col("Date")).alias("SpecificVar"))
    e = frames["exposures"].filter(one & (F.col("Date") == F.lit(date))).select("Position", "Factor", "Loading")
    return s.join(w, "Position", "left").join(v, "Position", "left").join(e, "Position", "left")


def drill(frames, path_dims: list[str], path: list[str], measures: list[str], filters: Mapping[str, list]) -> DataFrame:
    """The next level of a hierarchy below ``path``."""
    f = {**filters, **{d: [m] for d, m in zip(path_dims, path)}}
    return pivot(frames, [path_dims[len(path)]], measures, filters=f)


def page(df: DataFrame, order: list[tuple[str, bool]], size: int = 250, after: tuple | None = None) -> DataFrame:
    """One page of ``df`` in the order of (column, descending) pairs that make a unique key: the first
    ``size`` rows beyond the key ``after``. The key of a page's last row opens the next page, so all
    pages together are all rows. Nulls come last, whichever way a column is ordered."""
    if after is not None:
        beyond = F.lit(False)
        for (c, down), v in reversed(list(zip(order, after))):
            if v is None:
                beyond = F.col(c).isNull() & beyond
            else:
                ahead = F.coalesce(F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v), F.lit(True))  # a null lies behind
                beyond = ahead | (F.coalesce(F.col(c) == F.lit(v), F.lit(False)) & beyond)
        df = df.filter(beyond)
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]).limit(size)


def contributions(frames, date, scenario_set: str, book: str, by: str = "Factor") -> DataFrame:
    return pivot(frames, [by], ["Marginal Scenario VaR 99", "% of Scenario VaR 99"],
                 filters={"Date": [date], "Book": [book], "ScenarioSet": [scenario_set]})


def tail_ladder(frames, date, book: str) -> DataFrame:
    return pivot(frames, ["ScenarioSet"], ["Scenario VaR 95", "Scenario VaR 97.5", "Scenario VaR 99", "Scenario ES 97.5",
                                           "Scenario ES 99", "Scenario PnL vol"], filters={"Date": [date], "Book": [book]})


def top_and_rest(df: DataFrame, by: list[str], name: str, value: str, k: int = 8) -> DataFrame:
    """Top-k by |value| per group plus one ``rest`` row. The top rows are found first and joined back,
    so the tail is summed where it lies."""
    d = df.select(*by, F.col(name).alias("_n"), F.col(value).alias("_v"))
    top = top_k(d, by, [F.abs("_v").desc(), "_n"], k).select(*by, "_n", F.lit(True).alias("_t"))
    j = d.join(top, [*by, "_n"], "left")
    return j.groupBy(*by, F.when(F.col("_t"), F.col("_n")).otherwise("rest").alias("name")).agg(
        F.sum("_v").alias("value"), F.count(F.lit(1)).alias("n"))


def path_report(frames, date, scenario_set: str, by: str | None = None) -> DataFrame:
    """Per book and scenario day: P&L, its rank worst to best and rank share, optionally broken out."""
    f = {"Date": [date], "ScenarioSet": [scenario_set]}
    m = ["Scenario PnL at day", "Scenario date at day (epoch)"]
    b = pivot(frames, ["Book", "ScenarioDay"], m, filters=f).select(
        "Book", F.col("ScenarioDay").alias("day_idx"), F.date_from_unix_date(F.col("Scenario date at day (epoch)").cast("int")).alias("scen_date"),
        F.col("Scenario PnL at day").alias("pnl"))
    w = Window.partitionBy("Book")
    rk = F.row_number().over(w.orderBy("pnl", "day_idx")) - 1
    b = b.withColumns({"rank": rk, "_n": F.count(F.lit(1)).over(w)})
    b = b.withColumn("pctile", F.try_divide(F.col("rank").cast("double"), F.col("_n") - 1)).drop("_n")
    if by is None:
        return b
    p = pivot(frames, ["Book", by, "ScenarioDay"], m[:1], filters=f)
    p = p.select("Book", by, F.col("ScenarioDay").alias("day_idx"), F.col(m[0]).alias(f"{by.lower()}_pnl"))
    return b.join(p, ["Book", "day_idx"])


def path_stats(frames, dates: list | None = None, scenario_sets: list[str] | None = None) -> DataFrame:
    """The stat row of every path report: Date, Book, ScenarioSet, var_line, worst_pnl, worst_date, mean_pnl."""
    flt = {"Date": dates or [], "ScenarioSet": scenario_sets or []}
    m = ["Scenario VaR 99", "Scenario worst loss", "Scenario worst date (epoch)", "Scenario mean PnL"]
    p = pivot(frames, ["Date", "Book", "ScenarioSet"], m, filters=flt)
    return p.select("Date", "Book", "ScenarioSet", (-F.col(m[0])).alias("var_line"), (-F.col(m[1])).alias("worst_pnl"),
                    F.date_from_unix_date(F.col(m[2]).cast("int")).alias("worst_date"), F.col(m[3]).alias("mean_pnl"))


def grid(df: DataFrame, rows: list[str], col: str, value: str, members: list[str]) -> DataFrame:
    """Tidy pivot records -> a matrix with one column per member (TOTAL for the margin); rows that are
    blank throughout are hidden."""
    keep = df.filter(F.col("Margin").isin("cell", "per_row", "grand")) if "Margin" in df.columns else df
    return keep.groupBy(*rows).pivot(col, members).agg(F.first(value)).dropna("all", subset=members)


def run_view(frames, view: Mapping, live: Mapping[str, list] | None = None) -> dict[str, DataFrame]:
    """Run a saved view: one query, or several under ``queries``. A live slicer replaces the saved
    filter of its dimension."""
    import datetime as dt

    out = {}
    specs = view.get("queries") or {"view": view.get("state", view)}
    for name, st in specs.items():
        f = {**st.get("filters", {}), **(live or {})}
        f = {d: [dt.date.fromisoformat(m) if d == "Date" and isinstance(m, str) else m for m in v] for d, v in f.items() if v}
        p = pivot(frames, st["rows"], st["measures"], cols=st.get("cols", []), filters=f, totals=bool(st.get("totals")))
        sort = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in st.get("sort", [])]
        out[name] = p.orderBy(*sort) if sort else p
    return out


def book_sections(backtest: DataFrame, headline: DataFrame, linkage: DataFrame, checks: DataFrame) -> DataFrame:
    """The summary's sections beyond limits and risk as (Book, section, name, value, status): the VaR backtest with its
    verdict, the attribution headline, the linkage rows outside their band, and the data checks by level (no book)."""
    none = F.lit(None).cast("string")

    def long(df: DataFrame, section: str, names: list[str], status: Column) -> DataFrame:
        d = df.select("Book", status.alias("status"), *[F.col(n).cast("double").alias(n) for n in names])
        return d.unpivot(["Book", "status"], names, "name", "value").select("Book", F.lit(section).alias("section"), "name", "value", "status")

    verdict = F.when(F.col("status") != "ok", "insufficient").when(F.col("kupiec_reject"), "reject").otherwise("ok")
    flagged = linkage.filter("verdict <> 'within'").select("Book", F.lit("reconcile").alias("section"), "name", F.col("z").alias("value"), F.col("verdict").alias("status"))
    levels = checks.groupBy(F.col("level").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    dq = levels.select(none.alias("Book"), F.lit("dq").alias("section"), "name", "value",
                       F.when(F.col("name") == "FAIL", "fail").when(F.col("name") == "WARN", "warn").otherwise("pass").alias("status"))
    return (long(backtest, "backtest", ["tested", "exceptions", "expected", "rate"], verdict)
            .unionByName(long(headline, "attribution", ["realized_geometric", "factor", "specific", "specific_share"], none)).unionByName(flagged).unionByName(dq))


def artifact_guard(artifact: DataFrame, books: DataFrame) -> DataFrame:
    """Status per requested book: does the artifact hold it?"""
    n = artifact.groupBy("Book").agg(F.count(F.lit(1)).alias("rows"))
    return books.join(n, "Book", "left").select("Book", F.when(F.col("rows").isNull(), "mismatch").otherwise("ok").alias("status"),
                                                F.coalesce("rows", F.lit(0)).alias("rows"))

