"""A pivot result as a matrix: measures as an axis of their own, totals, percent scaling, blanks hidden, several sort keys.

The columns of a matrix must be known before it is made. One aggregate over the tidy cells finds them, with the count of
values in each; it is small and bounded (``max_columns``), and it alone reaches the driver. The matrix itself stays a
DataFrame: one more aggregate by row key, with the columns given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.operators.exposure import TOTAL
from riskloom.plans.pivot import PivotError

MEASURES = "Measures"
SEP = " / "


def is_percent(measure: str) -> bool:
    return measure.startswith("% ") or measure.endswith("share")


def cells(p: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """(dims, Measure, Value): one row per cell and measure of a pivot result; percent measures times 100; values that
    are no number are blank."""
    def value(m: str):
        v = F.col(f"`{m}`").cast("double")
        return F.when(F.isnan(v), None).otherwise(v * 100 if is_percent(m) else v)

    items = F.array(*[F.struct(F.lit(m).alias("Measure"), value(m).alias("Value")) for m in measures])
    return p.select(*[F.col(d).cast("string").alias(d) for d in dims], F.explode(items).alias("e")).select(*dims, "e.Measure", "e.Value")


def grid(p: DataFrame, rows: list[str], cols: list[str], measures: list[str], hide_empty: bool = True,
         sort: list[tuple[str, bool]] | None = None, max_columns: int = 500) -> DataFrame:
    """The matrix of a ``pivot`` result ``p`` (with ``totals`` or without) over the axes ``rows`` and ``cols``, in which the
    token ``Measures`` places the measures; by default several measures go behind the columns.

    Columns are named by their members joined by `` / ``, ``value`` if there are none; ``is_total`` marks rows that are totals in
    every dimension of the rows but Date and Book. ``hide_empty`` drops blank columns and rows, never totals. ``sort``
    lists (row dimension or column, descending); total rows come last in any case. More than ``max_columns`` columns
    are refused: filter the pivot first."""
    if (rows + cols).count(MEASURES) > 1:
        raise PivotError("Measures can be on one axis only")
    if MEASURES not in rows + cols and len(measures) > 1:
        cols = [*cols, MEASURES]
    dims = [d for d in rows + cols if d != MEASURES]
    rf, cf = (["Measure" if d == MEASURES else d for d in x] for x in (rows, cols))
    if not rf:
        raise PivotError("a grid needs rows")
    tidy = cells(p, dims, measures)
    key = F.concat_ws(SEP, *[F.coalesce(c, F.lit("")) for c in cf]) if cf else F.lit("value")
    real = [c for c in cf if c != "Measure"]
    whole = F.lit(bool(real))
    for c in real:
        whole = whole & (F.col(c) == TOTAL)
    tidy = tidy.withColumns({"_key": key, "_whole": F.coalesce(whole, F.lit(False))})
    # totals behind their members, members by name, measures in the order asked for
    order = F.struct(*[F.struct((F.col(c) == TOTAL).alias("t"), F.col(c).alias("n")) if c != "Measure" else
                       F.struct(F.lit(False).alias("t"), F.lpad(F.array_position(F.array(*[F.lit(m) for m in measures]), F.col(c)).cast("string"), 6, "0").alias("n"))
                       for c in cf]) if cf else F.lit(0)
    axis = (tidy.groupBy("_key").agg(F.count("Value").alias("n"), F.max("_whole").alias("whole"), F.min(order).alias("o")).orderBy("o", "_key")
            .limit(max_columns + 1).collect())
    if len(axis) > max_columns:
        raise PivotError(f"more than {max_columns} columns: put a dimension on the rows or filter it")
    members = [r["_key"] for r in axis if r["n"] or r["whole"] or not hide_empty]
    out = tidy.groupBy(*rf).pivot("_key", members).agg(F.first("Value", ignorenulls=True)) if members else tidy.select(*rf).distinct()
    inner = [c for c in rf if c not in ("Measure", "Date", "Book")]
    total = F.lit(bool(inner))
    for c in inner:
        total = total & (F.col(c) == TOTAL)
    out = out.withColumn("is_total", F.coalesce(total, F.lit(False)))
    if hide_empty and members:
        some = F.lit(False)
        for m in members:
            some = some | F.col(f"`{m}`").isNotNull()
        out = out.filter(F.col("is_total") | some)
    if sort:
        bad = [c for c, _ in sort if c not in out.columns]
        if bad:
            raise PivotError(f"unknown sort column(s): {bad}")
        out = out.orderBy("is_total", *[F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_last() for c, d in sort])
    return out
