"""Join helpers: size-checked broadcast, as-of joins and owner months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: of the plan's estimate, which counts a written table's compressed bytes: rows unpack to several times as much
BROADCAST_LIMIT = 16 << 20


def planned_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (file size for a scan), or None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a remote session exposes no plan
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the plan's own size estimate is within ``limit``.

    Beyond it the join stays a shuffle join, whose hot partitions adaptive execution splits."""
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= limit else df


def broadcast_if_few(df: DataFrame, rows: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast of a derived table, whose plan estimate says nothing, when ``rows``, a counted bound on its
    rows of at most some 250 bytes each, keeps it within ``limit``."""
    return F.broadcast(df) if rows * 250 <= limit else df


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              strict: bool = False, how: str = "left") -> DataFrame:
    """Backward as-of join: each left row meets the latest right row with right_on <= left_on
    (< when ``strict``). The right side is one row per (by, right_on).

    Both sides are stacked and the latest right row is carried forward with an ignore-nulls window
    over ``by``: one shuffle on the key, no range join. ``by`` must bound the calendar of a key.
    """
    payload = [c for c in right.columns if c not in by]
    rnames = {c: f"_r_{c}" for c in payload}
    r = right.select(*by, F.col(right_on).alias("_t"), F.lit(0 if not strict else 1).alias("_side"),
                     F.struct(*[F.col(c).alias(rnames[c]) for c in payload]).alias("_rp"),
                     *[F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}")
                       for c in left.columns])
    le = left.select(*by, F.col(left_on).alias("_t"), F.lit(1 if not strict else 0).alias("_side"),
                     F.lit(None).cast(r.schema["_rp"].dataType).alias("_rp"),
                     *[F.col(c).alias(f"_l_{c}") for c in left.columns]).withColumn("_isl", F.lit(True))
    both = r.withColumn("_isl", F.lit(False)).unionByName(le)
    w = (Window.partitionBy(*by).orderBy("_t", "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (both.withColumn("_hit", F.last("_rp", ignorenulls=True).over(w)).filter("_isl"))
    if how == "inner":
        out = out.filter(F.col("_hit").isNotNull())
    return out.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns],
                      *[F.col(f"_hit.{rnames[c]}").alias(c) for c in payload
                        if c not in left.columns])


def owner_month(df: DataFrame, month_ends: DataFrame, on: str = "Date") -> DataFrame:
    """Stamp each row with the largest month-end strictly before its day (column ``d0``).

    The day -> owner map is an as-of carry over the calendar (days and month-ends, so one bounded
    window); the facts then meet it by equality, never by a range join."""
    ends = month_ends.select(F.col("Date").alias("_t"), F.lit(1).alias("_s"), F.col("Date").alias("_e")).distinct()
    days = df.select(F.col(on).alias("_t"), F.lit(0).alias("_s"),
                     F.lit(None).cast("date").alias("_e")).distinct()
    w = (Window.partitionBy(F.lit(0)).orderBy("_t", "_s")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = (days.unionByName(ends).withColumn("d0", F.last("_e", ignorenulls=True).over(w))
         .filter((F.col("_s") == 0) & F.col("d0").isNotNull())
         .select(F.col("_t").alias("_day"), "d0"))
    return df.join(F.broadcast(m), F.col(on) == F.col("_day"), "inner").drop("_day")  # one row per day
