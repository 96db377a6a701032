"""Exact order statistics of unbounded groups without gathering a group in one task.

Quantiles over *days* use Spark's ``percentile`` or a sorted array: a calendar is bounded. Over
*names* a group can hold any share of the data, so the helpers here

1. collapse to distinct (group, value) counts (map-side combine absorbs repeated values),
2. cut each group into value buckets at approximate quantiles (a fixed-size sketch),
3. prefix-sum the small bucket counts, and
4. sort only inside single buckets.

The result is exact; the sketch only balances the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 256


def _below(cuts: str, value: str, buckets: int) -> Column:
    """How many of the ascending ``cuts`` (fewer than ``buckets``) lie below ``value``, found by halving."""
    steps = [1 << k for k in reversed(range((buckets - 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(n) for n in steps]), F.lit(0), lambda at, n: F.when(F.get(cuts, at + n - 1) < F.col(value), at + n).otherwise(at))


def _bucketed(df: DataFrame, by: list[str], value: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(by, _v, _c, _b): distinct values with counts and bucket; (by, _b, _bc, _before, _n): rows in a bucket, in lower
    ones and in the group."""
    d = (df.filter(F.col(value).isNotNull())
         .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    d = d.filter(F.col("_c") > 0)  # always; the cuts thus read the counts, too, and all share one shuffle
    probs = [i / buckets for i in range(1, buckets)]
    cuts = d.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", probs, 1000)).alias("_cuts"))
    # one row per group, of which there are few (dates, factors): the values are not shuffled on them
    b = d.join(F.broadcast(cuts), by).withColumn("_b", _below("_cuts", "_v", buckets)).drop("_cuts")
    per = b.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
    w = Window.partitionBy(*by).orderBy("_b")
    per = per.withColumn(
        "_before", F.coalesce(F.sum("_bc").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return b, per.withColumn("_n", F.sum("_bc").over(Window.partitionBy(*by)))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    buckets: int = BUCKETS) -> DataFrame:
    """Interpolated quantiles per group: one row per ``by`` with a column per entry of ``probs``."""
    b, per = _bucketed(df, by, value, buckets)
    # a bucket matters only when it holds a 0-based rank some quantile reads
    need = None
    for p in probs.values():
        pos = F.lit(p) * (F.col("_n") - 1)
        for rank in (F.floor(pos), F.ceil(pos)):
            hit = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bc"))
            need = hit if need is None else (need | hit)
    w = Window.partitionBy(*by, "_b").orderBy("_v")
    d = (b.join(F.broadcast(per.filter(need)), [*by, "_b"])  # two buckets per group and quantile at most
         .withColumn("_hi", F.col("_before") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_lo", F.col("_hi") - F.col("_c")))

    def pick(rank):
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        aggs += [pick(F.floor(pos)).alias(f"_f_{name}"), pick(F.ceil(pos)).alias(f"_g_{name}")]
    agg = d.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_f_{name}"), F.col(f"_g_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*by, *cols)


def average_rank_pct(df: DataFrame, by: list[str], value: str, out: str = "pct",
                     buckets: int = BUCKETS) -> DataFrame:
    """pandas-style ``rank(pct=True)``: average rank of ties over the non-null count, exactly."""
    b, per = _bucketed(df, by, value, buckets)
    d = b.join(per, [*by, "_b"])
    w = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("_before") + F.sum("_c").over(w)
    ranks = d.select(*by, F.col("_v"), ((hi - (F.col("_c") - 1) / 2.0) / F.col("_n")).alias(out))
    return (df.withColumn("_v", F.col(value).cast("double"))
            .join(ranks, [*by, "_v"], "left").drop("_v"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per group. Spark limits each task to k rows before the shuffle
    (window group limit), so a hot group never lands whole in one task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
