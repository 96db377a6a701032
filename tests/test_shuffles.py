"""Rows of names are dealt to tasks as few times as the results need: plans with every unhinted join as a shuffle join."""

import contextlib
import datetime as dt
import io
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom.frames import CLEAN, save_frame
from riskloom.functions.quantiles import _below, exact_quantiles
from riskloom.operators import descriptors as de, timeseries as ts
from riskloom.plans.pivot import pivot
from toys import risk_frames

HF = {"ScenarioSet": ["HistFull"]}


@pytest.fixture
def no_guess(spark):
    """No broadcast by size and no adaptive plan, as on tables too large for either."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return re.sub(r"#\d+L?", "", out.getvalue())


def dealt(df) -> list[str]:
    """The keys of each shuffle of the plan, reused ones once."""
    return re.findall(r"[-:] Exchange hashpartitioning\(([^)]*), \d+\)", plan(df))


@pytest.mark.parametrize("measures", [["Marginal Scenario ES 97.5", "% of Scenario ES 97.5"], ["Marginal Model vol", "Factor variance contribution"]])
def test_contributions_of_names_meet_the_books_gradients_where_they_are(no_guess, measures):
    f, n = risk_frames(no_guess)
    d = pivot(f, ["Date", "Book", "Position"], measures, filters=HF)
    # names move to meet their loadings (and specific variances), never by book and factor to meet the gradients
    assert "Date, Book, Factor" not in dealt(d)
    # and no task keeps a sum per name and factor
    assert not [k for k in re.findall(r"keys=\[([^\]]*)\]", plan(d)) if "Position" in k and "Factor" in k]
    assert d.count() == 2 * len(n["P"])


def test_contributions_beside_exposures_are_those_alone(spark):
    f, n = risk_frames(spark)
    rows = ["Date", "Book", "Position"]
    alone = pivot(f, rows, ["Marginal Scenario VaR 99"], filters=HF).collect()
    both = pivot(f, rows, ["Marginal Scenario VaR 99", "Net exposure"], filters=HF)
    assert {(r["Book"], r["Position"]): r[3] for r in alone} == pytest.approx({(r["Book"], r["Position"]): r[3] for r in both.collect()})
    L = n["L"].sum(axis=1)
    assert {(r["Book"], r["Position"]): r["Net exposure"] for r in both.collect()} == pytest.approx(
        {(b, p): n["w"][b][i] * L[i] for b in "AB" for i, p in enumerate(n["P"])})


def _prices(spark):
    rows = [(f"P{k}", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + k + (i * 7 + k) % 5, None if (k, i % 9) == (2, 0) else 100.0 + i)
            for k in range(1, 5) for i in range(300)]
    px = spark.createDataFrame(rows, "Position string, Date date, Close double, Volume double")
    m = px.filter("Position = 'P4'").select("Date", (F.col("Close") / 100 - 0.1).alias("ret"))
    return px, m


def test_descriptors_deal_prices_by_name_once(no_guess):
    px, m = _prices(no_guess)
    keys = dealt(de.price_descriptors(px, m, {"RateBeta": m.withColumn("ret", F.col("ret") * F.dayofmonth("Date"))}, F.lit(dt.date(2020, 12, 31))))
    assert [k for k in keys if "Position" in k] == ["Position"]


def test_descriptors_equal_each_series_joined(spark):
    px, m = _prices(spark)
    prox = {"RateBeta": m.withColumn("ret", F.col("ret") * F.dayofmonth("Date"))}
    got = de.price_descriptors(px, m, prox, F.lit(dt.date(2020, 12, 31)))
    d = (ts.betas(ts.returns(px, ["Position"]).select("Position", "Date", "ret"), m, prox).join(ts.momentum(px), ["Position", "Date"])
         .join(ts.log_dollar_volume(px), ["Position", "Date"], "left").join(px.select("Position", "Date", "Close"), ["Position", "Date"]))
    want = ts.month_snapshots(d, ["Position"], "Date", F.lit(dt.date(2020, 12, 31))).drop("as_of")
    key = lambda df: sorted(df.select(*sorted(df.columns)).collect(), key=lambda r: (r["Position"], r["Date"]))
    a, b = key(got), key(want)
    assert len(a) == 48 and [tuple(r) for r in a] == [tuple(r) for r in b]
    assert any(r["LogADV"] is None for r in a) and any(r["Momentum"] is not None for r in a)


def test_quantiles_leave_values_in_their_buckets(no_guess):
    df = no_guess.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("v"))
    q = exact_quantiles(df, ["g"], "v", {"med": 0.5})
    assert "SortMergeJoin" not in plan(q)
    assert {r["g"]: r["med"] for r in q.collect()} == {0: 749.25, 1: 748.5, 2: 750.0}


def test_scores_leave_names_where_they_are(no_guess):
    df = no_guess.range(200).select(F.lit(dt.date(2024, 1, 31)).alias("Date"), F.concat(F.lit("P"), "id").alias("Position"),
                                    (F.col("id") % 3 == 0).alias("is_estimation"), F.pow("id", F.lit(2)).alias("Beta"))
    z = de.split_z(de.with_reference(df, ["Date"]).withColumnRenamed("Beta", "v"), ["Date"], "v", "ref")
    assert "SortMergeJoin" not in plan(z)


def test_scores_read_centres_and_scales_that_were_computed_once(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    df = spark.createDataFrame([(d, f"P{i}", i % 3 > 0, float(i * i % 17)) for d in days for i in range(40)], "Date date, Position string, ref boolean, v double")
    assert "percentile_approx" not in plan(de.split_z(df, ["Date"], "v", "ref"))


def test_buckets_are_found_by_halving(spark):
    for n, buckets in ((0, 8), (1, 8), (5, 8), (7, 8), (255, 256)):
        cuts = [float(2 * k) for k in range(n)]
        values = [-1.0, 0.0, 1.0, 2.0, 3.0, 13.0, 508.0, 509.0, float("inf"), float("nan")]
        df = spark.createDataFrame([(cuts, v) for v in values], "c array<double>, v double")
        got = df.select("v", _below("c", "v", buckets).alias("b"), F.size(F.filter("c", lambda c: c < F.col("v"))).alias("w")).collect()
        assert all(r.b == r.w for r in got)
    assert "filter(_cuts" not in plan(exact_quantiles(spark.range(9).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"], "v", {"med": 0.5}))


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p.name for d in disk.localDirsString() for p in Path(d).rglob("shuffle_*.data")}


def test_written_frames_leave_no_shuffle_files(spark, tmp_path):
    setting, before = spark.conf.get(CLEAN), _shuffle_files(spark)
    save_frame(spark.range(10000).groupBy((F.col("id") % 999).alias("k")).count().repartition(7, "count"), str(tmp_path / "t"))
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before and spark.conf.get(CLEAN) == setting
    assert spark.read.parquet(str(tmp_path / "t")).count() == 999
