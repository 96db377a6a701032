import pytest
from pyspark.sql import functions as F

mixing = pytest.importorskip("riskloom.llm.mixing")


def test_targets_share_what_capped_sources_leave(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t["c"] == 30 and t["a"] == 300 and sum(t.values()) == pytest.approx(1610)  # weights 1, 2, 3, 1
    assert t["b"] == pytest.approx(2 * t[None])


def test_sources_meet_their_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)] + [(9000, "v " * 20_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.schedule(df)[1].toPandas()
    assert got.taken.sum() == got["size"].sum() and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 257).all()
    again = mixing.schedule(df.repartition(7))[1].toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \n", "b"), (4, "x y z", None), (4, "x y z", None), (None, "q r", "b"), (5, "word " * 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("s")).withColumn("target", F.lit(0))
    got = mixing.schedule(df)[1].collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.schedule(df.limit(0))[1].count() == 0
    assert mixing.schedule(df.filter("doc_id < 4"))[1].agg(F.sum("taken")).first()[0] == 0
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() > 0
