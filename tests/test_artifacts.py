"""Per-book artifacts: builds, manifest, half-written builds, pruning."""

import pytest
from pyspark.sql import functions as F

from riskloom import artifacts as ar, frames

KIND = "Book string, Date date, Factor string, x double"


def table(spark, books, k):
    return spark.createDataFrame([(b, None, f, float(k * i)) for b in books for i, f in enumerate(("Size", "Value"))], KIND)


def rows(df):
    return sorted((r.Book, r.Factor, r.x) for r in df.collect())


def test_one_book_is_rebuilt_and_the_others_stay(spark, tmp_path):
    d = str(tmp_path)
    first = ar.write_artifact(table(spark, ["A", "B/1 x"], 1), d, "universe_drift")
    second = ar.write_artifact(table(spark, ["A"], 5), d, "universe_drift")
    got = ar.read_artifact(spark, d, "universe_drift")
    assert rows(got) == [("A", "Size", 0.0), ("A", "Value", 5.0), ("B/1 x", "Size", 0.0), ("B/1 x", "Value", 1.0)]
    assert {(r.Book, r.build, r.n) for r in ar.manifest(spark, d).collect()} == {("A", second, 2), ("B/1 x", first, 2)}
    assert ar.prune(spark, d, "universe_drift") == 1 and rows(ar.read_artifact(spark, d, "universe_drift")) == rows(got)
    assert rows(ar.read_artifact(spark, d, "universe_drift", ["A"])) == rows(got)[:2]


def test_a_half_written_build_is_never_read(spark, tmp_path):
    d = str(tmp_path)
    ar.write_artifact(table(spark, ["A"], 1), d, "universe_drift")
    # the data of a build arrived, its manifest did not
    table(spark, ["A"], 9).withColumn("build", F.lit("lost")).write.mode("append").partitionBy("Book", "build").parquet(f"{d}/universe_drift")
    assert rows(ar.read_artifact(spark, d, "universe_drift")) == [("A", "Size", 0.0), ("A", "Value", 1.0)]
    # rows of the current build went missing or were added
    build = ar.manifest(spark, d).first().build
    table(spark, ["A"], 3).withColumn("build", F.lit(build)).write.mode("append").partitionBy("Book", "build").parquet(f"{d}/universe_drift")
    with pytest.raises(ar.ArtifactError, match="not whole"):
        ar.read_artifact(spark, d, "universe_drift")


def test_errors_and_shared_artifacts(spark, tmp_path):
    d = str(tmp_path)
    with pytest.raises(ar.ArtifactError, match="no build"):
        ar.read_artifact(spark, d, "universe_span")
    with pytest.raises(ar.ArtifactError, match="unknown"):
        ar.write_artifact(table(spark, ["A"], 1), d, "nothing")
    with pytest.raises(ar.ArtifactError, match="Position"):
        ar.write_artifact(table(spark, ["A"], 1), d, "universe_span")
    ar.write_artifact(table(spark, ["A"], 2).drop("Book"), d, "regression_stats")
    got = ar.read_artifact(spark, d, "regression_stats")
    assert got.columns == ["Date", "Factor", "x"] and got.count() == 2
    ar.write_artifact(table(spark, ["A"], 1), d, "universe_drift")
    with pytest.raises(ar.ArtifactError, match="C"):
        ar.read_artifact(spark, d, "universe_drift", ["A", "C"])


def test_a_local_session_without_a_folder_gets_one(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "local[2]", "app-without-a-folder"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    one = frames.shared_folder(Session())
    assert one == frames.shared_folder(Session()) and "riskloom-" in one
    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="checkpoint"):
        frames.shared_folder(Session())
