"""Per-book artifacts that are replaced book by book, with a manifest that readers check.

An artifact is a table partitioned by Book and build. A build writes its partitions first and then, as its last step, one manifest
row per book; readers follow the manifest, so a build that was lost half-way is never read, and rebuilding one book leaves the
others as they are. ``prune`` removes what no manifest row names any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskloom.frames import _exists

#: the artifacts of a model and their keys
ARTIFACTS: dict[str, list[str]] = {
    "pnl_attribution": ["Book", "Date", "Kind", "Source"], "universe_membership": ["Book", "report_date", "cusip"], "universe_funnel": ["Date", "Position"],
    "universe_span": ["Book", "Date", "Position"], "universe_drift": ["Book", "Date", "Factor"], "regression_stats": ["Date", "Factor"]}
MANIFEST = "artifact string, Book string, build string, n long, mark long, built timestamp"
#: artifacts that are not kept by book are kept under this one
SHARED = "*"


class ArtifactError(ValueError):
    """An artifact that is not there, or not whole."""


def _mark(df: DataFrame, by: str) -> DataFrame:
    cols = sorted(c for c in df.columns if c not in (by, "build"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("mark"))


def write_artifact(df: DataFrame, folder: str, name: str) -> str:
    """Write the books in ``df`` as a new build of artifact ``name`` and return its id. Other books keep their builds."""
    if name not in ARTIFACTS:
        raise ArtifactError(f"unknown artifact {name!r}; known: {sorted(ARTIFACTS)}")
    missing = [k for k in ARTIFACTS[name] if k not in df.columns]
    if missing:
        raise ArtifactError(f"{name}: key column(s) {missing} missing")
    spark, build = df.sparkSession, uuid.uuid4().hex
    if "Book" not in df.columns:
        df = df.withColumn("Book", F.lit(SHARED))
    path = f"{folder}/{name}"
    df.withColumn("build", F.lit(build)).write.mode("append").partitionBy("Book", "build").parquet(path)
    written = spark.read.schema(df.withColumn("build", F.lit(build)).schema).parquet(path).filter(F.col("build") == build)
    rows = _mark(written, "Book").select(F.lit(name).alias("artifact"), "Book", F.lit(build).alias("build"), "n", "mark", F.current_timestamp().alias("built"))
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/_manifest")  # one row per book; the build counts from here on
    return build


def manifest(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The current build of every artifact and book."""
    if not _exists(spark, f"{folder}/_manifest"):
        return spark.createDataFrame([], MANIFEST)
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    if name is not None:
        m = m.filter(F.col("artifact") == name)
    w = Window.partitionBy("artifact", "Book").orderBy(F.col("built").desc(), "build")
    return m.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def read_artifact(spark: SparkSession, folder: str, name: str, books: list[str] | None = None, verify: bool = True) -> DataFrame:
    """Artifact ``name`` as its manifest has it, for ``books`` (default: all). A book without a build, and with ``verify``
    a build whose rows are not those that were counted, is an error that names it."""
    m = manifest(spark, folder, name)
    if books is not None:
        m = m.filter(F.col("Book").isin(*books))
    rows = m.collect()  # one row per book
    absent = sorted(set(books or []) - {r["Book"] for r in rows})
    if absent or not rows:
        raise ArtifactError(f"{name}: no build" + (f" for {absent}" if absent else ""))
    d = spark.read.parquet(f"{folder}/{name}").withColumns({"Book": F.col("Book").cast("string"), "build": F.col("build").cast("string")})
    current = F.lit(False)  # partition filters, so that older builds are not even opened
    for b in sorted({r["build"] for r in rows}):
        current = current | ((F.col("build") == b) & F.col("Book").isin(*sorted(r["Book"] for r in rows if r["build"] == b)))
    d = d.filter(current)
    if verify:
        seen = {r["Book"]: (r["n"], r["mark"]) for r in _mark(d, "Book").collect()}
        bad = sorted(r["Book"] for r in rows if seen.get(r["Book"]) != (r["n"], r["mark"]))
        if bad:
            raise ArtifactError(f"{name}: build of {bad} is not whole")
    d = d.drop("build")
    return d.drop("Book") if {r["Book"] for r in rows} == {SHARED} else d


def prune(spark: SparkSession, folder: str, name: str) -> int:
    """Remove the partitions of ``name`` that the manifest no longer names; how many were removed."""
    keep = {(r["Book"], r["build"]) for r in manifest(spark, folder, name).collect()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs, n = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    old = spark.read.parquet(f"{folder}/{name}").select(F.col("Book").cast("string"), F.col("build").cast("string")).distinct().collect()
    for r in old:
        if (r["Book"], r["build"]) not in keep:
            part = jvm.org.apache.hadoop.fs.Path(root, jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("Book", r["Book"]))
            n += int(fs.delete(jvm.org.apache.hadoop.fs.Path(part, f"build={r['build']}"), True))
    return n
