"""Loading, saving and caching the model frames.

The builder half writes frames as parquet, the query half only reads them. Parquet carries the
file sizes Catalyst needs to pick join strategies and the row-group statistics that prune dates.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from riskloom import schema


class Frames(Mapping[str, DataFrame]):
    """Named DataFrames honouring :mod:`riskloom.schema`; also reachable as attributes. A value may
    be a function, called on first use."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame | Callable[[], DataFrame]]):
        self.spark = spark
        self._f = frames

    def __getitem__(self, name: str) -> DataFrame:
        v = self._f[name]
        if not isinstance(v, DataFrame):
            v = self._f[name] = v()
        return v

    def __iter__(self) -> Iterator[str]:
        return iter(self._f)

    def __len__(self) -> int:
        return len(self._f)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.__dict__["_f"]:
            raise AttributeError(name)
        return self[name]

    def replace(self, **frames: DataFrame) -> "Frames":
        return Frames(self.spark, {**self._f, **frames})


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_frames(spark: SparkSession, folder: str) -> Frames:
    """Read the frames under ``folder``; every missing required frame is named in the error."""
    missing = [n for n in schema.REQUIRED if not _exists(spark, f"{folder}/{n}.parquet")]
    if missing:
        raise FileNotFoundError(f"missing frames under {folder}: {missing}")
    out: dict[str, DataFrame] = {}
    for n in schema.REQUIRED + schema.OPTIONAL + schema.DERIVED:
        path = f"{folder}/{n}.parquet"
        if n in schema.REQUIRED or _exists(spark, path):
            out[n] = spark.read.schema(schema.SCHEMAS[n]).parquet(path)
    return Frames(spark, out)


#: Spark's setting (4.1 and later) by which an execution's shuffle files go when it ends, not when the driver's memory is next collected
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files behind; for writes, whose rows are read from the written table."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before) if before is not None else spark.conf.unset(CLEAN)


def save_frame(df: DataFrame, path: str, cluster_by: list[str] | None = None,
               partition_by: list[str] | None = None) -> None:
    """Write one frame. ``cluster_by`` brings rows of one key together with an adaptive rebalance,
    which splits a hot key over several files and merges small ones. The shuffle files behind it go once it is written."""
    if cluster_by:
        df = df.hint("rebalance", *cluster_by).sortWithinPartitions(*cluster_by)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with cleaned(df.sparkSession):
        w.parquet(path)


_CLUSTER = {"exposures": ["Date"], "positions": ["Date"], "specific_var": ["Date"],
            "specific_returns": ["Date"], "prices": ["Position"]}


def save_frames(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Write every frame under ``folder`` (overwriting), clustered by its usual filter column."""
    for n, df in frames.items():
        save_frame(schema.conform(df, n), f"{folder}/{n}.parquet", _CLUSTER.get(n))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    m = spark.sparkContext.master
    return m == "local" or m.startswith("local[")


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates: the session's ``spark.checkpoint.dir``.

    On a cluster it must be set, to a folder that driver and executors all reach; a local session (one machine, so any
    folder is shared) that names none gets one temporary folder for the application."""
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="riskloom-")
        d = _LOCAL[app]
    return d.rstrip("/")


_lock = threading.RLock()


def materialized(spark: SparkSession, key: str, build: Callable[[], DataFrame],
                 cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``build()`` once per application under the shared folder and read it back.

    A written table cuts the lineage for good: losing an executor later re-reads files instead of
    recomputing the model.
    """
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/riskloom/{app}/{key}.parquet"
    with _lock:
        if not _exists(spark, f"{path}/_SUCCESS"):
            save_frame(build(), path, cluster_by)
    return spark.read.parquet(path)


def staged(df: DataFrame, cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: cuts a plan that several later steps
    would otherwise each recompute."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/stage-{uuid.uuid4().hex}.parquet"
    save_frame(df, path, cluster_by)
    return spark.read.parquet(path)
