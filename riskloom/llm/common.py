"""Pieces the corpus operators share: written stages and connected components."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.frames import CLEAN, cleaned, shared_folder  # noqa: F401

#: a word of the contracts: a run of anything but space, tab, line feed, VT, FF and CR
WORD = r"[^\x20\x09-\x0D]+"


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of ``df`` has, each begun with its stem."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"{x}{'_' * k}").lower() not in taken) for x in stems]


class Stages:
    """Tables written under the shared folder. A written table cuts the lineage, so that a lost
    executor means rereading files; ``drop`` frees those that no later step reads. With ``clean`` the shuffle files
    behind a table are freed once it is written."""

    def __init__(self, spark: SparkSession, clean: bool = False):
        self.spark, self.clean = spark, clean
        self.root = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/llm-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        with cleaned(self.spark) if self.clean else contextlib.nullcontext():
            df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _mark(e: DataFrame):
    """Order-free fingerprint of an edge set."""
    return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def components(stages: Stages, edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components as (node, component), component = smallest node; nodes without a link to
    another node are absent. Null ends and self-links are ignored, repeated links count once.

    Alternating large-star and small-star steps: every edge is redirected to the smallest neighbour
    until each component is a star. Edges never multiply, nothing is collected, and each round is a
    written table; the number of rounds grows with the logarithm of the longest path."""
    e = (edges.filter(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = stages.write("edges_0", e)
    mark, last = _mark(e), "edges_0"
    for k in range(1, rounds + 1):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).distinct())
        nxt = stages.write(f"edges_{k}", small)
        seen = _mark(nxt)
        e, done = nxt, tuple(seen) == tuple(mark)
        stages.drop(last)
        mark, last = seen, f"edges_{k}"
        if done:
            break
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
