"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered lexicographically by (label, concatenated random hyperplane bits) and
cut into blocks of ``BLOCK`` neighbours; a block is compared with itself and with the next one. Passes
use other hyperplanes, so a pair that one order parts meets in another, and verified links are united.
How many passes a label takes follows from its rows: two rows that share one more leading bit than rows a
block apart do are less than a block apart, a pair at the threshold shares a bit with probability
1 - acos(cosine) / pi, and a few trial orders tell the depth of every block. Passes are added until such a
pair misses all of them with probability ``MISS`` at most.

A window is a cap on partners, so dense stretches get an exact way past it: samples of consecutive
blocks are compared, blocks whose samples link form a run, and all blocks of a run are compared, one
pair of blocks to a task. A pair that several passes compare counts in the first of them only, which
each row can tell from the block numbers it carries: links are counted where they are found and never
listed. A task reports its counts and a spanning forest, so what it sends is linear in its rows.

Equal vectors with one label are one class: copies count as links without being compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import Stages, components
from riskloom.llm.simhash import forest
from riskloom.llm.vectors import cosines, groups, matrix, packed, unit

COSINE = 0.93
PASSES = 12  # at least
TRIALS = 4
MISS = 1e-3
BITS = 32
BLOCK = 512
SAMPLES = 8


def planes(dim: int, passes: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, passes * BITS))


def needed(st: Stages, table: DataFrame, dim: int, passes: int, block: int, cosine: float) -> DataFrame:
    """(label, passes) for the labels of more than two blocks that need more than ``passes``."""
    trial = _keyed(table, dim, min(TRIALS, passes)).select("pass", "label", "key", "node")
    edge = _blocks(st, trial, block).filter("_i = 0").select("pass", "label", "blk", "key")
    nxt = edge.select("pass", "label", (F.col("blk") - 1).alias("blk"), F.col("key").alias("_next"))
    depth = F.lit(BITS + 1) - F.coalesce(F.length(F.regexp_replace(F.bin(F.col("key").bitwiseXOR(F.col("_next"))), "^0+", "")), F.lit(0))
    same = 1 - float(np.arccos(min(1.0, cosine)) / np.pi)
    hit = edge.join(nxt, ["pass", "label", "blk"]).groupBy("label").agg(F.avg(F.pow(F.lit(same), depth)).alias("q"))
    return hit.select("label", F.ceil(F.lit(float(np.log(MISS))) / F.log(1 - F.col("q"))).cast("int").alias("passes")).filter(F.col("passes") > passes)


def _keyed(table: DataFrame, dim: int, passes: int, own: DataFrame | None = None) -> DataFrame:
    """Rows once per pass with its key; ``own`` (label, passes) has the labels that take more than ``passes``."""
    most = max(passes, own.agg(F.max("passes")).first()[0] or 0) if own is not None else passes
    kind = table.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, weight = planes(dim, most), 1 << np.arange(BITS - 1, -1, -1)
        for b in batches:
            for lo in range(0, len(b), 4096):
                c = b.iloc[lo:lo + 4096]
                bits = (unit(matrix(c["v"], dim)) @ r > 0).reshape(len(c), most, BITS)
                yield c.assign(keys=list(bits @ weight))

    d = table.mapInPandas(run, f"node long, label {kind}, m long, v binary, keys array<long>")
    if own is not None:
        d = d.join(broadcast_if_small(own), "label", "left").withColumn("keys", F.slice("keys", F.lit(1), F.coalesce("passes", F.lit(passes))))
    return d.select("node", "label", "m", "v", F.posexplode("keys").alias("pass", "key"))


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def _blocks(st: Stages, keyed: DataFrame, block: int) -> DataFrame:
    """Rows in sorted order with ``blk``, the number of their block in the order of all passes."""
    rows = (keyed.repartitionByRange("pass", "label", "key", "node").sortWithinPartitions("pass", "label", "key", "node")
            .withColumn("_at", F.monotonically_increasing_id()))
    rows = st.write("sorted", rows)  # frozen: the numbering below reads it twice
    part, idx = F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    n = rows.groupBy(part).agg(F.max(idx).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    n = n.select(F.col("_p"), F.coalesce(F.sum(F.floor(F.col("_n") / block) + 1).over(before), F.lit(0)).alias("_first"))
    return (rows.withColumn("_p", part).join(F.broadcast(n), "_p")
            .withColumn("blk", (F.col("_first") + F.floor(idx / block)).cast("long")).withColumn("_i", (idx % block).cast("int")).drop("_p", "_first", "_at"))


def _runs(st: Stages, rows: DataFrame, dim: int, block: int, cosine: float) -> DataFrame:
    """(blk, lo, hi) for the blocks of runs: stretches whose consecutive blocks hold linked samples."""
    def vec(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pass": b["pass"], "label": b["label"], "blk": b["blk"], "x": list(matrix(b["v"], dim))})

    kind = rows.schema["label"].dataType.simpleString()
    s = (rows.filter(F.col("_i") % max(1, block // SAMPLES) == 0).select("pass", "label", "blk", "v")
         .mapInPandas(vec, f"pass int, label {kind}, blk long, x array<double>"))
    s = st.write("samples", s)
    nxt = s.select("pass", "label", (F.col("blk") - 1).alias("blk"), F.col("x").alias("y"))
    tied = s.join(nxt, ["pass", "label", "blk"]).filter(_cosine("x", "y") >= cosine).select("pass", "blk").distinct()
    w = Window.partitionBy("pass").orderBy("blk")  # over tied blocks, not rows
    tied = tied.withColumn("_g", F.col("blk") - F.row_number().over(w))
    isle = tied.groupBy("pass", "_g").agg(F.min("blk").alias("lo"), (F.max("blk") + 1).alias("hi"))
    # a block with two passes or labels can end one run and begin the next: they are one
    w = Window.orderBy("lo")
    isle = isle.select("lo", "hi").distinct()
    isle = isle.withColumn("_new", F.when(F.col("lo") > F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)), 1).otherwise(0))
    isle = isle.withColumn("_k", F.sum("_new").over(w)).groupBy("_k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return isle.select(F.explode(F.sequence("lo", "hi")).alias("blk"), "lo", "hi")


def _compare(c: pd.DataFrame, dim: int, cosine: float) -> pd.DataFrame | None:
    """Counts and forest of one cell: rows of side 0 against each other (if there is no side 2) and
    against the others."""
    x, node = matrix(c["v"], dim), c["node"].values
    u, side = unit(x), c["side"].values
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    own = not (side == 2).any()
    label, turn, m = c["label"].values, c["pass"].values, c["m"].values
    ii, jj = [], []
    for i, js in [(left, left)] * own + [(left, right)]:
        if not len(i) or not len(js):
            continue
        near = u[i] @ u[js].T >= cosine - 1e-9
        near &= (label[i][:, None] == label[js][None, :]) & (turn[i][:, None] == turn[js][None, :])
        p, q = np.nonzero(near)
        p, q = i[p], js[q]
        if js is left:
            p, q = p[p < q], q[p < q]
        ii.append(p)
        jj.append(q)
    i, j = (np.concatenate(ii), np.concatenate(jj)) if ii else (np.zeros(0, int), np.zeros(0, int))
    ok = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 15):  # the measure itself, on original vectors
        k = slice(lo, lo + (1 << 15))
        ok[k] = cosines(x[i[k]], x[j[k]]) >= cosine
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    blk, lo_ = np.stack(c["blks"].values), np.stack(c["runs"].values)
    t = turn[i]
    seen = np.zeros(len(i), bool)
    for q in range(blk.shape[1]):
        a, b = blk[i, q], blk[j, q]
        seen |= (q < t) & ((np.abs(a - b) <= 1) | ((lo_[i, q] >= 0) & (lo_[i, q] == lo_[j, q])))
    i, j = i[~seen], j[~seen]
    n = np.bincount(i, m[j], len(c)) + np.bincount(j, m[i], len(c))
    root = forest(len(c), i, j)
    hit = np.flatnonzero(n)
    return pd.DataFrame({"node": node[hit], "n": n[hit].astype(np.int64), "root": node[root[hit]]})


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
                    cosine: float = COSINE, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, hold null or non-finite components or have another length than most,
    and rows without a label, link with nothing: no links, a component of their own. Keys should be
    unique; rows that repeat one count as copies. An empty table gives an empty result."""
    st = Stages(df.sparkSession)
    v, dim = packed(df.filter(F.col(label).isNotNull()), vector, key, label)
    own = F.col(key).alias("vec_id")
    if not dim:
        return df.select(own, F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept")) \
            .select("vec_id", "n_links", F.col("component_id").cast("long"), "kept")
    v = st.write("vectors", v)
    table = st.write("classes", v.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("m")).select("node", "label", "m", "v"))
    more = st.write("passes", needed(st, table, dim, passes, block, cosine))
    most = max(passes, more.agg(F.max("passes")).first()[0] or 0)
    rows = _blocks(st, _keyed(table, dim, passes, more), block)
    runs = _runs(st, rows, dim, block, cosine)
    rows = rows.join(broadcast_if_small(st.write("runs", runs)), "blk", "left")
    rows = st.write("placed", rows.select("node", "label", "m", "v", "pass", "blk", "lo", "hi"))
    seat = (rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pass", "blk", F.coalesce("lo", F.lit(-1)).alias("lo")))).alias("s"))  # one entry per pass
            .select("node", *[F.concat(c, F.array_repeat(F.lit(-1).cast("long"), F.lit(most) - F.size(c))).alias(n) for c, n in (("s.blk", "blks"), ("s.lo", "runs"))]))
    far = F.when(F.col("lo").isNotNull(), F.filter(F.sequence("lo", "hi"), lambda o: F.abs(o - F.col("blk")) > 1)).otherwise(F.array().cast("array<long>"))
    cells = F.concat(
        F.array(F.struct(F.col("blk").alias("i"), F.col("blk").alias("j"), F.lit(0).alias("side")),
                F.struct((F.col("blk") - 1).alias("i"), (F.col("blk") - 1).alias("j"), F.lit(1).alias("side"))),
        F.transform(far, lambda o: F.struct(F.least(o, "blk").alias("i"), F.greatest(o, "blk").alias("j"),
                                            F.when(o > F.col("blk"), 0).otherwise(2).alias("side"))))
    dealt = (rows.join(seat, "node").withColumn("c", F.explode(cells))
             .select(F.concat_ws("-", "c.i", "c.j").alias("cell"), F.col("c.side").alias("side"), "pass", "label", "node", "m", "v", "blks", "runs")
             .repartition("cell").sortWithinPartitions("cell"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in groups(batches, "cell"):
            out = _compare(c, dim, cosine)
            if out is not None:
                yield out

    kind = v.schema["vec_id"].dataType.simpleString()
    found = st.write("found", dealt.mapInPandas(run, f"node {kind}, n long, root {kind}"))
    comp = st.write("component", components(st, found.select("node", "root"), "node", "root"))
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    member = (v.join(table.select("node", "label", "m", "v"), ["label", "v"]).select("vec_id", "node", "m")
              .join(count, "node", "left").join(comp, "node", "left")
              .select(F.col("vec_id").alias("_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"),
                      F.coalesce("component", "node").alias("component_id")).distinct())
    return (df.select(own).join(member, F.col("vec_id") == F.col("_id"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
