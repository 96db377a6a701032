"""Approximate nearest neighbours by an inverted multi-index.

Vectors (scaled to length 1) are cut into halves, each half quantised by its own k-means codebook;
a cell of the index is a pair of centroids. For a query the cells are visited in order of the summed
distance of its halves to the two centroids: a heap walks the two sorted distance lists, and stops
once the visited cells hold the share ``reach`` of all entries. The entries of these cells are reranked by exact
cosine on the original vectors.

How large a share is needed depends on the vectors: half of them for components that are independent
noise (the nearest of such vectors are hardly nearer than others), a few hundredths for clustered ones.

The codebooks are fitted on at most ``sample`` vectors, drawn by a hash of the id; every vector is
indexed. Codebooks and the counts of the k x k cells are all that the driver sees; k is a parameter.
A crowded cell is split into chunks of about ``CHUNK`` entries by a hash, so that no cell is one task's
burden; each (cell, chunk) returns the k best of each visiting query, at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import Stages
from riskloom.llm.vectors import cosines, groups, matrix, packed, unit

CENTROIDS = 32
SAMPLE = 20_000
REACH = 0.55
CHUNK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Codebook of at most k rows; empty clusters move to the worst-served points."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[np.argsort(-d.min(1))[: (n == 0).sum()]]
    return c


def assign(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1)[None, :] - 2 * x @ book.T).argmin(1)


def walk(d1: np.ndarray, d2: np.ndarray, count: np.ndarray, reach: float) -> list[int]:
    """Cells (i * len(d2) + j) with entries, by increasing d1[i] + d2[j], until they hold ``reach`` entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out, got = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and got < reach:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if count[cell]:
            out.append(cell)
            got += count[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(d1) and b < len(d2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(df: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id",
           centroids: int = CENTROIDS, reach: float = REACH, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``queries`` (a subset of the
    columns and kind of ``df``) among the rows of ``df`` with another key, by cosine in double precision.

    Vectors that are null, zero, hold null or non-finite components or have another length than most
    take no part on either side. Ties go to the smaller key; equal vectors score equally. Rows that
    repeat a key count once; a query without candidates has no row; empty tables give an empty result."""
    st = Stages(df.sparkSession)
    v, dim = packed(df, vector, key)
    kind = v.schema["vec_id"].dataType.simpleString()
    if not dim:
        return df.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    v = st.write("vectors", v.select("vec_id", "v").distinct())
    fit = v.orderBy(F.xxhash64("vec_id"), "v").limit(sample).toPandas()  # at most ``sample`` rows
    half = max(1, dim // 2)
    x = unit(matrix(fit["v"], dim))
    books = kmeans(x[:, :half], centroids), kmeans(x[:, half:] if dim > 1 else x, centroids)
    second = slice(half, None) if dim > 1 else slice(None)
    width = len(books[1])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 4096):
                c = b.iloc[lo:lo + 4096]
                u = unit(matrix(c["v"], dim))
                yield c.assign(cell=assign(u[:, :half], books[0]) * width + assign(u[:, second], books[1]))

    entries = st.write("index", v.mapInPandas(index, f"vec_id {kind}, v binary, cell long"))
    count = np.zeros(len(books[0]) * width, np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most centroids squared
        count[r["cell"]] = r["count"]
    chunks = np.maximum(1, -(-count // CHUNK))
    enough = max(reach * count.sum(), k + 1)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = unit(matrix(b["v"], dim))
            d = [((a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1)[None, :]) for a, c in ((u[:, :half], books[0]), (u[:, second], books[1]))]
            for i, (q, raw) in enumerate(zip(b["vec_id"], b["v"])):
                cells = walk(d[0][i], d[1][i], count, enough)
                yield pd.DataFrame([(q, raw, f"{c}-{h}", True) for c in cells for h in range(chunks[c])], columns=["vec_id", "v", "part", "query"])

    q, _ = packed(queries, vector, key, dim=dim)
    asked = q.select("vec_id", "v").distinct().mapInPandas(visits, f"vec_id {kind}, v binary, part string, query boolean")
    many = {int(c): int(n) for c, n in enumerate(chunks) if n > 1}
    n_of = F.coalesce(F.create_map(*[F.lit(y) for p in many.items() for y in p])[F.col("cell").cast("int")], F.lit(1)) if many else F.lit(1)
    dealt = entries.select("vec_id", "v", F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id"), n_of)).alias("part"), F.lit(False).alias("query"))

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "part"):
            ask = g["query"].values
            e, w = g[~ask], g[ask]
            if not len(e) or not len(w):
                continue
            x, ids = matrix(e["v"], dim), e["vec_id"].values
            norm, out = np.sqrt((x * x).sum(1)), []
            for qid, raw in zip(w["vec_id"], w["v"]):
                s = cosines(x, np.frombuffer(raw, np.float64), norm)
                s[ids == qid] = -2.0
                at = best(s, ids, k + 1)
                at = at[s[at] >= -1.5][:k]
                out.append((np.repeat(qid, len(at)), ids[at], s[at]))
            q, i, s = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    both = dealt.unionByName(asked).repartition("part").sortWithinPartitions("part")
    found = both.mapInPandas(rerank, f"query_id {kind}, vec_id {kind}, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op7_ann(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(df, df.filter("vec_id % 50 = 0"))
