"""SimHash near-duplicates with pivot distance tables.

A fingerprint is the bitwise majority of the XXH64 values of a text's 4-word shingles. Two documents
are linked when their fingerprints differ in at most ``radius`` bits; components are classes of
near-duplicates. Equal fingerprints are one node, so copies are never expanded.

The pivot table holds each fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints. By
the triangle inequality a linked pair differs by at most ``radius`` in every coordinate, so a pair is
discarded by its largest coordinate difference and only survivors are verified. In 64 bits distances
to references bunch around 32, so the table alone would face all pairs: it works inside partitions
that lose no link. The word is cut into radius + 2 blocks; a linked pair agrees on two blocks at
least, hence has coordinate difference zero to every reference that lives in them, and every pair of
blocks is one partitioning. Partitions beyond ``CHUNK`` fingerprints are split into chunk pairs, each
a task of its own; a task reports a spanning forest of its links, not the links.

Wider radii leave no useful blocks. ``sampled_masks`` partitions by fixed random sets of bits instead:
a pair at distance d meets in one of t sets of b bits with probability 1 - (1 - (1 - b/64)^d)^t.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import Stages, components, free

SHINGLE = 4
PIVOTS = 16
CHUNK = 2048


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: the zero word and fixed random words."""
    r = np.random.default_rng(7).integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    r[0] = 0
    return r


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 values of a UTF-8 text's shingles in order: A-Z lower-cased, words split at ASCII white space,
    ``n`` words joined by one space; fewer words are one shingle, no word gives none."""
    from xxhash import xxh64_intdigest as xx

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))).tolist()
    k = max(1, len(words) - n + 1)
    starts = [0] + [e + 1 for e in ends[: k - 1]]
    return np.fromiter((xx(joined[s:e], 42) for s, e in zip(starts, ends[min(n, len(words)) - 1:])), np.uint64, k)


def majority(h: np.ndarray) -> int:
    """Bitwise majority of hashes, repeats counted; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a block at a time: the bits of a long text are never all held
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, n: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text."""
    return majority(shingles(text, n))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null texts are empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((simhash(t, shingle) for t in b["t"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
            .mapInPandas(run, f"doc_id {kind}, fp long"))


def masks(radius: int) -> list[int]:
    """One mask per pair of the radius + 2 blocks of the word."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    block = [((1 << int(b)) - (1 << int(a))) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(block, 2)]


def sampled_masks(bits: int, sets: int, seed: int = 23) -> list[int]:
    r = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in r.choice(64, bits, replace=False)) for _ in range(sets)]


def survivors(i: np.ndarray, j: np.ndarray, fp: np.ndarray, dist: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) no coordinate discards and whose distance is at most ``radius``."""
    for c in range(dist.shape[1]):
        ok = np.abs(dist[i, c] - dist[j, c]) <= radius
        i, j = i[ok], j[ok]
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= radius
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item of its component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        ok = label[i] != label[j]
        i, j = i[ok], j[ok]
    return label


def links(stages: Stages, table: DataFrame, radius: int, chunk: int = CHUNK, parts: list[int] | None = None) -> DataFrame:
    """(a, b): links that connect every component of ``table`` (node, fp, dist), found partition by
    partition; ``parts`` are the masks to partition by, by default those that lose no link."""
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")) for m in parts or masks(radius)]))
    keyed = table.select("node", "fp", "dist", keys.alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the plan sizes both sides as if a fingerprint had one key, so it must not choose a broadcast by them
    keyed = (keyed.join(sizes.hint("merge"), ["t", "key"]).withColumn("k", F.ceil(F.col("n") / chunk).cast("int"))
             .withColumn("c", F.when(F.col("k") > 1, F.pmod(F.xxhash64("fp"), F.col("k"))).otherwise(0).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("t", "key", F.least("c", "o").alias("c0"), F.greatest("c", "o").alias("c1"), "c", "node", "fp", "dist"))
    kind = table.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:  # sorted by group; the last group of a batch may go on
            group = (b["t"].values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                     ^ b["key"].values.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                     ^ (b["c0"].values.astype(np.uint64) << np.uint64(32) | b["c1"].values.astype(np.uint64)) * np.uint64(0x94D049BB133111EB))
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
            if cut:
                yield link_groups(pd.concat([*held, b.iloc[:cut]]), radius)
                held = []
            held.append(b.iloc[cut:])
        if held:
            yield link_groups(pd.concat(held), radius)

    dealt = keyed.repartition("t", "key", "c0", "c1").sortWithinPartitions("t", "key", "c0", "c1")
    return dealt.mapInPandas(run, f"a {kind}, b {kind}")


def link_groups(b: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Spanning links of all groups (runs of equal t, key, c0, c1) of ``b``."""
    fp = b["fp"].values.view(np.uint64)
    dist = np.frombuffer(b"".join(b["dist"]), np.uint8).reshape(len(b), -1).astype(np.int16)
    same = np.ones(len(b), bool)
    for c in ("t", "key", "c0", "c1"):
        v = b[c].values
        same[1:] &= v[1:] == v[:-1]
    same[0] = False
    gid = np.cumsum(~same)
    sizes = np.bincount(gid)[1:]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    node = b["node"].values
    ii, jj = [], []
    step = 1
    small = np.repeat(sizes <= 64, sizes)
    top = int(sizes[sizes <= 64].max(initial=0))
    while step < top:  # all small groups at once, by offset
        i = np.flatnonzero(small[:-step] & (gid[:-step] == gid[step:]))
        i, j = survivors(i, i + step, fp, dist, radius)
        ii.append(i)
        jj.append(j)
        step += 1
    side = (b["c"].values == b["c0"].values)
    cross = b["c0"].values != b["c1"].values
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        rows = np.arange(s, s + n)
        left, right = (rows[side[rows]], rows[~side[rows]]) if cross[s] else (rows, rows)
        for at in range(0, len(left), 256):
            x = left[at:at + 256]
            near = np.ones((len(x), len(right)), bool)
            for c in range(dist.shape[1]):
                near &= np.abs(dist[x, c][:, None] - dist[right, c][None, :]) <= radius
            p, q = np.nonzero(near)
            i, j = survivors(x[p], right[q], fp, dist[:, :0], radius)
            ii.append(i)
            jj.append(j)
    if not ii:
        return pd.DataFrame({"a": node[:0], "b": node[:0]})
    label = forest(len(b), np.concatenate(ii), np.concatenate(jj))
    own = label != np.arange(len(b))
    return pd.DataFrame({"a": node[own], "b": node[label[own]]}).drop_duplicates()


def pivoted(table: DataFrame, kind: str) -> DataFrame:
    """``table`` (node, fp) with the distances of each fingerprint to the references."""
    ref = references()

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.bitwise_count(b["fp"].values.view(np.uint64)[:, None] ^ ref[None, :]).astype(np.uint8)
            yield b.assign(dist=[r.tobytes() for r in d])

    return table.mapInPandas(distances, f"node {kind}, fp long, dist binary")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, shingle: int = SHINGLE, parts: list[int] | None = None) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; component_id is the smallest key reachable
    by links; a row with a null key gets its class's smallest key, null if it has none. Null and empty texts and texts of white space have fingerprint zero
    and are linked like any other; a text of any length is one pass in bounded memory; rows that repeat
    a key keep a row each; an empty table gives an empty result; other columns are not read."""
    st = Stages(docs.sparkSession)
    fps = st.write("fingerprints", fingerprints(docs, text, key, shingle))
    reps = st.write("nodes", fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    table = st.write("pivot_table", pivoted(reps.select("node", "fp"), docs.schema[key].dataType.simpleString()))
    comp = components(st, links(st, table, radius, parts=parts))
    reps = reps.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(broadcast_if_small(reps), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, shingle: int = SHINGLE,
               parts: list[int] | None = None, **kw) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their class of near-duplicates, as ``verify``
    compares them; rows repeating that key all stay. Of a class without a key one row stays, one with
    the smallest text hash."""
    from riskloom.llm import verify

    rows = verify.classes(docs, text, key, radius, shingle, parts, **kw)
    k, h = free(docs, "_key", "_h")
    first = Stages(docs.sparkSession).write("first", rows.groupBy("cls").agg(F.min("doc_id").alias(k), F.min("th").alias(h)))
    named = docs.join(first.filter(F.col(k).isNotNull()).select(k).distinct(), docs[key] == F.col(k), "left_semi")
    rest = docs.filter(F.col(key).isNull()).withColumn(h, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rest = rest.join(broadcast_if_small(first.filter(F.col(k).isNull()).select(h).distinct()), h, "left_semi").dropDuplicates([h])
    return named.unionByName(rest.select(*docs.columns))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
