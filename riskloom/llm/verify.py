"""Near-duplicate texts whose shingle sets are compared.

Two documents are linked if the Jaccard similarity of their sets of word shingles (as XXH64 values) is at
least ``similar``, or if it is at least ``floor`` and their SimHash fingerprints differ in at most
``radius`` bits. Candidates come from the fingerprints and from ``BANDS`` bands of ``ROWS`` minimum
hashes: a pair at similarity s meets in a band with probability 1 - (1 - s^ROWS)^BANDS, 0.99994 at 0.8
whatever the size of the table. Each kind of candidate only joins documents to candidate components,
by stars and forests that are linear in the documents; inside a component every pair counts.

A component whose sets exceed ``CHUNK`` is dealt in chunks. Each chunk is first compared with itself and
with the component's smallest node; what that leaves outside the smallest node's class then meets all
other chunks, one pair of chunks to a task. Pairs that are united already are not compared, and a task
reports a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm import simhash
from riskloom.llm.common import Stages, components

SIMILAR = 0.8
FLOOR = 0.5
BANDS, ROWS = 32, 6
#: bytes of sets in one chunk of a component
CHUNK = 1 << 24


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(31).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return r[0], r[1] | np.uint64(1)


def bands(s: np.ndarray) -> np.ndarray:
    """One key per band of the minimum hashes of a set; none for the empty set, which only equals itself."""
    if not len(s):
        return np.zeros(0, np.int64)
    flip, times = _mixers()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 13):
        low = np.minimum(low, ((s[None, at:at + (1 << 13)] ^ flip) * times).min(axis=1))
    key = np.zeros(BANDS, np.uint64)
    for c in low.reshape(BANDS, ROWS).T:
        key = (key ^ c) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _described(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(doc_id, th, fp, node, bands): node stands for the shingle set and the fingerprint together."""
    from xxhash import xxh64_intdigest as xx

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, node, keys = [], [], []
            for t in b["t"]:
                h = simhash.shingles(t, shingle)
                f, s = simhash.majority(h), np.unique(h)
                fp.append(f)
                node.append(xx(s.tobytes() + f.to_bytes(8, "little"), 42))
                keys.append(bands(s))
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "fp": np.array(fp, np.uint64).view(np.int64),
                                "node": np.array(node, np.uint64).view(np.int64), "bands": keys})

    kind = docs.schema[key].dataType.simpleString()
    t = F.coalesce(F.col(text), F.lit(""))
    return (docs.select(F.col(key).alias("doc_id"), F.xxhash64(t).alias("th"), t.cast("binary").alias("t"))
            .mapInPandas(run, f"doc_id {kind}, th long, fp long, node long, bands array<long>"))


def _candidates(st: Stages, nodes: DataFrame, radius: int, parts: list[int] | None) -> DataFrame:
    """(node, component) of the nodes that may have a link."""
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    low = keyed.groupBy("band", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    stars = keyed.join(broadcast_if_small(st.write("bands", low)), ["band", "key"]).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    table = st.write("pivot_table", simhash.pivoted(first.select(F.col("first").alias("node"), "fp"), "long"))
    same = nodes.join(broadcast_if_small(st.write("first", first)), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    edges = stars.unionByName(same).unionByName(simhash.links(st, table, radius, parts=parts))
    return st.write("candidates", components(st, edges))


def _sets(docs: DataFrame, text: str, key: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``wanted`` (_id, _th, node, fp, component) with the shingle set of each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [np.unique(simhash.shingles(t, shingle)).tobytes() for t in b["t"]]
            yield pd.DataFrame({"component": b["component"], "node": b["node"], "fp": b["fp"], "s": s})

    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("_k"), F.xxhash64(t).alias("_t"), t.cast("binary").alias("t"))
    d = d.join(broadcast_if_small(wanted), F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th"))).dropDuplicates(["node"])
    return d.select("component", "node", "fp", "t").mapInPandas(run, "component long, node long, fp long, s binary")


def united(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None, radius: int, similar: float, floor: float) -> np.ndarray:
    """``label`` (a class number per set, the smallest index of its class) after all links; with ``side``
    only sets of different sides are compared."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, ids = np.unique(flat, return_inverse=True)
    ids = ids.astype(np.int64)
    order = np.argsort(ids, kind="stable")
    posts, count = owner[order], np.bincount(ids)
    first, starts = np.cumsum(count) - count, np.cumsum(sizes) - sizes
    for i in range(n - 1):
        todo = label[i + 1:] != label[i]
        if side is not None:
            todo &= side[i + 1:] != side[i]
        if not todo.any():
            continue
        own = ids[starts[i]:starts[i] + sizes[i]]
        c = count[own]
        at = np.arange(c.sum()) + np.repeat(first[own] - (np.cumsum(c) - c), c)
        both = np.bincount(posts[at], minlength=n)[i + 1:]
        either = np.maximum(sizes[i] + sizes[i + 1:] - both, 1)
        same = (sizes[i] == 0) & (sizes[i + 1:] == 0)
        hit = todo & (same | (both >= similar * either) | ((both >= floor * either) & (np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius)))
        if hit.any():
            old = np.unique(np.append(label[i + 1:][hit], label[i]))
            label[np.isin(label, old)] = old[0]
    return label


def _linked(cells: DataFrame, radius: int, similar: float, floor: float) -> DataFrame:
    """(a, b): spanning links of every cell of ``cells`` (component, c0, c1, c, node, root, fp, s)."""

    def one(b: pd.DataFrame, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        node, root = b["node"].values[lo:hi], b["root"].values[lo:hi]
        _, at, back = np.unique(root, return_index=True, return_inverse=True)
        label, side = at[back].copy(), b["c"].values[lo:hi]
        cross = b["c0"].values[lo] != b["c1"].values[lo]
        sets = [np.frombuffer(x, np.uint64) for x in b["s"].values[lo:hi]]
        label = united(b["fp"].values[lo:hi].view(np.uint64), sets, label, side if cross else None, radius, similar, floor)
        own = node[label] != node
        return node[own], node[label[own]]

    def cut(b: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(b), bool)
        new[1:] = False
        for x in ("component", "c0", "c1"):
            new[1:] |= b[x].values[1:] != b[x].values[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:  # sorted by cell; the last cell of a batch may go on
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            at = cut(b)
            found = [one(b, lo, hi) for lo, hi in zip(at[:-1], at[1:]) if hi - lo > 1]
            held = b.iloc[at[-1]:]
            if found:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})
        if held is not None and len(held) > 1:
            x, y = one(held, 0, len(held))
            yield pd.DataFrame({"a": x, "b": y})

    by = ["component", "c0", "c1"]
    return cells.select(*by, "c", "node", "root", "fp", "s").repartition(*by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long")


def classes(docs: DataFrame, text: str, key: str, radius: int, shingle: int, parts: list[int] | None = None,
            similar: float = SIMILAR, floor: float = FLOOR, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text) and cls, the number of its class of
    documents that links connect. A null text is an empty one; texts without a word are one class."""
    st = Stages(docs.sparkSession)
    d = st.write("described", _described(docs, text, key, shingle))
    nodes = st.write("nodes", d.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "th")).alias("r"))
                     .select("node", "fp", "bands", F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th")))
    cand = _candidates(st, nodes.select("node", "fp", "bands"), radius, parts)
    wanted = st.write("wanted", nodes.drop("bands").join(broadcast_if_small(cand), "node"))
    sets = st.write("sets", _sets(docs, text, key, shingle, wanted))
    size = sets.groupBy("component").agg(F.ceil(F.sum(F.octet_length("s") + F.lit(64)) / chunk).cast("int").alias("k"))
    big = st.write("big", size.filter("k > 1"))
    sets = (sets.join(broadcast_if_small(big), "component", "left").withColumn("k", F.coalesce("k", F.lit(1)))
            .withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))

    # each chunk with itself and with the component's smallest node, which stands for it
    every = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("c"))
    cells = sets.withColumn("c0", F.explode(every)).withColumn("c1", F.col("c0")).withColumn("root", F.col("node"))
    links = st.write("links", _linked(cells, radius, similar, floor))
    if big.head(1):
        comp = st.write("inside", components(st, links))
        rows = (sets.filter("k > 1").join(comp.withColumnRenamed("component", "root"), "node", "left")
                .withColumn("root", F.coalesce("root", "node")))
        top = rows.filter("node = component").select("component", F.col("root").alias("_top"))
        rows = st.write("rows", rows.join(broadcast_if_small(top), "component").withColumn("loose", F.col("root") != F.col("_top")).drop("_top"))
        open_ = rows.filter("loose").groupBy("component").agg(F.collect_set("c").alias("_open"))  # chunk numbers
        others = F.when(F.col("loose"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.col("_open"))
        cells = (rows.join(broadcast_if_small(open_), "component").withColumn("o", F.explode(others)).filter("o <> c")
                 .withColumn("c0", F.least("o", "c")).withColumn("c1", F.greatest("o", "c")))
        links = links.unionByName(st.write("across", _linked(cells, radius, similar, floor)))
    comp = st.write("classes", components(st, links))
    return d.join(broadcast_if_small(comp), "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("cls"))
