import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")
simhash = pytest.importorskip("riskloom.llm.simhash")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def plain_classes(fps, radius=4):
    """Smallest reachable key by all pairs."""
    keys = sorted(fps)
    v = np.array([fps[k] for k in keys], np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    label = np.arange(len(keys))
    while True:
        new = np.where(near, label[None, :], len(keys)).min(1)
        if (new == label).all():
            return {k: keys[x] for k, x in zip(keys, label)}
        label = new


def test_fingerprint():
    for t in ["", "a", "A b", "a b c", "a b c d", "A\tb\x0b c\n d É f g", "x " * 200_000, " \n\t"]:
        assert simhash.simhash(t.encode()) == plain_fingerprint(t), t[:20]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    d = f"/root/testdata/{sf}"
    got = simhash.op6_simhash(spark, d).toPandas()
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").toPandas()
    fps = {i: plain_fingerprint(t) for i, t in zip(texts.doc_id, texts.text)}
    want = plain_classes(fps)
    assert len(got) == len(texts)
    assert dict(zip(got.doc_id, got.fingerprint)) == {k: f"{v:016x}" for k, v in fps.items()}
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert len(set(want.values())) < len(want)


def test_links_in_split_groups(spark):
    """Chains of fingerprints, one flipped bit apart, in groups larger than a chunk."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 6).tolist()
    rows, n = [], 0
    for b in base:
        x = b
        for _ in range(90):
            rows.append((n, x))
            n += 1
            x ^= 1 << int(rng.integers(0, 63))
    rows += [(n + k, int(v)) for k, v in enumerate(rng.integers(0, 2**62, 300))]
    fps = dict(rows)
    first = {}
    for k, v in rows:
        first.setdefault(v, k)
    ref = simhash.references()
    pdf = pd.DataFrame({"node": list(first.values()), "fp": list(first.keys())})
    pdf["dist"] = [np.bitwise_count(np.uint64(f) ^ ref).astype(np.uint8).tobytes() for f in pdf.fp]
    table = spark.createDataFrame(pdf, "node long, fp long, dist binary")
    from riskloom.llm.common import Stages, components

    for chunk in (16, 100_000):
        st = Stages(spark)
        comp = components(st, simhash.links(st, table, 4, chunk)).toPandas()
        want = plain_classes({v: k for k, v in first.items()})
        got = {k: k for k in first.values()} | dict(zip(comp.node, comp.component))
        assert got == want


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (4, "a b c d e", "y"), (5, "A B C d e", "y"), (5, "other words are here now", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("node", F.lit(1))
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 5]


def test_links_broadcast_no_rows_that_the_plan_cannot_size(spark, tmp_path):
    """A fingerprint has one row per mask, of which the plan's estimate knows nothing: neither the rows nor their counts are broadcast."""
    table = spark.range(2000).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"))
    simhash.pivoted(table, "long").write.parquet(str(tmp_path / "t"))
    d = simhash.links(None, spark.read.parquet(str(tmp_path / "t")), 10, parts=simhash.sampled_masks(16, 48))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
