import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

suffix = pytest.importorskip("riskloom.llm.suffix_dedup")
common = pytest.importorskip("riskloom.llm.common")


def plain(docs, length=50):
    """docs: key -> bytes. Every string of every document against a table of first holders."""
    first = {}
    for k in sorted(docs):
        t = docs[k]
        for i in range(len(t) - length + 1):
            first.setdefault(t[i:i + length], k)
    out = {}
    for k, t in docs.items():
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < k:
                gone[i] += 1
                gone[min(len(t), i + length)] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask]) if len(t) else b""
        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(t) else 0
        out[k] = (len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def answer(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_merged_intervals():
    r = np.random.default_rng(1)
    for length, shard in ((6, 20), (7, 1000), (10, 64)):
        texts = r.integers(97, 100, (40, 2 * length), dtype=np.uint8)
        texts[20:30, 3:3 + length] = texts[5, 1:1 + length]
        got = suffix.merge(texts, length, shard)
        both = np.concatenate([texts, texts], axis=1)
        key = [[bytes(both[i, j:j + length]) for j in range(texts.shape[1] - length + 1)] for i in range(len(texts))]
        assert got.shape == (len(texts), texts.shape[1] - length + 1)
        flat = sorted({k for row in key for k in row})
        assert all(flat[got[i, j]] == key[i][j] for i in range(len(texts)) for j in range(got.shape[1]))


def test_every_string_holds_an_anchor():
    rnd = random.Random(5)
    for t in (bytes(rnd.choices(b"ab", k=400)), b"a" * 300, bytes(rnd.choices(range(97, 123), k=700)), b"x" * 49, b""):
        at, h, c = suffix.anchors(t)
        for i in range(len(t) - 49):
            assert ((at >= i) & (at + 16 <= i + 50)).any()
        assert len(at) == len(set(at.tolist()))
    old = suffix.SLICE
    t = bytes(rnd.choices(b"abcd ", k=5000))
    whole = suffix.anchors(t)
    suffix.SLICE = 700
    try:
        parts = suffix.anchors(t)
    finally:
        suffix.SLICE = old
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_first_holders(spark, sf):
    d = f"/root/testdata/{sf}"
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").toPandas()
    want = plain({int(i): (x or "").encode() for i, x in zip(t.doc_id, t.text)})
    got = answer(suffix.op3_suffix_dedup(spark, d))
    assert got == want
    assert sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("hot", [suffix.HOT, 2, 1])
def test_repeats_at_borders_overlaps_and_periods(spark, hot):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    p, q = word(120), word(60)
    rows = [(5, p), (7, p + word(30)), (2, word(40) + p[:50]), (9, word(10) + p[20:100] + q), (11, q), (12, q[:49] + "Z"), (13, "ab" * 400), (20, "ab" * 90 + "c"), (21, "é" * 80),
            (30, "éé" * 60), (31, p), (32, p), (33, q[5:] + p[:55] + q), (40, "x" * 49), (41, "x" * 49), (42, "x" * 50), (43, "x" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.remove_repeats(df, with_kept=True, hot=hot).collect()
    want = plain({k: t.encode() for k, t in rows})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(r.ends) - sum(r.starts) == r.n_removed


@pytest.mark.parametrize("hot", [suffix.HOT, 40])
def test_a_line_in_a_third_of_all_documents_and_own_text_after_it(spark, hot):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcdefgh \n", k=n))
    line = word(70)
    rows = [(i, word(rnd.randint(0, 90)) + (line * (1 + i % 2) if i % 3 == 0 else "") + word(rnd.randint(0, 90))) for i in range(600)]
    rows += [(1000 + i, "same line\n" * 40 + word(20)) for i in range(30)]
    got = answer(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot))
    assert got == plain({k: t.encode() for k, t in rows})


def test_contexts_that_cannot_hold_a_repeat_are_left_out():
    r = np.random.default_rng(6)
    texts = r.integers(97, 105, (500, 84), dtype=np.uint8)
    texts[:, 34:50] = 120  # one anchor
    for k in range(0, 100, 2):  # pairs that share a string of 50 bytes around the anchor
        o = int(r.integers(0, 35))
        texts[k, o:o + 50] = texts[k + 1, o:o + 50]
    keep = suffix._meets(np.full(500, 7, np.int64), texts, 50)
    assert keep[:100].all() and keep[100:].sum() < 20


def test_a_repeat_whose_anchors_also_stand_elsewhere(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    p = word(300)
    rows = [(1, p), (2, word(80) + p + word(80))]
    at = suffix.anchors(p.encode())[0].tolist() * 8
    rows += [(100 + i, word(60) + p[x:x + 16] + word(60)) for i, x in enumerate(at)]  # its anchors in other company
    got = answer(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain({k: t.encode() for k, t in rows})
    assert got[2][1] >= 300


def test_different_texts_under_one_key(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    p, q, z = word(200), word(150), word(90)
    rows = [(1, p), (1, q), (1, q), (2, word(30) + p[20:160]), (2, q[:120] + word(9)), (2, q), (2, z), (2, z + "!"), (3, z + p + word(5)), (3, z[:60] + q), (3, z[:60] + q)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()

    def kept(k, t):
        gone = {j for i in range(len(t) - 49) if any(t[i:i + 50] in o for n, o in rows if n < k) for j in range(i, i + 50)}
        return "".join(c for j, c in enumerate(t) if j not in gone)

    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got) == sorted((k, kept(k, t)) for k, t in rows)
    assert sum(r.n_removed for r in got) == sum(len(t) - len(kept(k, t)) for k, t in rows) > 900


def test_edge_rows(spark):
    long = "w" * 60
    rows = [(1, None, 1), (2, "", 2), (3, long, 3), (3, long, 3), (4, long, 4), (None, long, 5), (5, "other " * 20, 6), (5, "and other " * 20, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int").withColumn("n", F.lit("clash"))
    got = suffix.remove_repeats(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 0), (4, 60), (5, 0), (5, 0)]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p.name for d in disk.localDirsString() for p in Path(d).rglob("shuffle_*.data")}


def _some_rows():
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    p = word(400)
    return [(i, word(100) + p[i % 7 * 20:i % 7 * 20 + 150] + word(40)) for i in range(60)] + [(3, word(70) + p[:90]), (90, p), (91, p)]


def test_shuffle_files_go_with_each_written_table(spark):
    df = spark.createDataFrame(_some_rows(), "doc_id long, text string").repartition(3)
    setting, before = spark.conf.get(common.CLEAN), _shuffle_files(spark)
    got = suffix.remove_repeats(df)
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:  # files go in the background
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(common.CLEAN) == setting
    first, again = got.collect(), got.collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 63


def test_texts_are_dealt_by_one_key_where_nothing_is_broadcast(spark, monkeypatch):
    plans = {}

    class Seen(common.Stages):
        def write(self, name, df):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().write(name, df)

    monkeypatch.setattr(suffix, "Stages", Seen)
    monkeypatch.setattr(suffix, "broadcast_if_small", lambda df: df)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffix.remove_repeats(spark.createDataFrame(_some_rows(), "doc_id long, text string"), with_kept=True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#", plans["decided"])
    assert keys and set(keys) == {("doc", "th")}

    rows = _some_rows()

    def kept(k, t):
        gone = {j for i in range(len(t) - 49) if any(t[i:i + 50] in o for n, o in rows if n < k) for j in range(i, i + 50)}
        return "".join(c for j, c in enumerate(t) if j not in gone)

    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in got) == sorted((k, kept(k, t)) for k, t in rows)
    assert sum(r.n_removed for r in got) > 1000
