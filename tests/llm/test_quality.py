import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

quality = pytest.importorskip("riskloom.llm.quality")


def test_gradient_matches_differences():
    r = np.random.default_rng(1)
    x, first = r.normal(size=(12, 6)), np.array([0, 1, 5, 9])
    y = np.array([1.0, 0, 1, 0])
    m = quality.GatedAttention(x.mean(0), x.std(0))

    def loss():
        s = m.forward(x, first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = m.gradient(x, first, y, 0.0)
    for k in m.p:
        flat = m.p[k].reshape(-1)
        for i in (0, len(flat) // 2, len(flat) - 1):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[i]) < 1e-6, k


def test_encoding_is_per_text():
    texts = [b"", b"abc, DEF " * 1000, "é 12 ||".encode(), b"x" * (quality.SLICE + 700), b"\n"]
    x, first = quality.encode(texts)
    for t, lo, hi in zip(texts, first, list(first[1:]) + [len(x)]):
        assert np.array_equal(quality.encode([t])[0], x[lo:hi])
    assert np.allclose((x[:, :quality.N_FINE] ** 2).sum(1)[1:], 1)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    bad, good = out[out.quality == 0].score.values, out[out.quality == 1].score.values
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    print("auc", auc, "kept", (good >= 0.5).mean(), "dropped", (bad < 0.5).mean())
    assert auc > 0.97 and (good >= 0.5).mean() > 0.98 and (bad < 0.5).mean() > 0.9


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "word " * 300_000, None), (None, "x y", "z")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (5, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    rows = got.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_against_a_plain_loop(spark):
    """Every document's score from a loop over its passages, counted byte by byte."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    p, width = model.p, quality.PASSAGE

    def plain(raw: bytes) -> float:
        hs, ss = [], []
        for lo in range(0, max(1, len(raw)), width):
            part = raw[lo:lo + width]
            x = np.zeros(quality.WIDTH)
            for c in part:
                x[quality.FINE[c]] += 1
            for a, b in zip(part, part[1:]):
                x[quality.N_FINE + 8 * quality.COARSE[a] + quality.COARSE[b]] += 1
            x[:-1] = np.sqrt(x[:-1] / max(1, len(part)))
            x[-1] = np.log1p(max(1, len(part)))
            h = np.tanh((x - model.mean) / model.scale @ p["E"] + p["e"])
            hs.append(h)
            ss.append(float(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))) @ p["w"]))
        a = np.exp(np.array(ss) - max(ss))
        return float(1 / (1 + np.exp(-(sum(w * h for w, h in zip(a / a.sum(), hs)) @ p["c"] + p["b"][0]))))

    got = quality.score(docs, model, ["doc_id"]).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert max(abs(r.score - plain((r.text or "").encode())) for r in got) < 1e-4
