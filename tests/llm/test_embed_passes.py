import numpy as np
import pytest

embed = pytest.importorskip("riskloom.llm.embed_dedup")


def test_recall_in_a_label_much_larger_than_a_block(spark):
    """Pairs at the threshold, strewn over 500 blocks of one label."""
    r = np.random.default_rng(8)
    n, dim, block = 1500, 24, 32
    noise = r.normal(size=(block * 500 - 2 * n, dim))
    a = r.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = r.normal(size=(n, dim))
    u -= (u * a).sum(1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x = np.concatenate([a, 0.931 * a + np.sqrt(1 - 0.931**2) * u, noise])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(y[at:at + 1000] @ y.T >= embed.COSINE).sum(1) - 1 for at in range(0, len(x), 1000)])
    df = spark.createDataFrame([(k, "hot", v) for k, v in enumerate(x.tolist())], "vec_id long, label string, embedding array<double>")
    got = embed.near_duplicates(df, block=block).toPandas().sort_values("vec_id")
    assert want.sum() >= 2 * n and (got.n_links.values <= want).all()
    assert got.n_links.sum() >= 0.998 * want.sum()
