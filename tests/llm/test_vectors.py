import numpy as np
import pandas as pd
import pytest

ann = pytest.importorskip("riskloom.llm.ann")
dedup = pytest.importorskip("riskloom.llm.embed_dedup")
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(df, cosine=0.93):
    """n_links and smallest reachable id by all pairs."""
    ok = [lab is not None and not pd.isna(lab) and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)
          for v, lab in zip(df.embedding, df.label)]
    at = np.flatnonzero(ok)
    x = np.array([np.array(df.embedding[i], float) for i in at])
    n = np.sqrt((x * x).sum(1))
    near = (x @ x.T / n[:, None] / n[None, :]) >= cosine
    lab = df.label.values[at]
    near &= lab[:, None] == lab[None, :]
    np.fill_diagonal(near, False)
    ids = df.vec_id.values[at]
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], ids.max()).min(1))
        if (new == low).all():
            break
        low = new
    out = {i: (0, i) for i in df.vec_id}
    out.update({i: (int(k), int(c)) for i, k, c in zip(ids, near.sum(1), low)})
    return out


def clustered(seed=4, extra=400):
    """A dense group larger than a few blocks, small groups, copies and noise, in two labels."""
    r = np.random.default_rng(seed)
    rows = []
    for size, spread in ((300, 0.03), (40, 0.03), (3, 0.04), (2, 0.01), (25, 0.0)):
        c = r.normal(size=16)
        rows += [(c + spread * r.normal(size=16), 1) for _ in range(size)]
    rows += [(r.normal(size=16), int(r.integers(1, 3))) for _ in range(extra)]
    order = r.permutation(len(rows))
    return [(int(i), rows[k][0].astype(np.float32).tolist(), rows[k][1]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [16, 512])
def test_dedup_against_all_pairs(spark, block):
    rows = clustered()
    got = dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, passes=12).toPandas()
    want = plain(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]))
    assert len(got) == len(rows)
    pairs = sum(v[0] for v in want.values())
    found = got.n_links.sum()
    assert found <= pairs and found >= 0.999 * pairs
    assert (got.n_links <= [want[i][0] for i in got.vec_id]).all()
    assert dict(zip(got.vec_id, got.component_id)) == {k: v[1] for k, v in want.items()}
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_dedup_query_on_the_given_table(spark):
    d = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    got = dedup.op2_embedding_dedup(spark, d).toPandas()
    want = plain(df)
    assert dict(zip(got.vec_id, zip(got.n_links, got.component_id))) == want


def test_dedup_of_a_hot_group(spark):
    """A third of the rows are copies of one vector, another part lies around it."""
    r = np.random.default_rng(8)
    c = r.normal(size=32)
    x = [c] * 500 + [c + 0.05 * r.normal(size=32) for _ in range(200)] + [r.normal(size=32) for _ in range(700)]
    rows = [(int(i), x[k].astype(np.float32).tolist(), 1) for i, k in enumerate(r.permutation(len(x)))]
    got = dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas()
    want = plain(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]))
    assert got.n_links.sum() >= 0.999 * sum(v[0] for v in want.values())
    assert dict(zip(got.vec_id, got.component_id)) == {k: v[1] for k, v in want.items()}


def test_dedup_edge_rows(spark):
    one, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(1, one, 5), (2, one, 5), (3, one, None), (4, None, 5), (5, [0.0, 0.0, 0.0], 5), (6, [1.0, None, 3.0], 5), (7, [nan, 1.0, 1.0], 5), (8, [1.0, 2.0], 5),
            (9, [2.0, 4.0, 6.0], 5), (10, one, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 10))
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    got = ann.op7_ann(spark, d).toPandas()
    t = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(t.embedding.values).astype(float)
    n = np.sqrt((x * x).sum(1))
    hit = total = 0
    for q in np.flatnonzero(t.vec_id.values % 50 == 0):
        s = x @ x[q] / (n * n[q])
        s[q] = -9
        true = np.lexsort((t.vec_id.values, -s))[:5]
        g = got[got.query_id == t.vec_id[q]].sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and (np.diff(g.score) <= 0).all()
        assert np.allclose(g.score, [s[np.flatnonzero(t.vec_id == i)[0]] for i in g.vec_id], atol=1e-12)
        hit += len(set(t.vec_id[true]) & set(g.vec_id))
        total += 5
    print("recall", hit / total)
    assert hit >= 0.9 * total


def test_search_edges_and_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0) for i in range(12)] + [(50, [1.0, 0.0, 0.0, 0.0], 0), (51, None, 0), (52, [0.0] * 4, 0), (53, [1.0, None, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ann.search(df, df.filter("vec_id in (0, 50, 51)"), reach=1.0).collect()
    by = {q: [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50, 51)}
    assert by[0] == list(zip(range(1, 6), range(1, 6))) and by[50] == list(zip(range(1, 6), range(5))) and by[51] == []
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    shorter = spark.createDataFrame([(90, [1.0, 2.0], 0), (91, [1.0, 2.0, 3.0, 4.5], 0)], SCHEMA)  # queries mostly of another length
    assert {r.query_id for r in ann.search(df, shorter.union(shorter.limit(1)), reach=1.0).collect()} == {91}
    few = ann.search(df.filter("vec_id in (0, 50)"), df.filter("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id) for r in few] == [(1, 50)]


def test_walk_visits_by_summed_distance():
    r = np.random.default_rng(0)
    d1, d2, count = r.random(7), r.random(9), r.integers(0, 4, 63)
    cells = ann.walk(d1, d2, count, count.sum())
    sums = [d1[c // 9] + d2[c % 9] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(count).tolist()
