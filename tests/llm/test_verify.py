import re

import numpy as np
import pytest

pytest.importorskip("xxhash")
from riskloom.llm import simhash, verify  # noqa: E402

N, RADIUS = 5, 10


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(w[i:i + N]) for i in range(max(1, len(w) - N + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(texts):
    """Smallest key of every document's class, from all pairs."""
    keys = sorted(texts)
    sets, fp = {k: shingle_set(texts[k]) for k in keys}, {k: simhash.simhash(texts[k].encode(), N) for k in keys}
    label = {k: k for k in keys}
    for a in keys:
        for b in keys:
            j = jaccard(sets[a], sets[b]) if a < b else 0
            if label[a] != label[b] and (j >= 0.8 or j >= 0.5 and (fp[a] ^ fp[b]).bit_count() <= RADIUS):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def chance_pair():
    """Two words with fingerprints within the radius and nothing else in common."""
    w = np.array([f"word{i}" for i in range(40_000)])
    fp = np.array([simhash.simhash(x.encode(), N) for x in w], np.uint64)
    for at in range(0, len(w), 500):
        i, j = np.nonzero(np.bitwise_count(fp[at:at + 500, None] ^ fp[None, :]) <= RADIUS)
        for a, b in zip(i + at, j):
            if a != b:
                return str(w[a]), str(w[b])


def variants(rng, base, n, changed):
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(len(w), changed, replace=False):
            w[at] = f"x{rng.integers(1 << 40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [verify.CHUNK, 4000])
def test_against_all_pairs(spark, chunk):
    rng = np.random.default_rng(4)
    texts = [*chance_pair(), "", " \n", "one", "one", "One"]
    for k in range(60):  # families around the threshold, many of them further apart than the radius
        base = [f"f{k}w{i}" for i in rng.integers(0, 10_000, 90)]
        texts += [" ".join(base), *variants(rng, base, 2, 1 + k % 6)]
    base = [f"hot{i}" for i in range(120)]
    texts += variants(rng, base, 60, 2) + variants(rng, base, 20, 5)
    order = rng.permutation(len(texts))
    rows = {int(k): texts[i] for k, i in enumerate(order)}
    want = brute(rows)
    sets, fp = {k: shingle_set(t) for k, t in rows.items()}, {k: simhash.simhash(t.encode(), N) for k, t in rows.items()}
    wide = [(a, b) for a in rows for b in rows if a < b and (fp[a] ^ fp[b]).bit_count() > RADIUS and jaccard(sets[a], sets[b]) >= 0.8]
    assert wide  # pairs that the fingerprints alone miss
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    left = simhash.keep_first(df, shingle=N, radius=RADIUS, parts=simhash.sampled_masks(16, 48), chunk=chunk)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
