"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` bytes each, the whole text). Every passage is encoded
from counts of byte classes and of pairs of them through one learned layer; gated attention
(tanh x sigmoid) weighs the passages, and the weighted passage representation is scored. Weights of
all layers are learned together from labels of documents, on at most ``sample`` labelled documents
of at most ``max_bytes`` bytes, drawn by a hash of the id: that bounds the fit whatever the corpus.
Every document is scored over all its passages, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PASSAGE = 512
SLICE = PASSAGE << 11  # bytes encoded at once
SAMPLE = 3000
MAX_BYTES = 1 << 15
HIDDEN, GATE = 32, 16


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte: white space, digit, upper, lower, lead and continuation bytes, every ASCII
    sign by itself; and its coarse group."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            fine[b], coarse[b] = (6, 6) if b >= 0xC0 else (7, 6)
        elif b == 32:
            fine[b], coarse[b] = 1, 1
        elif c in "\t\n\r\v\f":
            fine[b], coarse[b] = 2, 2
        elif c.isdigit():
            fine[b], coarse[b] = 3, 3
        elif c.isupper():
            fine[b], coarse[b] = 4, 4
        elif c.islower():
            fine[b], coarse[b] = 5, 5
        elif b in signs:
            fine[b], coarse[b] = 8 + signs.index(b), 0 if c in ".,;:'\"-()" else 7
    return fine, coarse


FINE, COARSE = _classes()
N_FINE, N_PAIR = 8 + 32, 64
WIDTH = N_FINE + N_PAIR + 1


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text); an empty text is one blank passage."""
    n = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts])
    first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(int)
    out = np.zeros((int(n.sum()), WIDTH), np.float32)
    held, size, at = [], 0, 0

    def flush() -> None:
        nonlocal held, size, at
        if not held:
            return
        raw = np.frombuffer(b"".join(held), np.uint8)
        lens = np.array([len(h) for h in held])
        k = np.maximum(1, -(-lens // PASSAGE))
        base = np.concatenate(([0], np.cumsum(k)[:-1]))
        begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
        pid = np.repeat(base, lens) + (np.arange(len(raw)) - np.repeat(begin, lens)) // PASSAGE
        total = int(k.sum())
        one = np.bincount(pid * N_FINE + FINE[raw], minlength=total * N_FINE).reshape(total, N_FINE)
        g = COARSE[raw]
        inside = np.flatnonzero(pid[1:] == pid[:-1])  # pairs within a passage
        pair = np.bincount(pid[inside] * N_PAIR + g[inside] * 8 + g[inside + 1], minlength=total * N_PAIR).reshape(total, N_PAIR)
        length = np.maximum(1, one.sum(1))[:, None]
        out[at:at + total, :N_FINE] = np.sqrt(one / length)
        out[at:at + total, N_FINE:-1] = np.sqrt(pair / length)
        out[at:at + total, -1] = np.log1p(length[:, 0])
        at += total
        held, size = [], 0

    for t in texts:
        for lo in range(0, max(1, len(t)), SLICE):
            piece = t[lo:lo + SLICE]
            held.append(piece)
            size += len(piece)
            if size >= SLICE:
                flush()
    flush()
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class GatedAttention:
    """The model: encoder (E), gates (V, U, w) and score (c) over bags of passages."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = {"E": r.normal(0, d**-0.5, (d, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
                  "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        n = np.diff(np.append(first, len(x)))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        bag = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"z": z, "h": h, "v": v, "u": u, "a": a, "bag": bag, "n": n, "score": _sigmoid(bag @ p["c"] + p["b"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        d = (f["score"] - y) / len(y)
        g = {"c": f["bag"].T @ d, "b": d.sum(keepdims=True)}
        up = np.repeat(d[:, None] * p["c"], f["n"], axis=0)  # to the bag of each passage
        da = (up * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["n"]))
        g["w"] = (f["v"] * f["u"]).T @ ds
        dv = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["a"][:, None] * up + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g["E"], g["e"] = f["z"].T @ dh, dh.sum(0)
        for k in ("E", "V", "U", "c"):
            g[k] = g[k] + decay * p[k]
        return g

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> "GatedAttention":
        """Adam over the whole sample."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        q = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            for k, g in self.gradient(x, first, y, decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                q[k] = 0.999 * q[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
        return self


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_bytes: int = MAX_BYTES) -> GatedAttention | None:
    """The model fitted on a bounded sample of labelled documents; None if there is no label to learn from."""
    lab = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = (docs.select("doc_id", text.alias("t")).filter(F.length("t") <= max_bytes).join(F.broadcast(lab), "doc_id")  # at most ``sample`` rows
            .orderBy(F.xxhash64("doc_id"), "t", "quality").limit(sample).collect())
    if not rows:
        return None
    x, first = encode([bytes(r["t"]) for r in rows])
    y = np.array([float(r["quality"]) for r in rows])
    return GatedAttention(x.mean(0), x.std(0) + 1e-3).fit(x, first, y)


def scores(model: GatedAttention, texts: list[bytes]) -> np.ndarray:
    """Scores of the texts, a bounded number of bytes at a time."""
    out, lo = np.zeros(len(texts)), 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 2 * SLICE):
            size += len(texts[hi])
            hi += 1
        x, first = encode(texts[lo:hi])
        out[lo:hi] = model.forward(x, first)["score"]
        lo = hi
    return out


def score(docs: DataFrame, model: GatedAttention | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all of them by default) and ``score`` (0 to 1; 0.5 for all
    without a model). Null texts are empty."""
    keep = [c for c in (keep or docs.columns) if c != "score"]
    if model is None:
        return docs.select(*keep).withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(scores(model, b.tolist()))

    # only texts go to Python and only scores come back; other columns wait in the JVM
    return docs.select(*keep, run(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if the score is at least 0.5). Columns of these names
    are replaced; labels, language, source and id are no inputs. Repeated rows score alike; an empty
    table gives an empty result; without usable labels all score 0.5."""
    s = score(docs, train(docs, labels, **kw))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (score(docs, model, ["doc_id"]).withColumn("held_out", held_out(F.col("doc_id")))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted"))
