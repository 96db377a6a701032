"""Embedding tables as packed double vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def packed(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str | None = None,
           dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, label, v) with v the vector's doubles as bytes, and the dimension. Vectors that are null,
    zero, hold null or non-finite components, or are not of length ``dim`` (the table's commonest by default) take no part;
    null keys neither."""
    v = F.col(vector)
    ok = (F.col(key).isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
          & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    lab = F.col(label) if label else F.lit(None).cast("int")
    d = df.filter(ok).select(F.col(key).alias("vec_id"), lab.alias("label"), v.cast("array<double>").alias("x"))
    if dim is None:
        top = d.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top["n"] if top else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "v": [np.ascontiguousarray(x, np.float64).tobytes() for x in b["x"]]})

    kinds = d.schema
    schema = f"vec_id {kinds['vec_id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, v binary"
    return d.filter(F.size("x") == dim).mapInPandas(run, schema), dim


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so tiny and huge ones neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray, norm: np.ndarray | None = None) -> np.ndarray:
    """Cosine of each row of a with the row of b; b may be one row, ``norm`` the known
    lengths of a. Always summed in the same order, so
    equal vectors have equal cosines."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        c = (a * b).sum(-1) / ((np.sqrt((a * a).sum(-1)) if norm is None else norm) * np.sqrt((b * b).sum(-1)))
    if not np.isfinite(c).all():  # squares beyond the range of doubles
        c = np.where(np.isfinite(c), c, (unit(np.atleast_2d(a)) * unit(np.atleast_2d(b))).sum(-1))
    return c


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal ``key`` in batches sorted by it, one frame each."""
    held: list[pd.DataFrame] = []
    for b in batches:
        k = b[key].values
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(b)]
        for lo, hi in zip(edges, edges[1:]):
            part = b.iloc[lo:hi]
            if held and held[-1][key].iloc[-1] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
