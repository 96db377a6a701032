"""Least squares as distributed normal equations.

Cross-products are summed task by task (numpy on Arrow batches, keys salted over tasks), then one
small row per salt; only a K x K system per key reaches the solver. No group holds the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def cross_products(rows: DataFrame, key: str, x: str, y: str, w: str, id_col: str, salts: int | None = None) -> DataFrame:
    """Per (key, task) partial sums of weighted cross-products: ``a`` (K x K flat), ``b``, scalars.

    ``x`` is an array column whose length is constant per key. Rows are hashed by key and salt, so a
    key has at most ``salts`` partial rows and a hot one is shared by as many tasks (by default all of the
    session's shuffle partitions); a task keeps one running K x K sum per key it meets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or n
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, k int, a array<double>, b array<double>, sw double, swy double, swyy double, n long"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            keys = pdf[key].to_numpy()
            X = pdf[x].to_numpy()
            W, Y = pdf[w].to_numpy(float), pdf[y].to_numpy(float)
            codes, uniq = pd.factorize(keys)
            order = np.argsort(codes, kind="stable")
            for idx in np.split(order, np.cumsum(np.bincount(codes))[:-1]):
                M = np.vstack(X[idx]).astype(float)
                wi, yi = W[idx], Y[idx]
                mw = M * wi[:, None]
                new = [mw.T @ M, mw.T @ yi, wi.sum(), wi @ yi, wi @ (yi * yi), len(idx)]
                d = uniq[codes[idx[0]]]
                old = acc.get(d)
                acc[d] = new if old is None else [p + q for p, q in zip(old, new)]
        if acc:
            yield pd.DataFrame([[d, v[0].shape[0], v[0].ravel(), v[1], v[2], v[3], v[4], v[5]] for d, v in acc.items()],
                               columns=[key, "k", "a", "b", "sw", "swy", "swyy", "n"])

    d = rows.select(key, x, y, w, F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt"))
    return d.repartition(n, key, "_salt").drop("_salt").mapInPandas(part, schema)


def solve_by_key(parts: DataFrame, key: str, fn: Callable[[dict], pd.DataFrame], schema: str,
                 extra: list[str] | None = None) -> DataFrame:
    """Sum the partial systems of a key (at most one row per salt) and hand the total to ``fn``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        tot = {"key": pdf[key].iloc[0], "k": k, "A": np.sum(np.vstack(pdf["a"].to_numpy()), axis=0).reshape(k, k),
               "b": np.sum(np.vstack(pdf["b"].to_numpy()), axis=0), **{c: float(pdf[c].sum()) for c in ("sw", "swy", "swyy")},
               "n": int(pdf["n"].sum())}
        tot |= {c: pdf[c].iloc[0] for c in (extra or [])}
        return fn(tot)

    return parts.groupBy(key).applyInPandas(run, schema)
