"""Source divergence audit by count-level bitmaps.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms that
occur in ``min_docs`` of its documents. A group (one source of one language) gives a kept term with c
occurrences the smoothed share p = 1 + floor(SCALE * (c + 1) / (N + V)), N its occurrences of kept terms,
V the number of kept terms. Two groups diverge by the sum over kept terms of floor((p - q)^2 / q).

A share depends on a term's count alone, so a pair of groups needs only joint cells: how many terms have
count a here and count b there. Terms get positions inside blocks, and each group keeps, per block and
count, the bitset of the positions with that count (the bitset of count 0 is the complement). AND and
popcount of two bitsets give a joint cell, times f(a, b) its part of the sum, and a block adds only one
number per pair. Blocks hold terms of like frequency: rare terms have few counts and fill long bitsets,
frequent ones have many counts and share one word of 64.

Scale: documents are counted inside their task and leave it as (group, term) sums, so a hot source is no
hot key; blocks are bounded whatever a language holds; pairs of groups are worked on in tiles of TILE x TILE
sources, whose sums are all a task keeps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import Stages

SCALE = 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: sources per tile, term counts a task holds before it hands them on, positions of a block of rare terms
TILE, HELD, BLOCK = 256, 600_000, 8192
#: ASCII letters to lower case, every other ASCII byte to a space; bytes of non-ASCII characters stay
FOLD = bytes(b | 32 if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term in each group, summed within a task only;
    null columns read as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (g, s), (n, d) in held.items():
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(g), len(n)), pa.repeat(pa.scalar(s), len(n)), pa.array(list(n), pa.binary()),
                         pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "d"])

        size = 0
        for b in batches:
            for g, s, t in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"]):
                n, d = held.setdefault((g, s), (Counter(), Counter()))
                words = t.as_py().translate(FOLD).split()
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    d = docs.select(*_group(lang, source), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return d.mapInArrow(run, "lang string, source string, term binary, n long, d long")


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")]


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); in decimals where a product would overflow."""
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))
    return F.expr("1L") + F.when(n < (1 << 63) // SCALE - 1, F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total + terms)).otherwise(wide)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _frames(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches as one frame per key."""
    held: list[pd.DataFrame] = []
    for b in batches:
        k = b[keys]
        starts = np.flatnonzero((k != k.shift()).any(axis=1))
        for lo, hi in zip(starts, [*starts[1:], len(b)]):
            part = b.iloc[lo:hi]
            if held and tuple(held[0][keys].iloc[0]) != tuple(part[keys].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _levels(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, share, bitset) of every count level of a block, count 0 included, ordered by group."""
    z = f[f["word"] < 0].sort_values("gid")
    gid, size = z["gid"].to_numpy(), int(z["bits"].iloc[0])
    per = dict(zip(gid.tolist(), zip(z["total"].tolist(), z["terms"].tolist())))
    width = -(-size // 64)
    full = np.zeros(width * 64, np.uint8)
    full[:size] = 1
    full = np.packbits(full, bitorder="little").view("<u8")
    r = f[f["word"] >= 0]
    pairs, at = np.unique(np.stack([r["gid"].to_numpy(np.int64), r["n"].to_numpy(np.int64)]), axis=1, return_inverse=True)
    bits = np.zeros((pairs.shape[1], width), "<u8")
    bits[at.ravel(), r["word"].to_numpy(np.int64)] = r["bits"].to_numpy(np.int64).view("<u8")
    some = np.zeros((len(gid), width), "<u8")
    np.bitwise_or.at(some, np.searchsorted(gid, pairs[0]), bits)
    g = np.concatenate([gid, pairs[0]])
    n = np.concatenate([np.zeros(len(gid), np.int64), pairs[1]])
    order = np.lexsort((n, g))
    g, n, bits = g[order], n[order], np.concatenate([full & ~some, bits])[order]
    # Python integers: exact beyond 64 bits; a block has few levels
    share = np.array([1 + SCALE * (c + 1) // sum(per[k]) for k, c in zip(g.tolist(), n.tolist())], np.int64)
    return g, share, bits


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joint cells: popcount of every row of ``a`` AND every row of ``b``."""
    cells = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        cells += np.bitwise_count(a[:, w, None] & b[None, :, w])
    return cells


def pair_sums(batches: Iterator[pd.DataFrame], tile: int = TILE) -> Iterator[pd.DataFrame]:
    """Blocks in, sums per ordered pair of groups out: one row per pair and task."""
    key, acc = None, None

    def out() -> pd.DataFrame:
        lang, ti, tj = key
        rows = [pd.DataFrame({"ga": i + x * tile, "gb": j + y * tile, "value": s[i, j]})
                for s, x, y in ((acc[0], ti, tj), (acc[1], tj, ti)) for i, j in [np.nonzero(s)]]
        return pd.concat(rows).assign(lang=lang)[["lang", "ga", "gb", "value"]]

    for f in _frames(batches, ["lang", "ti", "tj", "band", "block"]):
        now = (f["lang"].iloc[0], int(f["ti"].iloc[0]), int(f["tj"].iloc[0]))
        if now != key:
            if key is not None:
                yield out()
            key, acc = now, np.zeros((2, tile, tile), np.int64)
        _, ti, tj = now
        g, share, bits = _levels(f)
        ids, at = np.unique(g, return_index=True)
        ends = np.append(at[1:], len(g))
        for k, a in enumerate(ids.tolist()):
            if a // tile != ti:
                continue
            m = k + 1 if ti == tj else int(np.searchsorted(ids, tj * tile))
            if m >= len(ids):
                continue
            rows, cols = slice(at[k], ends[k]), slice(at[m], len(g))
            cells = _joint(bits[rows], bits[cols])
            p, q = share[rows, None], share[None, cols]
            square = (p - q) * (p - q)
            there, starts = ids[m:] - tj * tile, at[m:] - at[m]
            acc[0][a - ti * tile, there] += np.add.reduceat((cells * (square // q)).sum(0), starts)
            acc[1][there, a - ti * tile] += np.add.reduceat((cells * (square // p)).sum(0), starts)
    if key is not None:
        yield out()


def bitmaps(st: Stages, kept: DataFrame) -> DataFrame:
    """(lang, band, block, gid, n, word, bits) from (lang, source, gid, term, n, all, first): 64 positions of a
    block per word. Bands are by the bits of a term's total; a block of a higher band is shorter."""
    k = kept.withColumn("band", F.length(F.bin("all")).cast("int"))
    size = F.greatest(F.lit(64), F.expr(f"shiftright({BLOCK}, greatest(0, band - 5))"))
    n = (k.filter("first").groupBy("lang", "band").agg(F.count(F.lit(1)).alias("_n"))
         .select(F.col("lang").alias("_l"), F.col("band").alias("_b"), F.ceil(F.col("_n") / size).cast("long").alias("_blocks")))
    n = st.write("bands", n)  # one row per language and bit length
    k = k.join(broadcast_if_small(n), (F.col("lang") == F.col("_l")) & (F.col("band") == F.col("_b")))
    k = k.withColumn("block", F.pmod(F.xxhash64("term"), F.col("_blocks")))
    pos = F.dense_rank().over(Window.partitionBy("lang", "band", "block").orderBy(F.xxhash64("term"), "term")) - 1
    return (k.withColumn("_pos", pos).groupBy("lang", "band", "block", "gid", "n", F.shiftright("_pos", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, _pos & 63)")).alias("bits"), F.max("_pos").alias("_pos")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` is every other source of the language by divergence
    from it, part ``term`` the ``top`` terms that the source uses more than its language.

    Null texts, languages and sources read as ''; texts without terms and empty texts still make a group; a
    language without kept terms has pairs of value 0; ties are ordered by the item's bytes. Repeated rows are
    documents of their own, other columns are not read, an empty table gives an empty result. Whole texts are
    counted, one document in memory at a time."""
    st = Stages(docs.sparkSession)
    # dealt once by (lang, term): sums by source and totals over sources need no second shuffle
    counts = (term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    one = Window.partitionBy("lang", "term")
    kept = (counts.select("lang", "source", "term", "n", F.sum("d").over(one).alias("_d"), F.sum("n").over(one).alias("all"),
                          (F.row_number().over(one.orderBy("source")) == 1).alias("first"))
            .filter(F.col("_d") >= min_docs).withColumn("term", F.col("term").cast("string")).drop("_d"))
    kept = st.write("kept", kept)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("first"), 1)).alias("terms"))
    groups = (docs.select(*_group(lang, source)).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
              .withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).fillna(0))
    groups = st.write("groups", groups)  # one row per (language, source)

    k = kept.join(broadcast_if_small(groups), ["lang", "source"])
    maps = st.write("bitmaps", bitmaps(st, k))
    # one row per block and group of the language, also for groups with nothing in the block
    blocks = maps.groupBy("lang", "band", "block").agg((F.max("_pos") + 1).alias("bits"))
    empty = (blocks.join(broadcast_if_small(groups.select("lang", "gid", "total", "terms")), "lang")
             .select("lang", "band", "block", "gid", F.lit(0).cast("long").alias("n"), F.lit(-1).alias("word"),
                     F.col("bits").cast("long").alias("bits"), "total", "terms"))
    rows = maps.select("lang", "band", "block", "gid", "n", "word", "bits", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"))
    tiles = groups.groupBy("lang").agg(F.floor(F.max("gid") / tile).cast("int").alias("_tiles"))
    rows = (rows.unionByName(empty).join(broadcast_if_small(tiles), "lang")
            .withColumn("_t", F.floor(F.col("gid") / tile).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), "_tiles")))
            .select("lang", F.least("_t", "_o").alias("ti"), F.greatest("_t", "_o").alias("tj"), "band", "block", "gid", "n", "word", "bits", "total", "terms"))
    by = ["lang", "ti", "tj", "band", "block"]
    found = (rows.repartition(*by).sortWithinPartitions(*by)
             .mapInPandas(lambda x: pair_sums(x, tile), "lang string, ga int, gb int, value long")
             .groupBy("lang", "ga", "gb").agg(F.sum("value").alias("value")))

    a = groups.select("lang", "source", F.col("gid").alias("ga"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("gb"))
    pairs = (a.join(b, "lang").filter("ga != gb").join(found, ["lang", "ga", "gb"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")))
    per_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(per_group))
    terms = (k.select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
                      _share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")).filter("p > q")
             .select("lang", "source", F.lit("term").alias("part"), "item", _distance(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(per_group)).filter(F.col("rank") <= top))
    return pairs.unionByName(terms)


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence of all sources within each language, and the terms that mark a source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.total + l.v) AS p,
             1 + (1000000000 * (k.n + 1)::HUGEINT) // (l.total + l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
