"""Packing tokenised documents into fixed windows by non-negative least squares.

A document is its token ids plus one end id. Whole windows are cut off its front; what is left, its
rest, is shorter than a window. Rests are packed by length: shallow combinations (two or three
lengths that fill a window exactly) are enumerated, the repeat counts that best use up the histogram
of rests are a non-negative least-squares problem, and its rounded solution says how many windows of
each combination to make. Rests that no combination takes are packed greedily: laid end to end in
order of length and cut at window borders; the tail is cut at powers of two, which need no padding.

The histogram has at most window - 1 entries whatever the corpus, so it alone reaches the driver. A
rest finds its window from its rank within its length: ranks are bucket counts plus a window inside
one bucket, so that a length that a third of all documents share stays spread.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import Stages

WINDOW = 1024
END = 0

#: fixed value: how byte-level BPE cuts a text before it merges
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 characters are
    themselves, the other bytes follow from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts under a ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    Under a byte-level BPE ``tiktoken`` merges over the ranks of the same file, in time that grows with a text's
    length; a text that holds one of the file's added tokens, and every text under a file of another kind, goes to
    ``tokenizers``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.bpe = None
        if model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            byte_of = byte_alphabet()
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
            self.bpe = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.bpe:
            return self.raw(texts)
        one = self.bpe.encode_ordinary
        return [self.raw([t])[0] if any(x in t for x in self.added) else np.array(one(t), "<u4").tobytes() for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file; later tasks go on with what it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenised(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, doc_tokens, wins (ids of its whole windows, as bytes), rest_ids (bytes), rest, and
    salt, which spreads rows without a key."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, size = encoder(tokenizer), np.array([END], "<u4").tobytes(), 4 * window
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                ids = [x + end for x in enc.batch(part["t"].tolist())]
                full = [len(x) // size for x in ids]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].values, "doc_tokens": [len(x) // 4 for x in ids],
                    "wins": [[x[k * size:(k + 1) * size] for k in range(n)] for x, n in zip(ids, full)],
                    "rest": [len(x) % size // 4 for x in ids], "rest_ids": [x[n * size:] for x, n in zip(ids, full)]})

    return (docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            .mapInPandas(run, f"doc_id {kind}, doc_tokens long, wins array<binary>, rest int, rest_ids binary")
            .withColumn("salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)))


def combinations(lengths: np.ndarray, window: int = WINDOW, near: int = 24) -> np.ndarray:
    """Rows of two or three lengths (0 for none) that fill a window: every pair, and for each length the
    ``near`` most balanced triples, taken from ``lengths``."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = {(0, a, window - a) for a in lengths if 2 * a <= window and have[window - a]}
    for a in lengths:
        left = window - a
        b = np.arange(1, left // 2 + 1)
        b = b[have[b] & have[left - b]]
        for x in (b if len(b) <= near else b[np.linspace(0, len(b) - 1, near).astype(int)]):
            out.add(tuple(sorted((int(a), int(x), int(left - x)))))
    return np.array(sorted(out), int).reshape(-1, 3)


def nnls(combo: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 near the minimum of ||A x - hist||, where A counts the lengths of each combination:
    accelerated projected gradient, each step one gather and one scatter over the combinations."""
    use = combo > 0
    deg = np.bincount(combo[use], minlength=len(hist)).max(initial=1)
    step = 1.0 / (9.0 * deg)  # A'A is bounded by row sum x column sum of A
    x = np.zeros(len(combo))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        fit = np.bincount(combo.ravel(), np.repeat(y, 3), minlength=len(hist))
        miss = (fit - hist) * (np.arange(len(hist)) > 0)
        new = np.maximum(0.0, y - step * miss[combo].sum(1))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def solve(hist: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (length, length, length, count): how many windows of which combination; no length is used
    more often than the histogram has it. Rounded down first, then counts are raised where supply is
    left, largest fraction first."""
    combo = combinations(np.flatnonzero(hist[: window]), window)
    if not len(combo):
        return np.zeros((0, 4), int)
    x = nnls(combo, hist.astype(float))
    left = hist.astype(int).copy()
    left[0] = np.iinfo(int).max // 4
    count = np.zeros(len(combo), int)
    for extra in (False, True):
        for k in np.argsort(-(x if not extra else x - np.floor(x)), kind="stable"):
            need = np.bincount(combo[k], minlength=len(left))
            pos = np.flatnonzero(need)
            room = int((left[pos] // need[pos]).min())
            n = min(room, int(x[k])) if not extra else room
            if n:
                count[k] += n
                left[pos] -= n * need[pos]
    return np.column_stack([combo, count])[count > 0]


def slots(plan: np.ndarray, window: int = WINDOW) -> dict[int, np.ndarray]:
    """For each length its supply intervals as rows (first rank, first sequence, offset), by first rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    seq = 0
    for a, b, c, n in plan.tolist():
        at = 0
        for x in (a, b, c):
            if x:
                out.setdefault(x, []).append((used.get(x, 0), seq, at))
                used[x] = used.get(x, 0) + n
                at += x
        seq += n
    for x in out:  # closing row: from here on no combination takes the length
        out[x].append((used[x], -1, 0))
    return {x: np.array(v) for x, v in out.items()}


def _rank(st: Stages, d: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within ``rest`` in hash order."""
    d = d.withColumn("_h", F.xxhash64("doc_id", "crc", "salt")).withColumn("_b", F.shiftrightunsigned("_h", 54))
    n = d.groupBy("rest", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("rest").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col("rest").alias("_r"), F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("rest", "_b").orderBy("_h", "doc_id", "rest_ids", "salt")
    d = d.join(broadcast_if_small(n), (F.col("rest") == F.col("_r")) & (F.col("_b") == F.col("_k")))
    return d.withColumn("rank", F.col("_off") + F.row_number().over(inside) - 1).drop("_h", "_b", "_r", "_k", "_off")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` its ids (little-endian unsigned 32-bit bytes). ids_crc32 is the checksum of these ids.

    Null and empty texts are the end id alone. Rows that repeat a key are documents of their own; null
    keys are kept. An empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    st = Stages(spark)
    tok = st.write("tokens", tokenised(docs, tokenizer, text, key, window))
    hist = np.zeros(window + 1, int)
    for r in tok.filter("rest > 0").groupBy("rest").count().collect():  # window - 1 rows at most
        hist[r["rest"]] = r["count"]
    plan = solve(hist, window)
    place, taken = slots(plan, window), int(plan[:, 3].sum()) if len(plan) else 0
    rests = (tok.filter("rest > 0")
             .select("doc_id", "doc_tokens", (F.col("doc_tokens") - F.col("rest")).alias("start"), "rest", "rest_ids", "salt",
                     F.crc32("rest_ids").alias("crc")))
    rests = st.write("rests", _rank(st, rests))

    left = {x: int(hist[x]) - (int(place[x][-1, 0]) if x in place else 0) for x in range(1, window)}
    before, at = {}, 0  # where the leftovers of a length begin when all are laid end to end, long ones first
    for x in range(window - 1, 0, -1):
        before[x] = at
        at += left[x] * x
    total = at
    tail = total // window * window  # from here on powers of two
    borders, rem, p = [tail], total - tail, tail
    for k in range(window.bit_length(), -1, -1):
        if rem >> k & 1:
            p += 1 << k
            borders.append(p)

    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, n, start, rest, ids, crc, rank in zip(b["doc_id"], b["doc_tokens"], b["start"], b["rest"], b["rest_ids"], b["crc"], b["rank"]):
                iv = place.get(rest)
                k = int(np.searchsorted(iv[:, 0], rank, "right")) - 1 if iv is not None else -1
                if iv is not None and iv[k, 1] >= 0:
                    rows.append((doc, start, rest, crc, n, int(iv[k, 1] + rank - iv[k, 0]), int(iv[k, 2]), ids if with_ids else None))
                    continue
                lo = before[rest] + (rank - (int(iv[-1, 0]) if iv is not None else 0)) * rest
                at = 0
                while at < rest:
                    pos = lo + at
                    if pos < tail:
                        seq, off = divmod(pos, window)
                        room = window - off
                    else:
                        j = int(np.searchsorted(borders, pos, "right")) - 1
                        seq, off, room = tail // window + j, pos - borders[j], borders[j + 1] - pos
                    m = min(room, rest - at)
                    piece = ids[4 * at:4 * (at + m)]
                    rows.append((doc, start + at, m, zlib.crc32(piece), n, taken + seq, off, piece if with_ids else None))
                    at += m
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    placed = rests.mapInPandas(run, schema)

    # whole windows are sequences of their own, numbered after the packed ones
    full = tok.filter(F.size("wins") > 0).select("doc_id", "doc_tokens", "wins", "salt", F.transform("wins", F.crc32).alias("crcs"))
    base = taken + tail // window + len(borders) - 1
    full = full.withColumn("_b", F.pmod(F.xxhash64("doc_id", "doc_tokens", "crcs", "salt"), F.lit(4096)))
    n = full.groupBy("_b").agg(F.sum(F.size("crcs")).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))  # at most 4096 rows
    inside = Window.partitionBy("_b").orderBy("doc_id", "doc_tokens", "crcs", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = (full.join(F.broadcast(n), F.col("_b") == F.col("_k"))
            .withColumn("_first", F.lit(base) + F.col("_off") + F.sum(F.size("crcs")).over(inside) - F.size("crcs"))
            .select("doc_id", "doc_tokens", "_first", F.posexplode("wins").alias("_i", "ids"))
            .select("doc_id", (F.col("_i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
                    F.crc32("ids").alias("ids_crc32"), "doc_tokens", (F.col("_first") + F.col("_i")).cast("long").alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), "ids"))
    out = placed.unionByName(full)
    return out if with_ids else out.drop("ids")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
