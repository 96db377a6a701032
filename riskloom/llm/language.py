"""Language identification: script ranges, per-word scores, Viterbi over spans.

A word is a run of letters of one script (marks go with their letter). Its script narrows the languages to
those that write a fair share of their letters in it. Every remaining language scores the word by hashed character
trigrams, four-grams and the whole word, counted over all learning documents. The best path through a text's
words pays a penalty for each switch of language, so it labels spans of mixed text and single odd words go
with their neighbours. The language with most letters is the text's; its share of the letters is the score.

Counting is one pass whose tasks keep one vector per language; the model is languages x buckets, at most
``CELLS`` numbers, so it alone reaches the driver and the tasks. Texts are worked on in slices of bounded
size, their words' paths step by step for a whole batch of texts at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.quality import held_out

#: bounds of the model, of a slice (numbers) and of texts whose paths are found together (characters), switching penalty and script penalty (nats), the share of a language's
#: letters from which a script is one of its own, weight of the mean of all languages in each one's distribution
CELLS, BUCKETS, SLICE, TOGETHER = 1 << 21, 1 << 16, 1 << 20, 1 << 22
SWITCH, FOREIGN, SHARE, MEAN = 8.0, 40.0, 0.01, 0.05

#: fixed values: Unicode ranges of the scripts
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)], "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)], "Bengali": [(0x980, 0x9FF)], "Gurmukhi": [(0xA00, 0xA7F)], "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)], "Tamil": [(0xB80, 0xBFF)], "Telugu": [(0xC00, 0xC7F)], "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)], "Sinhala": [(0xD80, 0xDFF)], "Thai": [(0xE00, 0xE7F)], "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)], "Myanmar": [(0x1000, 0x109F)], "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)], "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)], "Mongolian": [(0x1800, 0x18AF)], "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(SCRIPTS) + 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: 0 none, 1 letter, 2 mark; lower case; script (0 for any other)."""
    kind, low, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kind[i] = 1
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            kind[i] = 2
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            script[lo:hi + 1] = k
    return kind, low, script


class Words:
    """The words of a slice of texts: hashed features per letter, begin and end of each word."""

    def __init__(self, text: str, buckets: int):
        kind, low, script = _tables()
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        k = kind[x]
        inside = k > 0
        s = np.where(k == 1, script[x], 0)
        prev = np.concatenate(([False], inside[:-1]))
        # a word ends where letters of another script begin; a mark belongs to the letter before it
        before = np.cumsum(k == 1) - (k == 1)  # letters up to here
        last = np.concatenate(([0], s[k == 1]))[before]
        fresh = inside & (~prev | ((k == 1) & (last != s)))
        self.pos = np.flatnonzero(inside)
        self.begin = np.flatnonzero(fresh)
        self.first = np.searchsorted(self.pos, self.begin)  # first letter of each word among the letters
        n = len(self.pos)
        self.size = np.diff(np.append(self.first, n))
        self.end = self.begin + self.size
        is_letter = (k[self.pos] == 1).astype(np.int64)
        self.letters = np.add.reduceat(is_letter, self.first) if n else np.zeros(0, np.int64)
        self.script = s[self.begin] if n else np.zeros(0, np.int64)
        c = low[x[self.pos]].astype(np.uint64)
        start = np.zeros(n, bool)
        start[self.first] = True
        stop = np.append(start[1:], True)[:n]
        one = np.where(start, 0, np.concatenate((c[:1], c[:-1])))
        second = start | np.concatenate(([True], start[:-1]))[:n]
        two = np.where(second, 0, np.concatenate((c[:2], c[:-2]))[:n])
        nxt = np.where(stop, 0, np.append(c[1:], c[:1])[:n])
        mix = np.uint64(0x9E3779B97F4A7C15)
        tri = ((one << np.uint64(42)) ^ (c << np.uint64(21)) ^ nxt) * mix
        four = ((tri ^ (two + np.uint64(1))) * mix) ^ np.uint64(0x51ED27)
        four *= mix
        step = np.arange(n, dtype=np.uint64) - np.repeat(self.first, self.size).astype(np.uint64)
        each = (c + np.uint64(977)) * mix ^ (step * np.uint64(0xC2B2AE3D27D4EB4F))
        each = (each ^ each >> np.uint64(29)) * mix
        whole = np.add.reduceat(each, self.first) * mix if n else np.zeros(0, np.uint64)
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        self.grams = [(tri >> shift).astype(np.int64), (four >> shift).astype(np.int64)]
        self.whole = (whole >> shift).astype(np.int64)


def _pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of at most ``size`` characters, cut after a space or line end where there is one."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        cut = cut if cut > at else at + size
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def _slices(texts: list[str], size: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts joined by line ends to about ``size`` characters, with (text, its offset, the slice's) per piece."""
    held, where, n = [], [], 0
    for i, t in enumerate(texts):
        for at, p in _pieces(t, size):
            if held and n + len(p) > size:
                yield "\n".join(held), where
                held, where, n = [], [], 0
            where.append((i, at, n))
            held.append(p)
            n += len(p) + 1
    if held:
        yield "\n".join(held), where


class Model:
    """Sorted languages, log shares (buckets x languages), and which language writes which script."""

    def __init__(self, langs: list[str], counts: np.ndarray, buckets: int):
        self.langs, self.buckets = langs, buckets
        feature = counts[:, :buckets].astype(float)
        share = feature / np.maximum(1.0, feature.sum(1, keepdims=True))
        mean = share.mean(0, keepdims=True) + 1e-9
        self.table = np.ascontiguousarray(np.log((1 - MEAN) * share + MEAN * mean).T.astype(np.float32))
        script = counts[:, buckets:].astype(float)
        self.own = (script / np.maximum(1.0, script.sum(1, keepdims=True))).T >= SHARE  # scripts x languages

    def known(self, w: Words) -> np.ndarray:
        """Whether any language writes the word's script."""
        return self.own[w.script].any(1)

    def scores(self, w: Words) -> np.ndarray:
        """Words x languages: log shares below the best, foreign scripts far below, none without a candidate."""
        e = self.table[w.grams[0]]
        for g in w.grams[1:]:
            e += self.table[g]
        e = np.add.reduceat(e, w.first, axis=0).astype(float) / len(w.grams) + self.table[w.whole]
        e = np.where(self.own[w.script], e, -np.inf)
        known = self.known(w)
        e[known] = np.maximum(e[known] - e[known].max(1, keepdims=True), -FOREIGN)
        e[~known] = 0.0
        return e


def best_path(e: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word, texts one after the other with ``sizes`` words each: all texts of the batch
    take a step together. A path stays where staying is as good."""
    order = np.argsort(-sizes, kind="stable")
    off = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    came = np.zeros(e.shape, np.int16 if e.shape[1] > 127 else np.int8)
    own = np.arange(e.shape[1])
    v = np.zeros((len(size), e.shape[1]))
    end = np.zeros(len(size), np.int64)
    for t in range(steps):
        k = active[t]
        at = off[:k] + t
        if t:
            u = v[:k]
            top = u.argmax(1)
            move = u[np.arange(k), top] - switch
            stay = u >= move[:, None]
            came[at] = np.where(stay, own, top[:, None])
            v[:k] = np.where(stay, u, move[:, None]) + e[at]
        else:
            v[:k] = e[at]
        done = slice(active[t + 1] if t + 1 < steps else 0, k)
        end[done] = v[done].argmax(1)
    out = np.zeros(len(e), np.int64)
    state = end.copy()
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = off[:k] + t
        out[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return out


def _label(model: Model, texts: list[str], spans: bool) -> pd.DataFrame:
    """lang_pred, score and spans of the texts."""
    size = max(1 << 12, SLICE // max(4, len(model.langs)))
    parts = []
    for text, where in _slices(texts, size):
        w = Words(text, model.buckets)
        if not len(w.first):
            continue
        piece = np.searchsorted([n for _, _, n in where], w.begin, "right") - 1
        doc = np.array([i for i, _, _ in where])[piece]
        shift = np.array([at - n for _, at, n in where])[piece]
        parts.append((doc, w.begin + shift, w.end + shift, w.letters, model.known(w), model.scores(w)))
    if not parts:
        return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "spans": [[] for _ in texts]})
    doc, begin, end, letters, known, e = (np.concatenate(x) for x in zip(*parts))
    sizes = np.bincount(doc, minlength=len(texts))
    path = best_path(e, sizes)
    n = len(model.langs)
    sums = np.bincount(doc * n + path, np.where(known, letters, 0), minlength=len(texts) * n).reshape(-1, n)
    sums += np.bincount(doc, np.where(known, 0, letters), minlength=len(texts))[:, None] / n
    total = np.bincount(doc, letters, minlength=len(texts))
    top = sums.argmax(1)
    out = pd.DataFrame({"lang_pred": np.where(total > 0, np.array(model.langs, object)[top], "und"),
                        "score": np.where(total > 0, sums[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0)})
    found: list[list] = [[] for _ in texts]
    if spans:
        turn = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (path[1:] != path[:-1]))))
        for lo, hi in zip(turn, np.append(turn[1:], len(doc))):
            found[doc[lo]].append({"start": int(begin[lo]), "end": int(end[hi - 1]), "lang": model.langs[path[lo]]})
    out["spans"] = found
    return out


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``TOGETHER`` characters, so that a batch's arrays stay small whatever its texts' length."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > TOGETHER:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model counted over all rows of ``docs`` whose text and language are not null; None without any."""
    d = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    langs = sorted(r["lang"] for r in d.select("lang").distinct().collect())  # language codes
    if not langs:
        return None
    buckets = min(BUCKETS, 1 << max(4, (CELLS // len(langs)).bit_length() - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, texts in b.groupby("lang")["text"]:
                sums = total.setdefault(name, np.zeros(buckets + N_SCRIPTS, np.int64))
                for joined, _ in _slices(texts.tolist(), SLICE // 4):
                    w = Words(joined, buckets)
                    for g in (*w.grams, w.whole):
                        sums[:buckets] += np.bincount(g, minlength=buckets)
                    sums[buckets:] += np.bincount(w.script, w.letters, minlength=N_SCRIPTS).astype(np.int64)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": sums[at]})

    rows = (d.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # at most CELLS rows
    counts = np.zeros((len(langs), buckets + N_SCRIPTS), np.int64)
    counts[np.searchsorted(langs, rows["lang"].to_numpy(object)) if len(rows) else [], rows["bucket"]] = rows["n"]
    return Model(langs, counts, buckets)


def identify(docs: DataFrame, model: Model | None, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ``spans`` (start and end in characters, language); columns of these
    names are replaced.

    Null texts, texts without a letter, and all texts without a model are `und` with score 0 and no spans. Letters of a
    script that no learned language writes count for all languages alike; ties go to the first language by code point.
    Whole texts of any length are labelled (a word of more letters than a slice in parts); repeated rows are labelled
    alike; an empty table gives an empty result."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    kind = "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b]
            if model is None:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "spans": [[] for _ in texts]})
            else:
                yield pd.concat([_label(model, run, spans) for run in _runs(texts)] or [_label(model, [], spans)], ignore_index=True)

    found = "_found"
    while found in keep:
        found += "_"
    out = docs.select(*keep, run(F.col(text)).alias(found))
    return out.select(*keep, f"{found}.lang_pred", f"{found}.score", *([f"{found}.spans"] if spans else []))


def op13_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return (identify(docs.select("doc_id", "text"), model, spans=False)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
