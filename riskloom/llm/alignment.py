"""Alignment of two tokenizers over a corpus, with an identity map as fast path.

Vocabulary A is a byte-level BPE of ``tokenizers``, B a ``sentencepiece`` model that puts a space in front.
Both read space + text; the byte offsets at which a token of A and a token of B end together cut the tokens
into groups, and these two last tokens are the group's link. How often an id pair is linked in the whole
corpus says how good the pair is; a link is best if no other A id has more links with its B id.

Most groups are one token against the same bytes. ``same`` maps an A id to the B id of its bytes, computed
once from the two files, so such a link is its A id alone: tasks count these in one vector of vocabulary
length, and their counts come back as another one. Only links of irregular groups are pairs that a
shuffle counts; pairs with many links come back in an array of at most ``HOT`` entries, the others by a join, so no
pair that is joined holds more than a small share of the links.

Neither vocabulary joins bytes across a space after a visible character (B is checked for it), so texts are cut there
and pieces that recur are looked up; the others of a batch are aligned together, as vectors of their tokens' ends. Pieces
whose bytes do not come back send the text whole to both.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import Stages
from riskloom.llm.packing import PATTERN, byte_alphabet

#: pieces in each of the two tables a worker remembers, pairs that return in an array, characters from which a piece is long
#: and those up to which it is remembered, characters aligned together
CACHE, HOT, LONG, SHORT, TOGETHER = 200_000, 1 << 18, 1000, 64, 1 << 18
CUT = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"\s ")
Aligned = tuple[int, int, int, bytes, bytes, bytes]
Piece = tuple[int, bytes, bytes, bytes]


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and ``same``: A id to the B id of the same bytes, or -1."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        byte_of, vocab = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = t.encode() if t in special else bytes(byte_of[c] for c in t)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        usable = [i for i in range(len(self.b_bytes)) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))]
        of = {self.b_bytes[i]: i for i in sorted(usable, key=self.b.is_byte, reverse=True)}  # whole pieces before single bytes
        self.same = np.array([of.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.cuts = (model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                     and not spec.get("normalizer") and self._keeps_spaces(b_path)
                     and not any(re.search(rb"[^ ] ", self.b_bytes[i]) for i in usable))
        ranks = {self.a_bytes[i]: i for t, i in vocab.items() if t not in special}
        self.bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.cuts else None
        self.space = [self.b.piece_to_id("▁")]
        self.code = np.dtype("<u2" if len(self.a_bytes) <= 1 << 16 else "<u4")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # an id as text, inside a group, as its last of A and as its last of B
        self.ids = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [b"%d%c" % (i, sign) for sign in b",|;" for i in range(self.ids)]
        self.name_size = np.fromiter(map(len, self.names), np.int64, len(self.names))
        self.known: dict[str, Piece | None] = {}
        self.older: dict[str, Piece | None] = {}

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    @staticmethod
    def _keeps_spaces(path: str) -> bool:
        """Whether B reads texts as they are, behind one space."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as pb
        except ImportError:
            return False
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        return n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and m.trainer_spec.model_type == m.trainer_spec.BPE

    def _align(self, raws: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[Piece | None]:
        """(tokens of A << 32 | tokens of B, groups as text with a `;` behind each, one-to-one links as A ids, other links as
        pairs) of every piece, or None where the bytes of either differ from its own."""
        na, nb, size = (np.fromiter(map(len, x), np.int64, len(raws)) for x in (a, b, raws))
        ia, ib = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, na), (b, nb)))
        to_a, to_b, to = na.cumsum(), nb.cumsum(), size.cumsum()
        ends_a, ends_b = self.a_size[ia].cumsum(), self.b_size[ib].cumsum()
        raw = b"".join(raws)
        if not (na.all() and nb.all() and np.array_equal(ends_a[to_a - 1], to) and np.array_equal(ends_b[to_b - 1], to)
                and b"".join(map(self.a_bytes.__getitem__, chain.from_iterable(a))) == raw
                and b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b))) == raw):
            out: list[Piece | None] = [None] * len(raws)
            back = [k for k, r in enumerate(raws) if b"".join([self.a_bytes[i] for i in a[k]]) == r == b"".join([self.b_bytes[i] for i in b[k]])]
            if back:
                for k, x in zip(back, self._align(*([x[k] for k in back] for x in (raws, a, b)))):
                    out[k] = x
            return out
        # the last tokens of every group are those whose ends both have
        at_a, at_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        last_a, last_b = at_b[ends_a], at_a[ends_b]
        ka, kb = np.flatnonzero(last_a), np.flatnonzero(last_b)
        x, y = ia[ka], ib[kb]
        exact = (np.diff(ka, prepend=-1) == 1) & (np.diff(kb, prepend=-1) == 1) & (self.same[x] == y)
        # a token's place in the text: behind the groups before its own and, in B, behind its group's tokens of A
        place_a = np.arange(len(ia)) + np.concatenate([[0], kb + 1])[last_a.cumsum() - last_a]
        place_b = np.arange(len(ib)) + (ka + 1)[last_b.cumsum() - last_b]
        names = np.empty(len(ia) + len(ib), np.int64)
        names[place_a], names[place_b] = ia + last_a * self.ids, ib + last_b * (2 * self.ids)
        text = b"".join(map(self.names.__getitem__, names.tolist()))
        links, pairs = x[exact].astype(self.code).tobytes(), (x << 32 | y)[~exact].astype("<i8").tobytes()
        # where each piece ends in these three
        groups = np.searchsorted(ka, to_a)
        one = np.concatenate([[0], exact.cumsum()])[groups]
        t = self.name_size[names].cumsum()[to_a + to_b - 1].tolist()
        e, o = (one * self.code.itemsize).tolist(), ((groups - one) * 8).tolist()
        return [(n, text[t0:t1], links[e0:e1], pairs[o0:o1])
                for n, t0, t1, e0, e1, o0, o1 in zip((na << 32 | nb).tolist(), [0, *t], t, [0, *e], e, [0, *o], o)]

    def _joined(self, found: list[Piece]) -> Aligned:
        """(tokens of A, of B, groups, groups as text, one-to-one links as A ids, other links as pairs) of a text's pieces."""
        n, text, exact, other = zip(*found)
        n, exact, other = sum(n), b"".join(exact), b"".join(other)
        return n >> 32, n & 0xFFFFFFFF, len(exact) // self.code.itemsize + len(other) // 8, b"".join(text)[:-1], exact, other

    def whole(self, text: str) -> Aligned | None:
        t = " " + text
        x = self._align([t.encode()], [self.a.encode(t, add_special_tokens=False).ids], [self.b.encode(text)])
        return self._joined(x) if x[0] else None

    def _pieces(self, keys: list[str]) -> Iterator[tuple[str, Piece | None]]:
        """Every key and the alignment of space + key."""
        size = np.fromiter(map(len, keys), np.int64, len(keys)).cumsum()
        cuts = np.flatnonzero(np.diff(size // TOGETHER, prepend=0)).tolist()  # texts of any length: bounded memory
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            part = keys[lo:hi]
            if not part:
                continue
            texts = [" " + k for k in part]
            a = [self.bpe.encode_ordinary(t) if len(t) < LONG else self.a.encode(t, add_special_tokens=False).ids for t in texts]
            b = [x if k else self.space for k, x in zip(part, self.b.encode(part, num_threads=1))]
            yield from zip(part, self._align([t.encode() for t in texts], a, b))

    def _learn(self, need: set[str]) -> None:
        """Puts the alignment of every needed piece into ``known``. When that is full it becomes ``older``, from which pieces
        that recur come back: bounded memory, same results."""
        new = need.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.older, self.known, new = self.known, {}, need
        back = {k: self.older[k] for k in new if k in self.older}
        self.known.update(back)
        self.known.update(self._pieces(list(new.difference(back))))

    def batch(self, texts: list[str]) -> list[Aligned | None]:
        """Every text's alignment; None for empty texts and those whose bytes do not come back."""
        if not self.cuts:
            return [self.whole(t) if t else None for t in texts]
        keys = [[x[1:] for x in CUT.split(" " + t)] if ODD.search(" " + t) else t.split(" ") for t in texts]
        need = set().union(*keys)
        self._learn(need)
        out = []
        for t, ks in zip(texts, keys):
            found = list(map(self.known.__getitem__, ks))
            if not t:
                out.append(None)
            elif None in found:
                out.append(self.whole(t))
            else:
                out.append(self._joined(found))
        for k in need:
            if len(k) > SHORT:
                del self.known[k]
        return out


_VOCABULARIES: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """This worker's pair of tokenizers; later tasks go on with what it knows."""
    if (a_path, b_path) not in _VOCABULARIES:
        _VOCABULARIES[a_path, b_path] = Vocabularies(a_path, b_path)
    return _VOCABULARIES[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", with_groups: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, groups_sha256, with ``with_groups`` the groups
    as text (`a1,a2|b1;a3|b2`), and its links: ``exact`` (A ids of one-to-one groups, as bytes), ``pairs`` (A id << 32 | B
    id of the others, distinct) with ``times``."""
    kind = docs.schema[key].dataType.simpleString()
    none: Aligned = (0, 0, 0, b"", b"", b"")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabularies(a_path, b_path)
        for b in batches:
            for at in range(0, len(b), 128):
                part = b.iloc[at:at + 128]
                rows = [x or none for x in v.batch(part["t"].tolist())]
                links = [np.unique(np.frombuffer(x[5], "<i8"), return_counts=True) for x in rows]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].values, "n_a": [x[0] for x in rows], "n_b": [x[1] for x in rows], "n_groups": [x[2] for x in rows],
                    "groups_sha256": [sha256(x[3]).hexdigest() if x[0] else "" for x in rows],
                    "groups": [x[3].decode() if with_groups else None for x in rows], "exact": [x[4] for x in rows],
                    "pairs": [p for p, _ in links], "times": [n.astype(np.int32) for _, n in links]})

    return (docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            .mapInPandas(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, exact binary, "
                              "pairs array<long>, times array<int>"))


def pair_counts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, exact, best) of every linked id pair in ``rows`` (from :func:`aligned`): its links in the corpus, whether it
    is one of ``same``, whether no pair of its B id has more."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabularies(a_path, b_path)
        total = np.zeros(len(v.same), np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["exact"]), v.code), minlength=len(total))
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"pair": ids << 32 | v.same[ids], "n": total[ids], "exact": True})

    exact = rows.select("exact").mapInPandas(count, "pair long, n long, exact boolean")
    other = (rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
             .select("x.pairs", F.col("x.times").cast("long"), F.lit(False)).toDF("pair", "n", "exact"))
    n = exact.unionByName(other).groupBy("pair").agg(F.sum("n").alias("n"), F.max("exact").alias("exact"))
    # a B id has at most as many pairs as vocabulary A has ids
    top = F.max("n").over(Window.partitionBy(F.expr("pair & 4294967295L")))
    return n.select("pair", "n", "exact", (F.col("n") == top).alias("best"))


def _hot(pairs: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` irregular pairs have that many links."""
    sizes = pairs.filter("NOT exact").groupBy(F.length(F.bin("n")).alias("bits")).count().collect()  # 64 rows at most
    at = {r["bits"]: r["count"] for r in sizes}
    left, bits = most, 64
    while bits and at.get(bits, 0) <= left:
        left -= at.get(bits, 0)
        bits -= 1
    return 1 << bits


def alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", hot: int = HOT,
              with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    Null and empty texts, and texts whose bytes either vocabulary does not give back, have no tokens: zeros and
    an empty checksum. Rows that repeat a key are documents of their own, null keys stay, ties of the highest count are all
    best, an empty table gives an empty result, other columns are not read. Texts of any length are aligned whole."""
    spark = docs.sparkSession
    st = Stages(spark)
    rows = aligned(docs, a_path, b_path, text, key, with_groups).withColumn("row", F.monotonically_increasing_id())
    rows = st.write("aligned", rows)  # fixes ``row``
    pairs = st.write("pairs", pair_counts(rows, a_path, b_path))
    least = _hot(pairs, hot)
    # at most one row per A id, and at most ``hot`` others
    known = pairs.filter(F.col("exact") | (F.col("n") >= least)).toPandas().sort_values("pair")
    exact, often = known[known["exact"]], known[~known["exact"]]
    size = len(vocabularies(a_path, b_path).same)
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    ids = exact["pair"].to_numpy() >> 32
    n[ids], best[ids] = exact["n"], exact["best"]
    vectors = spark.sparkContext.broadcast((n, best, often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64), often["best"].to_numpy(np.int64)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, best, codes, cn, cb = vectors.value
        v = vocabularies(a_path, b_path)
        for b in batches:
            sums, bests, left, times = [], [], [], []
            for e, p, k in zip(b["exact"], b["pairs"], b["times"]):
                e = np.frombuffer(e, v.code)
                p, k = np.asarray(p, np.int64), np.asarray(k, np.int64)
                at = np.minimum(np.searchsorted(codes, p), max(len(codes) - 1, 0))
                hit = codes[at] == p if len(codes) else np.zeros(len(p), bool)
                sums.append(int(n[e].sum() + (cn[at[hit]] * k[hit]).sum()))
                bests.append(int(best[e].sum() + (cb[at[hit]] * k[hit]).sum()))
                left.append(p[~hit])
                times.append(k[~hit])
            yield b.assign(count_sum=sums, n_best=bests, pairs=left, times=times).drop(columns="exact")

    scored = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "exact", "pairs", "times")
    kind = scored.schema["doc_id"].dataType.simpleString()
    scored = st.write("scored", scored.mapInPandas(score, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
                                                          "groups string, pairs array<long>, times array<long>, count_sum long, n_best long"))
    st.drop("aligned")
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    rare = pairs.filter(~F.col("exact") & (F.col("n") < least)).select("pair", "n", F.col("best").cast("long").alias("b"))
    rest = (rest.join(rare, "pair").groupBy("row")
            .agg(F.sum(F.col("n") * F.col("times")).alias("_s"), F.sum(F.col("b") * F.col("times")).alias("_b")))
    zero = F.lit(0)
    out = (scored.join(rest, "row", "left")
           .select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("_b", zero)).alias("n_best"),
                   (F.col("count_sum") + F.coalesce("_s", zero)).alias("count_sum"), "groups_sha256", "groups"))
    return out if with_groups else out.drop("groups")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment of the two public vocabularies."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
