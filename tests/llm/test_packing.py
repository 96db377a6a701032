import zlib
from collections import defaultdict

import numpy as np
import pytest

packing = pytest.importorskip("riskloom.llm.packing")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, ids_of, window=1024):
    """Every id in exactly one piece, right checksums, gapless sequences; returns the padding share."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(pieces) == set(ids_of)
    for k, ps in pieces.items():
        ids, at = np.array(ids_of[k], "<u4"), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    used = padded = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        used += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / max(1, used)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_round_trip(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").toPandas()
    pad = check(packing.op4_packing(spark, d).collect(), dict(zip(texts.doc_id, whole_ids(texts.text))))
    assert pad < 0.001


def test_encoder_equals_whole_text():
    odd = ["", "a  b", " a", "a ", "a\n b", "a \x1c b", "a b c", " ", "l'été n'est pas", "<|endoftext|> x <|endoftext|>", "x  y", "a​ b",
           "12 34 5", "don't stop 'll", "　 x y", "a\x85 b c", "x" * 50_000 + " " + "y z " * 999]
    e = packing.Encoder(PATH)
    odd += ["a<|endoftext|>b", "\r\n\x1f \u3000", *(f"a{chr(c)}b c{chr(c)} {chr(c)}{chr(c)}d  {chr(c)}\n{chr(c)} 9'{chr(c)}s" for c in range(1, 0x3000, 7))]
    want = [np.array(x[:-1], "<u4").tobytes() for x in whole_ids(odd)]
    assert 50256 in whole_ids(["a<|endoftext|>b"])[0]
    assert e.batch(odd) == want


def test_null_keys_are_spread(spark):
    df = spark.createDataFrame([(None, "the same text")] * 300 + [(1, "z")], "doc_id long, text string").repartition(4)
    tok = packing.tokenised(df, PATH)
    assert tok.filter("doc_id IS NULL").select("salt").distinct().count() == 300 and tok.filter("doc_id = 1 AND salt = 0").count() == 1
    rows = packing.pack(df, PATH).collect()
    assert sum(r.doc_id is None for r in rows) >= 300 and sum(r.length for r in rows) == 300 * len(whole_ids(["the same text"])[0]) + len(whole_ids(["z"])[0])


def test_solution_respects_the_histogram():
    r = np.random.default_rng(2)
    h = np.zeros(1025, int)
    np.add.at(h, r.integers(1, 1024, 20_000), 1)
    h[700] += 9000  # one length shared by a third of all
    plan = packing.solve(h)
    assert (plan[:, :3].sum(1) == 1024).all()
    used = np.bincount(np.repeat(plan[:, :3], plan[:, 3], axis=0).ravel(), minlength=1025)[1:]
    assert (used <= h[1:]).all() and used.sum() > 0.5 * h.sum()
    assert len(packing.solve(np.zeros(1025, int))) == 0


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "same words here"), (4, "same words here"), (5, "long text " * 40_000)] + [(i, "tie") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df.withColumnRenamed("doc_id", "start"), PATH, key="start").collect()  # a clashing name
    check(got, dict(zip([r[0] for r in rows], whole_ids([r[1] for r in rows]))))
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.union(df), PATH).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in got)
