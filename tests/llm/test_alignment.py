"""The alignment against a plain loop over whole texts."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskloom.llm import alignment
from riskloom.llm.packing import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of, docs = byte_alphabet(), []
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        ia = a.encode(raw.decode(), add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        xa = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
        xb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if b"".join(xa) != raw or b"".join(xb) != raw:
            ia = ib = []
        ea, eb = [], []
        for x, e in ((xa, ea), (xb, eb)):
            at = 0
            for t in x:
                at += len(t)
                e.append(at)
        links = [(p, q) for p, end in zip(ia, ea) if end in set(eb) for q in [ib[eb.index(end)]]] if ia else []
        both = sorted(set(ea) & set(eb)) if ia else []
        groups = [",".join(str(i) for i, e in zip(ia, ea) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(ib, eb) if lo < e <= hi)
                  for lo, hi in zip([0, *both], both)]
        docs.append((doc, len(ia), len(ib), groups, links))
    n = Counter(x for d in docs for x in d[4])
    top = Counter()
    for (_, q), k in n.items():
        top[q] = max(top[q], k)
    return sorted(((d, na, nb, len(g), len(k), sum(n[x] == top[x[1]] for x in k), sum(n[x] for x in k), sha256(";".join(g).encode()).hexdigest() if na else "")
                   for d, na, nb, g, k in docs), key=str)


TEXTS = ["The quick brown fox.", "La niña, el año  y ñandú\n\n Straße", " leading", "trailing ", "two  spaces   three", "\ttab\n \n b", "x▁y z", "<|endoftext|> and </s> <unk>",
         "漢字 かな 😀🏳️‍🌈  nbsp", "é é ​", "a\x00b", "   ", " ", "", None, "internationalisation don't we'll 12345 3.14", "\n", "a \n b", "　wide", "\x1c sep \x85"]


@pytest.mark.parametrize("hot", [1 << 18, 8, 0])
def test_against_a_plain_loop(spark, hot):
    rnd = random.Random(3)
    parts = ["un", "ge", "heit", "tion", "ñ", "é", "th", "ß", "aux", "ing", "0", ".", ",", "\n", "  ", "_", "Ω", "😀"]
    texts = TEXTS + [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.choice([3, 30, 200]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "null key"), (None, "null key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = alignment.alignment(df, A, B, hot=hot)
    assert got.columns == COLS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_pieces_and_whole_texts_agree():
    v = alignment.Vocabularies(A, B)
    assert v.cuts
    rnd = random.Random(8)
    signs = ["a", "B", "é", " ", " ", "  ", "\n", "\t", " ", "'s", "9", "_", ".", "漢", " ", "\x1f", "▁"]
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    for t, x in zip(texts, v.batch(texts)):
        y = v.whole(t)
        assert (x is None) == (y is None), t
        assert x is None or (x[:4] == y[:4] and x[4:] == y[4:]), repr(t)


def test_same_bytes():
    v = alignment.Vocabularies(A, B)
    hit = [i for i, j in enumerate(v.same) if j >= 0]
    assert len(hit) > 10_000 and all(v.a_bytes[i] == v.b_bytes[v.same[i]] for i in hit)
    assert v.b.id_to_piece(int(v.same[v.a.token_to_id("a")])) == "a"  # the whole piece, not the byte


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty, A, B).count() == 0
    rows = [(1, "word" * 50_000 + " tail"), (2, "many words " * 20_000), (3, "=" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("no") for c in ("row", "pair", "n_a", "t", "exact")})
    got = {r["doc_id"]: r for r in alignment.alignment(df, A, B, with_groups=True).collect()}
    v = alignment.Vocabularies(A, B)
    for i, t in rows:
        assert got[i]["groups"].encode() == v.whole(t)[3] and got[i]["n_links"] == got[i]["groups"].count(";") + 1


def test_recurring_pieces_stay_known(monkeypatch):
    """Pieces that return are not aligned anew whenever the memory of pieces is full, which stays bounded."""
    monkeypatch.setattr(alignment, "CACHE", 120)
    v = alignment.Vocabularies(A, B)
    seen, pieces = Counter(), v._pieces
    monkeypatch.setattr(v, "_pieces", lambda keys: (seen.update(keys), pieces(keys))[1])
    common = [f"word{i}" for i in range(40)]
    long = "x" * 5000
    for i in range(30):
        text = " ".join([*common, long, *(f"once{i}x{j}" for j in range(30))])
        assert v.batch([text]) == [v.whole(text)]
        assert len(v.known) <= 120 and len(v.older) <= 120 and long not in v.known
    assert all(seen[k] == 1 for k in common)


def test_pieces_aligned_together(monkeypatch):
    """Pieces whose bytes do not come back, empty and very long ones among others, and cuts of any size between them."""
    v = alignment.Vocabularies(A, B)
    keys = ["", "fox", "x▁y", "internationalisation", "▁", "Straße", "a" * 3000, "漢字", "<unk>", "\ttab", "é"]
    for together in (1, 10, 1 << 18):
        monkeypatch.setattr(alignment, "TOGETHER", together)
        got = dict(v._pieces(keys))
        assert list(got) == keys and got["x▁y"] is None is got["▁"]
        for k in keys:
            assert k == "" or (got[k] and v._joined([got[k]])) == v.whole(k)
    assert list(v._pieces([])) == []
