"""The divergence audit against a plain loop over terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, words = lang or "", source or "", WORD.findall((text or "").translate(FOLD))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = [s for g, s in groups if g == lang]

        def shares(names):
            n = {t: sum(count[lang, s][t] for s in names) for t in kept}
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        n, p = shares([source])
        found = []
        for other in mine:
            if other != source:
                q = shares([other])[1]
                found.append((sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other))
        out |= {(lang, source, "pair", i, v, r) for r, (v, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)}
        q = shares(mine)[1]
        found = sorted(((p[t] - q[t]) ** 2 // q[t], t) for t in kept if n[t] and p[t] > q[t])
        found.sort(key=lambda x: (-x[0], x[1].encode()))
        out |= {(lang, source, "term", i, v, r) for r, (v, i) in enumerate(found[:top], 1)}
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("tile", [256, 2])
def test_against_a_plain_loop(spark, tile):
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mé", "я", "tr") for b in ("n", "S", "öu", "", "zz", "漢")] + ["THE", "of"] * 20
    rows = []
    for i in range(160):
        n = rnd.choice([0, 1, 5, 40])
        text = rnd.choice([" ", "\n", "9", "_", "\u007f"]).join(rnd.choice(words) + rnd.choice(["", "s", "-x"]) for _ in range(n))
        rows.append((i, text, rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["a", "a", "a", "b", "c", "d", "é", None])))
    rows += [(900, None, "xx", "a"), (901, "", "xx", "b"), (902, "one time", "yy", "a"), *[(903 + i, "once only 7", "zz", "s") for i in range(3)]]
    rows += rows[:9]
    got = rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile, top=7))
    assert len(got) == len(set(got)) and set(got) == brute(rows, top=7)


def test_frequent_terms_share_words_of_64(spark):
    """Terms of very different counts in one group, and one that holds most of a source."""
    rows = [(i, " ".join(f"t{'abcdefghij'[k]}" for k in range(10) if i % (k + 1) == 0) + " hot" * (i % 7) * 9, "en", f"s{'abc'[i % 3]}") for i in range(300)]
    assert set(rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).count() == 0
    rows = [(i, "x" * 300_000 + " Y y", "en", f"s{i % 2}") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("no") for c in ("term", "n", "gid", "word", "band", "_pos", "value")})
    assert set(rows_of(divergence.audit(df))) == brute(rows)


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**11, 10**12, 7)], "n long, total long, terms long")
    assert df.select(divergence._share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (10**11 + 1) // (10**12 + 7)
