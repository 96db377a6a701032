"""Language identification: held-out accuracy, planted mixtures, the best path against a plain loop."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import language

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs, language.learn(docs.filter(~language.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, given):
    docs, model = given
    rows = language.op13_language(spark, DATA).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert len(held) > 250 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.98
    assert sum(r["lang_pred"] == r["lang"] for r in held if r["n"] > 40) / len([r for r in held if r["n"] > 40]) >= 0.99


def test_spans_of_mixed_text(given):
    docs, model = given
    rows = docs.filter(language.held_out(F.col("doc_id")) & F.col("lang").isin("en", "fr") & (F.length("text") > 1500)).orderBy("doc_id").limit(40).toPandas()
    en, fr = (rows[rows["lang"] == g]["text"].iloc[0] for g in ("en", "fr"))
    text = en[:900] + "\n" + fr[:300] + "\n" + en[900:1400]
    got = language._label(model, [text, fr, ""], True)
    assert got["lang_pred"].tolist() == ["en", "fr", "und"] and 0.6 < got["score"][0] < 0.95 and got["score"][1] > 0.95
    spans = [(text[s["start"]:s["end"]], s["lang"]) for s in got["spans"][0]]
    middle = max((s for s in spans if s[1] == "fr"), key=lambda s: len(s[0]))[0]
    assert len(set(fr[:300].split()) & set(middle.split())) > 0.8 * len(set(fr[:300].split()))


def test_batches_and_slices_do_not_matter(given, monkeypatch):
    docs, model = given
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + [None or "", "12 34", "É", "a" * 9000]
    assert [t for run in language._runs(texts * 200) for t in run] == texts * 200
    whole = language._label(model, texts, True)
    alone = [language._label(model, [t], True).iloc[0] for t in texts]
    assert whole["lang_pred"].tolist() == [r["lang_pred"] for r in alone]
    assert whole["spans"].tolist() == [r["spans"] for r in alone]
    monkeypatch.setattr(language, "SLICE", 1)  # slices of 4096 characters
    cut = language._label(model, texts, True)
    assert cut["lang_pred"].tolist() == whole["lang_pred"].tolist() and cut["spans"].tolist()[:60] == whole["spans"].tolist()[:60]


def test_best_path_against_all_paths():
    rnd = np.random.default_rng(4)
    sizes = np.array([0, 1, 5, 3, 6, 0, 2])
    e = rnd.normal(0, 5, (sizes.sum(), 3))
    got, at = language.best_path(e, sizes, 2.5), 0
    for n in sizes:
        part = e[at:at + n]
        best = max((sum(part[i, p] for i, p in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(3), repeat=int(n))))
        mine = got[at:at + n]
        assert abs(best - (part[np.arange(n), mine].sum() - 2.5 * (mine[1:] != mine[:-1]).sum())) < 1e-9
        at += n


def test_scripts_and_edges(spark):
    learn = [("en", "the cat sat on the mat and the dog ran"), ("ru", "кошка сидела на ковре и собака бежала"), ("el", "η γάτα κάθισε στο χαλί"), (None, "zzz"), ("uk", None)] * 5
    model = language.learn(spark.createDataFrame(learn, "lang string, text string"))
    assert model.langs == ["el", "en", "ru"]
    rows = [(1, "собака"), (2, "σκύλος"), (3, "DOG"), (4, "漢字かな"), (5, None), (6, ""), (7, "12 -- ?"), (None, "the"), (3, "DOG"), (8, "x" * 200_000 + " the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("no") for c in ("lang_pred", "score", "_found", "spans")})
    got = language.identify(df, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and [by[i]["lang_pred"] for i in (1, 2, 3, 5, 6, 7, None, 8)] == ["ru", "el", "en", "und", "und", "und", "en", "en"]
    assert by[4]["lang_pred"] == "el" and abs(by[4]["score"] - 1 / 3) < 1e-9  # no language writes it: all alike, the first one
    assert by[1]["score"] == 1 and by[5]["score"] == 0 and by[1]["_found"] == "no" and by[1]["spans"][0]["end"] == 6
    assert language.identify(df.limit(0), model).count() == 0
    assert language.learn(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}


def test_counts_add_up_over_tasks(spark):
    """The model does not depend on how its rows are dealt."""
    rows = [("a" if i % 3 else "b", f"word{chr(97 + i % 26)} other été {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, text string")
    one, many = language.learn(df.coalesce(1)), language.learn(df.repartition(7))
    assert np.array_equal(one.table, many.table) and np.array_equal(one.own, many.own)
