import pytest

simhash = pytest.importorskip("riskloom.llm.simhash")
mixing = pytest.importorskip("riskloom.llm.mixing")


def test_keep_first_keeps_one_of_each_class(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "alone in this table it is"), (None, "shared text with a key here"),
            (7, "shared text with a key here"), (8, "something else again and again")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == sorted((k or 0, t.lower()) for k, t in [rows[0], rows[2], rows[4], rows[5]])


def test_mixed_documents_takes_null_keys(spark):
    rows = [(None, "q r s t"), (1, "u v w x")]
    df = spark.createDataFrame([(k, t, "a") for k, t in rows], "doc_id long, text string, source string")
    plan = {r.doc_id: r.taken // r.size for r in mixing.schedule(df)[1].collect()}
    got = [r.doc_id for r in mixing.mixed_documents(df).collect()]
    assert plan[None] >= 1 and {k: got.count(k) for k in plan} == plan
