"""Tables whose own columns bear the operators' working names."""

from pyspark.sql import functions as F

from riskloom.llm import mixing, simhash, url_filter

ROWS = [(1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (None, "x y", "b"), (3, None, None)]


def table(spark, *names):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({n: F.lit(n) for n in names})


def test_keep_first(spark):
    df = table(spark, "_key", "_h", "cls", "th", "fp", "node")
    got = simhash.keep_first(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]
    assert {r["_key"] + r["_h"] for r in got.collect()} == {"_key_h"}


def test_mixed_documents(spark):
    df = table(spark, "_key", "_n", "_i", "taken", "size", "_b")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and got.count() >= 2
    assert {r["_key"] + r["_i"] for r in got.collect()} == {"_key_i"}


def test_judge(spark):
    rules = spark.createDataFrame([("block", "net", "/")], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://A.net/x", ""), (2, None, None)], "page_id long, url string, html string").withColumns(
        {n: F.lit(n) for n in ("_rule", "_node", "_blocked", "row", "rules", "host")})
    got = url_filter.judge(pages, rules).collect()
    assert [r["_rule"] + r["_node"] + r["_blocked"] + r["row"] + r["rules"] for r in got] == ["_rule_node_blockedrowrules"] * 2
    assert {r.page_id: (r.host, r.verdict) for r in got} == {1: ("a.net", "block"), 2: ("", "allow")}
