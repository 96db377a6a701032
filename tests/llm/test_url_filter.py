import pytest

url_filter = pytest.importorskip("riskloom.llm.url_filter")
SCHEMA = "page_id long, url string, html string"


def canon(u):
    return f'<html><head><LINK href="{u}" rel="canonical"></head></html>'


def refresh(u):
    return f"<meta http-equiv='Refresh' content='0; URL={u}'>"


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(url_filter.RULES, "action string, host string, path string")


def judged(df, rules, **kw):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, **kw).collect()}


def test_longest_rule_and_parts(spark, rules):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f", None), (2, "http://example.net/de/", None), (3, "https://example.com/de/1", None), (4, "https://xexample.com/de/1", None),
            (5, "http://x.org/fr/", None), (6, "http://x.org/en/", None), (7, "http://net/", None), (8, "http://x.net", None), (9, "http://x.net?u=http://y.org/", None), (10, "ÀB://Àb.net/É#x", None)]
    got = judged(spark.createDataFrame(rows, SCHEMA), rules)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block") and got[3] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("xexample.com", "/de/1", None, "allow") and got[5] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[6] == ("x.org", "/en/", None, "allow") and got[7] == ("net", "/", "net/", "block")
    assert got[8] == ("x.net", "", None, "allow") and got[9] == ("x.net", "", None, "allow") and got[10] == ("Àb.net", "/É", "net/", "block")


def test_blocks_spread_over_aliases(spark, rules):
    rows = [(1, "http://bad.net/x", None), (2, "http://mirror.com/1", canon("http://bad.net/x")), (3, "http://mirror.com/2", refresh("/1")), (4, "http://hop.com/a", None),
            (5, "http://ok.org/fr/a", canon("http://bad.net/x")), (6, "http://far.com/z", canon("https://outside.net/never-crawled")), (7, "http://plain.com/", canon("http://other.com/")),
            (8, "https://mirror.com/1#part", None)]
    redirects = spark.createDataFrame([("http://hop.com/a", "http://mirror.com/2"), (None, "http://plain.com/"), ("nothing", "http://plain.com/")], "a string, b string")
    got = {k: v[3] for k, v in judged(spark.createDataFrame(rows, SCHEMA), rules, redirects=redirects).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "block"}


def test_edge_rows(spark, rules):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", canon("http://bad.net/")), (4, "http://a.net/", "x" * 500_000), (4, "http://a.net/", "x"), (None, "http://b.org/fr/", None), (5, "://", None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'old' AS rule", "'h' AS host", "1 AS n")
    out = url_filter.judge(df, rules)
    got = out.collect()
    assert len(got) == len(rows) and "n" in out.columns
    by = {r.page_id: (r.host, r.path, r.verdict) for r in got}
    assert by[1] == by[2] == by[3] == by[5] == ("", "", "allow") and by[4] == ("a.net", "/", "block")
    assert url_filter.judge(df.limit(0), rules).count() == 0
    none = {r.verdict for r in url_filter.judge(df, rules.limit(0)).collect()}
    assert none == {"allow"}
