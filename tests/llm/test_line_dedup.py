from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

line_dedup = pytest.importorskip("riskloom.llm.line_dedup")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_templates_with_variable_fields(spark):
    names = ["ann", "bob", "cyd", "dan"]
    rows = [(i, f"Visitor counter says {n} was here on day {40 + i}\nOwn prose of document number {n} {n} {n}\n\nPrinted 2024-0{i}-11") for i, n in enumerate(names)]
    got = rows_of(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    # the template line and the date line recur; the first document keeps both; prose stays everywhere
    assert got[0].n_dropped == 0 and got[0].text == rows[0][1]
    for i in (1, 2, 3):
        assert got[i].n_dropped == 2 and got[i].n_lines == 4
        assert got[i].text == f"Own prose of document number {names[i]} {names[i]} {names[i]}\n"


def test_two_documents_are_not_recurring_and_repeats_inside_one_stay(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y\nx y\nx y\nx y")]
    got = rows_of(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(r.n_dropped == 0 for r in got.values())


def test_edge_rows(spark):
    long = "w " * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "same line here", None), (4, "same line here", "y"), (4, "same line here", "y"), (5, "same  line\there", "z"),
            (None, "same line here", "n"), (6, long, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").withColumn("pos", F.lit(1))
    out = line_dedup.dedup(df)
    got = out.collect()
    assert len(got) == len(rows)
    assert [r.n_dropped for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))] == [0, 0, 0, 1, 1, 1, 0, 1]
    assert Counter(r.text for r in got if r.doc_id == 1) == Counter([None])
    assert line_dedup.dedup(df.limit(0)).count() == 0
    kept = line_dedup.without_recurring_lines(df.drop("n_lines"))
    assert kept.columns == df.drop("n_lines").columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 3, 6]


def test_hot_line_in_a_third_of_all_documents(spark):
    rows = [(i, f"unique words of {'abcdefghij'[i % 10]}{i * 7919}x" + ("\nshared boiler plate line" if i % 3 == 0 else "")) for i in range(3000)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").count()
    assert got >= 999


def test_lines_of_numbers_are_data(spark):
    rows = [(i, f"{t}\nId {i} 3 4 5") for i, t in enumerate(["12 34", "56 78", "90 11", "7 8", "12 34", "12 34"])]
    got = rows_of(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_dropped for i in range(6)] == [0, 0, 0, 0, 1, 1]  # only equal lines recur
    assert got[5].text == "Id 5 3 4 5"


@pytest.mark.parametrize("n", [4, 64, 64_000])
def test_a_template_is_one_at_any_size(spark, n):
    k = max(4, int(n ** 0.5 * 2))  # names and places, each in many documents of a large table
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("Visitor book: guest"), F.concat(F.lit("name"), F.translate((F.xxhash64("id", F.lit(1)) % k).cast("string"), "-0123456789", "mabcdefghij")),
        F.lit("came from"), F.concat(F.lit("at"), F.translate((F.xxhash64("id", F.lit(2)) % k).cast("string"), "-0123456789", "mabcdefghij")),
        F.lit("and signed in here")).alias("text"))
    # the same leaf holds another template, a tenth as common
    other = spark.range(n, n + n // 10).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("Visitor book: pages"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("were torn out of the old volume")).alias("text"))
    got = line_dedup.dedup(df.unionByName(other))
    assert got.filter((F.col("n_dropped") == 0) & (F.col("doc_id") < n)).count() == 1


def test_long_tokens_take_one_look(spark):
    text = "x" * 1_000_000 + " has 1 number here\nend"
    rows = [(i, text) for i in range(4)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_dropped for r in got) == [0, 2, 2, 2]


def test_columns_of_any_name(spark):
    names = ["_key", "_text", "_row", "_pos", "_dk", "_dr", "key", "row", "pos", "r", "k", "t", "h", "dk", "dr", "leaf", "line"]
    df = spark.createDataFrame([(i, "same line here\nown " + "abcd"[i]) for i in range(4)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert all(r[c] == c for r in got.collect() for c in names)
    assert line_dedup.without_recurring_lines(df).columns == df.columns
