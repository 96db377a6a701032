"""Line dedup by a log-template tree.

A line's place in the tree has a fixed depth: its token count, then its ``depth`` leading tokens. Tokens with
digits count as the wildcard, unless they are more than half of the line's tokens: such a line is data, not a template,
and is compared as it stands. Inside a leaf the variable fields are found from shares: a token is constant at its
position if half of the leaf's documents have it there, or half of the documents of its branch (those with
the same token before it, ``min_branch`` at least); else it becomes the wildcard. Shares do not depend on how
large a leaf is. A line with at least ``similarity`` of its tokens constant takes that template, any other line (and
any of fewer than ``min_tokens`` tokens) is its own template. A template found in ``min_docs`` documents or more
recurs: its lines stay in the document with the smallest key and are dropped from all others. Lines without a
token are kept.

Only DataFrame expressions run. Lines are taken apart once and written with their hashes (leaf and line, 128 bits
together); what travels are hashes, and the tokens of those leaves alone in which two different lines and
``min_docs`` documents meet. Counts are partial sums before any shuffle; documents meet their dropped
positions in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import Stages

DEPTH = 2
SIMILARITY = 0.7
MIN_TOKENS = 5
MIN_DOCS = 3
MIN_BRANCH = 10
WILD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"
#: a token with a digit, found from its first character on, so that long tokens cost one look
DIGITS = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def n_tokens(c: Column) -> Column:
    """Tokens of a line whose tokens are joined by one space."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def normal(line: Column) -> Column:
    """Tokens joined by one space, those with a digit as the wildcard if they are at most half of all."""
    c = F.trim(F.when(line.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(line, SPACE, " ")).otherwise(line))
    wild = F.regexp_replace(c, DIGITS, WILD)
    n_wild = (F.octet_length(wild) - F.octet_length(F.replace(wild, F.lit(WILD), F.lit("")))) / len(WILD)
    return F.when(c.rlike("[0-9]"), F.when(2 * n_wild <= n_tokens(c), wild).otherwise(c)).otherwise(c)


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a token: key, row (hash of the text), pos, norm, n, leaf, line."""
    d = docs.select("key", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    d = d.select("key", "row", "pos", normal(F.col("line")).alias("norm")).filter("norm <> ''")
    d = d.withColumn("n", n_tokens(F.col("norm")))
    return d.withColumn("leaf", F.xxhash64("n", F.substring_index("norm", " ", DEPTH))).withColumn("line", F.xxhash64("norm"))


def _templates(st: Stages, texts: DataFrame, similarity: float, min_docs: int, min_branch: int) -> DataFrame:
    """(leaf, line, template) of the lines that generalise; ``texts`` has id, leaf, line, norm, n, docs, leaf_docs.

    A token at its place in its leaf is one hash, a token after its neighbour another; rare ones (fewer than
    ``min_docs`` documents) are neither constant nor a branch. The leading tokens are constant by the tree."""
    toks = texts.select("id", "docs", "leaf", F.split("norm", " ").alias("t"))
    spot = F.transform(F.slice("t", DEPTH + 1, F.size("t")), lambda x, i: F.struct((2 * i).alias("at"), F.xxhash64(F.col("leaf"), i, x).alias("h")))
    pair = F.transform(F.slice("t", DEPTH + 1, F.size("t")),
                       lambda x, i: F.struct((2 * i + 1).alias("at"), F.xxhash64(F.col("leaf"), i, F.get("t", i + DEPTH - 1), x).alias("h")))
    seen = toks.select("id", "docs", F.explode(F.concat(spot, pair)).alias("x")).select("id", "docs", "x.at", "x.h")
    support = st.write("support", seen.groupBy("h").agg(F.sum("docs").alias("s")).filter(F.col("s") >= min_docs))
    # rows travel as they are; lists are made where a line's rows have met
    held = (seen.select("id", "at", "h").join(broadcast_if_small(support), "h").repartition("id").groupBy("id")
            .agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("s", "h")))).alias("m")))  # of a line's own tokens
    x = texts.join(held, "id")

    def constant(i: Column) -> Column:
        mine, both = F.col("m")[2 * i]["s"], F.col("m")[2 * i + 1]["s"]
        before = F.when(i == 0, F.col("leaf_docs")).otherwise(F.col("m")[2 * i - 2]["s"])
        return F.coalesce(2 * mine >= F.col("leaf_docs"), F.lit(False)) | F.coalesce((before >= min_branch) & (2 * both >= before), F.lit(False))

    places = F.filter(F.sequence(F.lit(0), F.col("n") - DEPTH - 1), constant)
    x = x.withColumn("places", places).filter(F.size("places") + DEPTH >= similarity * F.col("n"))
    spots = F.transform("places", lambda i: F.col("m")[2 * i]["h"])
    return x.select("leaf", "line", F.xxhash64(F.lit("template"), spots).alias("template"))


def dropped(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS,
            min_docs: int = MIN_DOCS, min_branch: int = MIN_BRANCH) -> DataFrame:
    """Per document (key and row, the hash of its text) the array ``pos`` of dropped line positions."""
    st = Stages(docs.sparkSession)
    lines = st.write("lines", _lines(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    per_doc = lines.groupBy("leaf", "line", "key").agg(F.first("n").alias("n"))
    known = st.write("known", per_doc.groupBy("leaf", "line").agg(F.first("n").alias("n"), F.count("key").alias("docs")))

    # leaves in which a template could form, and the tokens of their lines
    leaves = (known.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"), F.sum("docs").alias("leaf_docs"), F.max("n").alias("n"))
              .filter((F.col("k") > 1) & (F.col("leaf_docs") >= min_docs) & (F.col("n") >= max(min_tokens, DEPTH + 1))).select("leaf", "leaf_docs"))
    leaves = st.write("leaves", leaves)
    texts = (lines.select("leaf", "line", "norm").join(broadcast_if_small(leaves), "leaf").dropDuplicates(["leaf", "line"])
             .join(known.select("leaf", "line", "n", "docs"), ["leaf", "line"]).withColumn("id", F.monotonically_increasing_id()))
    texts = st.write("texts", texts)
    general = st.write("templates", _templates(st, texts, similarity, min_docs, min_branch))

    named = known.join(broadcast_if_small(general), ["leaf", "line"], "left").select("leaf", "line", F.coalesce("template", "line").alias("template"), "docs")
    # a template can recur only if its lines' document counts add up to min_docs
    hope = named.groupBy("leaf", "template").agg(F.sum("docs").alias("d")).filter(F.col("d") >= min_docs).select("leaf", "template")
    hope = st.write("hopeful", named.join(hope, ["leaf", "template"]).select("leaf", "line", "template"))
    seen = lines.select("key", "row", "pos", "leaf", "line").join(broadcast_if_small(hope), ["leaf", "line"])
    seen = st.write("seen", seen.select("key", "row", "pos", "leaf", "template"))
    again = (seen.select("leaf", "template", "key").distinct().groupBy("leaf", "template")
             .agg(F.count("key").alias("d"), F.min("key").alias("first")).filter(F.col("d") >= min_docs).select("leaf", "template", "first"))
    again = st.write("recurring", again)
    drops = (seen.join(broadcast_if_small(again), ["leaf", "template"]).filter(~F.col("key").eqNullSafe(F.col("first")))
             .groupBy("key", "row").agg(F.collect_set("pos").alias("pos")))  # a document's own lines
    drops = st.write("drops", drops)
    st.drop("lines", "known", "leaves", "texts", "support", "templates", "hopeful", "seen", "recurring")
    return drops


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **kw) -> DataFrame:
    """All columns of ``docs``, ``text`` without the dropped lines, and n_lines and n_dropped (replacing
    columns of these names).

    A null text without lines to drop stays null and counts as one blank line, as an empty text does.
    Keys should be unique: rows that share one are one document to the counts. Rows with a null key
    are no document to the counts and lose every recurring line. Texts and tokens of any length are read whole, in time
    that grows with their length. Other columns are passed on whatever their names. An empty table gives an empty result."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*keep)
    drops = dropped(docs, text, key, **kw).select(F.col("key").alias("dk"), F.col("row").alias("dr"), "pos")
    # the row is one column, so that no name of its own meets one of these
    d = docs.select(F.struct(*keep).alias("r"), F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    d = d.join(broadcast_if_small(drops), F.col("k").eqNullSafe(F.col("dk")) & (F.col("h") == F.col("dr")), "left")
    left = F.filter(F.split("t", "\n", -1), lambda x, i: ~F.array_contains("pos", i))
    return d.select(*[F.when(F.col("pos").isNull(), F.col("r")[c]).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col("r")[c].alias(c) for c in keep],
                    (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                    F.coalesce(F.size("pos"), F.lit(0)).cast("long").alias("n_dropped"))


def without_recurring_lines(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with its own columns, recurring lines dropped, and without the rows of which every line
    that has a token was dropped."""
    text = kw.get("text", "text")
    d = dedup(docs.drop("n_lines", "n_dropped"), **kw)
    d = d.filter((F.col("n_dropped") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return d.select(*[c for c in docs.columns if c in d.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    d = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    t = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_lines", "n_dropped", F.length(t).cast("long").alias("n_kept_chars"), F.md5(t).alias("kept_md5"))


OP1_SQL = rf"""
WITH l0 AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
l1 AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '{SPACE}', ' ', 'g')) AS plain FROM l0),
l2 AS (SELECT *, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '{WILD}', 'g') AS wild FROM l1 WHERE plain <> ''),
l AS (SELECT doc_id, pos, line, CASE WHEN 2 * (strlen(wild) - strlen(replace(wild, '{WILD}', ''))) / {len(WILD)} <= len(string_split(plain, ' '))
                                THEN wild ELSE plain END AS norm FROM l2),
t AS (SELECT *, string_split(norm, ' ') AS toks FROM l),
f AS (SELECT *, len(toks) AS n, len(toks)::VARCHAR || ' ' || array_to_string(toks[1:{DEPTH}], ' ') AS leaf FROM t),
known AS (SELECT leaf, norm, any_value(n) AS n, any_value(toks) AS toks, count(DISTINCT doc_id) AS docs FROM f GROUP BY leaf, norm),
leaves AS (SELECT leaf, sum(docs) AS all_docs FROM known GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {MIN_DOCS} AND max(n) >= {MIN_TOKENS}),
tok AS (SELECT leaf, norm, docs, all_docs, n, p, toks[p] AS token, toks[p - 1] AS prev
        FROM (SELECT *, generate_subscripts(toks, 1) AS p FROM known JOIN leaves USING (leaf)) WHERE p > {DEPTH}),
spot AS (SELECT leaf, p, token, sum(docs) AS s FROM tok GROUP BY ALL),
pair AS (SELECT leaf, p, prev, token, sum(docs) AS b FROM tok GROUP BY ALL),
fix AS (SELECT tok.*, s >= {MIN_DOCS} AND (2 * s >= all_docs OR (before >= {MIN_BRANCH} AND 2 * b >= before)) AS fixed
        FROM (SELECT tok.*, spot.s, pair.b, CASE WHEN tok.p = {DEPTH} + 1 THEN all_docs ELSE o.s END AS before
              FROM tok JOIN spot USING (leaf, p, token) JOIN pair USING (leaf, p, prev, token)
              LEFT JOIN spot o ON o.leaf = tok.leaf AND o.p = tok.p - 1 AND o.token = tok.prev) tok),
gen AS (SELECT leaf, norm, string_agg(CASE WHEN fixed THEN token ELSE '{WILD}' END, ' ' ORDER BY p) AS template
        FROM fix GROUP BY leaf, norm HAVING count(*) FILTER (WHERE fixed) + {DEPTH} >= {SIMILARITY} * any_value(n)),
named AS (SELECT f.doc_id, f.pos, f.leaf, coalesce('t ' || template, 'l ' || f.norm) AS template FROM f LEFT JOIN gen ON f.leaf = gen.leaf AND f.norm = gen.norm),
again AS (SELECT leaf, template, min(doc_id) AS first FROM named GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
drops AS (SELECT doc_id, pos FROM named JOIN again USING (leaf, template) WHERE doc_id <> first),
kept AS (SELECT l0.doc_id, count(*) AS n_lines, count(drops.pos) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY l0.pos) FILTER (WHERE drops.pos IS NULL), '') AS kept
         FROM l0 LEFT JOIN drops ON l0.doc_id = drops.doc_id AND l0.pos = drops.pos GROUP BY l0.doc_id)
SELECT doc_id, n_lines, n_dropped, length(kept) AS n_kept_chars, md5(kept) AS kept_md5 FROM kept
"""
