"""URL filtering with redirect equivalence.

A rule (action, host, path) fits its host and every subdomain when the url's path starts with the
rule's path; the longest rule wins, and of two equally long ones the allow. Pages are also joined to
their aliases: an edge runs from a page to the target of its canonical link, of its refresh redirect,
and from ``redirects`` if a table of them is given. Connected components of these edges carry block
decisions: a page without a rule of its own is blocked if any url of its component is. An explicit
allow always stands.

Only DataFrame expressions run. Hosts are matched once per distinct host; pages are never shuffled
by host while the matched rules fit the size check of the broadcast.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import Stages, components

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without one."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A url's identity among aliases: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules array) for the hosts that any rule's host fits; one join on host suffixes."""
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), "
                      "i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    r = rules.select(F.col("host").alias("suffix"),
                     F.struct(F.length(F.concat("host", "path")).alias("n"), (F.col("action") == "allow").alias("allow"),
                              F.concat("host", "path").alias("rule"), "path").alias("r"))
    s = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    return s.join(broadcast_if_small(r), "suffix").groupBy("host").agg(F.collect_set("r").alias("rules"))


def with_rule(df: DataFrame, matched: DataFrame) -> DataFrame:
    """Adds ``_rule`` (struct with n, allow, rule, path; null if none fits) to rows with host and path;
    ``matched`` is the written result of :func:`host_rules`, so that its size is known."""
    fit = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    return df.join(broadcast_if_small(matched), "host", "left").withColumn("_rule", F.array_max(fit)).drop("rules")


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) pairs of aliases from canonical links and refresh redirects of the pages. Targets
    without a scheme count if they start with ``/`` (same host); others are ignored."""
    h = F.coalesce(F.col(html), F.lit(""))
    found = pages.select(F.col(url).alias("u"), F.explode(F.array(
        F.regexp_extract(F.regexp_extract(h, CANONICAL, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract(h, REFRESH, 0), TARGET, 1))).alias("t")).filter("t <> ''")
    full = (F.when(F.instr("t", "://") > 0, F.col("t"))
            .when(F.col("t").startswith("//"), F.concat(F.lit("http:"), F.col("t")))
            .when(F.col("t").startswith("/"), F.concat(F.lit("http://"), host_of(F.col("u")), F.col("t"))))
    return found.filter(F.instr("u", "://") > 0).select(F.col("u").alias("a"), full.alias("b")).filter("b is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None,
          url: str = "url", html: str = "html") -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict (block or allow).

    Null or scheme-less urls have an empty host and path, no alias and no rule: allow. Repeated pages
    are judged alike; an empty table gives an empty result; urls and pages of any length are read whole.
    Columns of ``pages`` named host, path, rule or verdict are replaced, all others pass whatever their names."""
    st = Stages(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c in (url, html)]
    # the row is one column, so that no name of its own meets one of these
    base = pages.select(F.struct(*keep).alias("row"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = page_edges(base)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("a"), F.col("b")).filter("instr(a, '://') > 0 and instr(b, '://') > 0"))
    edges = st.write("aliases", edges.select("a", "b", node_of(F.col("a")).alias("na"), node_of(F.col("b")).alias("nb")).distinct())
    comp = st.write("components", components(st, edges, "na", "nb"))
    ends = edges.select(F.col("a").alias("u"), F.col("na").alias("node")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("nb").alias("node"))).distinct()
    ends = ends.select("node", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    hosts = base.select(host_of(F.col("url")).alias("host")).unionByName(ends.select("host"))
    matched = st.write("host_rules", host_rules(hosts, rules))
    ends = with_rule(ends, matched)
    bad = (ends.filter(F.col("_rule").isNotNull() & ~F.col("_rule.allow")).select("node").distinct()
           .join(comp, "node").select("component").distinct())
    blocked = comp.join(bad, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_blocked"))
    judged = with_rule(base.select("row", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                                   node_of(F.col("url")).alias("_node")), matched)
    judged = judged.join(broadcast_if_small(st.write("blocked", blocked)), "_node", "left")
    verdict = (F.when(F.col("_rule").isNotNull(), F.when(F.col("_rule.allow"), "allow").otherwise("block"))
               .when(F.col("_blocked") & (F.instr(F.coalesce("url", F.lit("")), "://") > 0), "block").otherwise("allow"))
    return judged.select(*[F.col("row")[c].alias(c) for c in keep], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


#: the rules of the registered query
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page under the fixed rules."""
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_REST = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"


def _sql_host(u: str) -> str:
    return (f"translate(regexp_extract({_REST.format(u=u)}, '^([^/?#]*)', 1), "
            f"'{string.ascii_uppercase}', '{string.ascii_lowercase}')")


def _sql_tail(u: str, stop: str) -> str:
    return f"regexp_extract({_REST.format(u=u)}, '^[^/?#]*([^{stop}]*)', 1)"


def _quote(s: str) -> str:
    return s.replace("'", "''")


OP9_SQL = f"""
WITH RECURSIVE rules(action, rhost, rpath) AS (VALUES {', '.join(str(r) for r in RULES)}),
p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
raw AS (SELECT u AS a, regexp_extract(regexp_extract(h, '{_quote(CANONICAL)}', 0), '{_quote(HREF)}', 1) AS t FROM p
        UNION ALL SELECT u, regexp_extract(regexp_extract(h, '{_quote(REFRESH)}', 0), '{_quote(TARGET)}', 1) FROM p),
full_e AS (SELECT a, CASE WHEN instr(t, '://') > 0 THEN t WHEN starts_with(t, '//') THEN 'http:' || t
           WHEN starts_with(t, '/') THEN 'http://' || {_sql_host('a')} || t END AS b
           FROM raw WHERE t <> '' AND instr(a, '://') > 0),
e AS (SELECT DISTINCT a, b, {_sql_host('a')} || {_sql_tail('a', '#')} AS na, {_sql_host('b')} || {_sql_tail('b', '#')} AS nb
      FROM full_e WHERE b IS NOT NULL),
und AS (SELECT na AS x, nb AS y FROM e UNION SELECT nb, na FROM e),
ends AS (SELECT na AS node, {_sql_host('a')} AS host, {_sql_tail('a', '?#')} AS path FROM e
         UNION SELECT nb, {_sql_host('b')}, {_sql_tail('b', '?#')} FROM e),
ranked AS (SELECT node, action, row_number() OVER (PARTITION BY node, host, path ORDER BY length(rhost || rpath) DESC, action) AS k
           FROM ends JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
reach(node) AS (SELECT node FROM ranked WHERE k = 1 AND action = 'block'
                UNION SELECT y FROM reach JOIN und ON x = node),
j AS (SELECT page_id, {_sql_host('u')} AS host, {_sql_tail('u', '?#')} AS path, {_sql_host('u')} || {_sql_tail('u', '#')} AS node,
      instr(u, '://') > 0 AS ok FROM p),
hit AS (SELECT j.*, action, rhost || rpath AS rule,
        row_number() OVER (PARTITION BY page_id, node ORDER BY length(rhost || rpath) DESC, action) AS k
        FROM j LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       CASE WHEN action IS NOT NULL THEN action WHEN ok AND node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END AS verdict
FROM hit WHERE k = 1
"""
