"""Projections, joins, sorts and set operations, and the frame-build pipeline."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.catalog.oracle import sql
from riskloom.catalog.q_risk import AS, ASOF, HF, cells, fr, psql
from riskloom.catalog.q_series import proxy
from riskloom.catalog.registry import query, tidy_sql
from riskloom.functions.quantiles import top_k
from riskloom.functions.sectors import SECTOR_RANGES
from riskloom.operators import attribution as at, exposure as ex, scenarios as sc, universe as un
from riskloom.plans import build
from riskloom.plans.pivot import pivot
from riskloom.sources import landed, tables
from riskloom.sources.tables import STYLES


@query("prj01_slicers", psql("SELECT book, sector, country, x AS net_exposure FROM cx WHERE country IN ('ASIA', 'EUROPE') AND book IN ('BUILDING', 'MACHINERY')", "net_exposure", cells("sector country", date=True), "cx"))
def _(s, d):
    return pivot(fr(s, d), ["Book", "Sector", "Country"], ["Net exposure"], filters={"Date": [ASOF], "Country": ["ASIA", "EUROPE"], "Book": ["BUILDING", "MACHINERY"], "Issuer": []})


@query("prj03_complete_panel", sql(tidy_sql("SELECT date, " + ", ".join(f"max(ret) FILTER (WHERE factor = '{f}') AS {f.lower()}" for f in ["Market", *STYLES]) + " FROM panel GROUP BY date", " ".join(f.lower() for f in ["Market", *STYLES]), 12), "panel"), 12)
def _(s, d):
    return sc.complete_panel(fr(s, d).factor_returns).groupBy("Date").pivot("Factor", ["Market", *STYLES]).agg(F.first("Return"))


@query("prj04_melt", sql(tidy_sql("SELECT position, filed, name, val FROM (UNPIVOT funda ON equity, assets, liabilities, netincome, shares INTO NAME name VALUE val)", "val", 4), "funda"), 4)
def _(s, d):
    c = ["Equity", "Assets", "Liabilities", "NetIncome", "Shares"]
    m = fr(s, d).fundamentals.unpivot(["Position", "filed"], c, "name", "val").filter("val is not null")
    return m.withColumn("name", F.lower("name"))


_RANGES = ", ".join(f"({i}, {a}, {b}, '{n}')" for i, (a, b, n) in enumerate(SECTOR_RANGES))


@query("prj05_sector_ranges", f"""SELECT p_partkey, coalesce((SELECT arg_min(label, i) FROM (VALUES {_RANGES}) r(i, lo, hi, label) WHERE p_partkey * 7 % 9000 BETWEEN lo AND hi), 'Unknown') AS sector FROM part""")
def _(s, d):
    p = tables.table(s, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 9000).cast("string").alias("code"))
    return build.with_sectors(p, "code").drop("code")


@query("prj06_country_rule", """SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'Canada' WHEN 2 THEN 'LAND ' || c_nationkey WHEN 3 THEN 'US' ELSE 'BIZ ' || c_mktsegment END AS country FROM customer""")
def _(s, d):
    c = tables.table(s, d, "customer")
    k = F.col("c_nationkey") % 5
    c = c.select("c_custkey", F.when(k == 0, "TX").when(k == 1, "A1").when(k == 2, "Z4").otherwise(" ").alias("st"),
                 F.when(k == 1, "Quebec, Canada").when(k == 2, F.concat(F.lit("LAND "), "c_nationkey")).alias("ds"),
                 F.when(k == 3, "WY").otherwise("Q9").alias("bs"), F.when(k == 4, F.concat(F.lit("BIZ "), "c_mktsegment")).alias("bd"))
    return c.select("c_custkey", un.country(F.col("st"), F.col("ds"), F.col("bs"), F.col("bd")).alias("country"))


@query("prj17_members", sql("""SELECT 'Sector' AS dim, sector AS member FROM sec GROUP BY ALL UNION ALL SELECT 'Country', country FROM sec GROUP BY ALL UNION ALL SELECT 'Book', book FROM pos GROUP BY ALL UNION ALL
    SELECT 'Factor', factor FROM fr GROUP BY ALL UNION ALL SELECT 'ScenarioSet', scenarioset FROM scn GROUP BY ALL""", "sec", "pos", "fr", "scn"))
def _(s, d):
    f = fr(s, d)
    src = [("Sector", f.securities), ("Country", f.securities), ("Book", f.positions), ("Factor", f.factor_returns), ("ScenarioSet", f.scenarios.filter(~F.col("ScenarioSet").startswith("PIT:")))]
    out = None
    for n, df in src:
        m = df.select(F.lit(n).alias("dim"), F.col(n).alias("member")).distinct()
        out = m if out is None else out.unionByName(m)
    return out


@query("prj18_safe_nulls", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity END AS v FROM lineitem")
def _(s, d):
    li = tables.table(s, d, "lineitem")
    from riskloom.operators.descriptors import clean

    v = F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(F.when(F.col("l_quantity") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf"))))
    return li.select("l_orderkey", "l_linenumber", clean(v).alias("v"))


@query("prj19_epoch_days", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS epoch, CAST(o_orderdate AS DATE) AS back FROM orders")
def _(s, d):
    e = F.unix_date(F.col("o_orderdate").cast("date"))
    return tables.table(s, d, "orders").select("o_orderkey", e.alias("epoch"), F.date_from_unix_date(e).alias("back"))


@query("prj20_book_metadata", sql("SELECT p.book, m.entityname, m.firmtype, m.n_filings FROM (SELECT DISTINCT book FROM pos) p LEFT JOIN mgr m USING (book)", "pos", "mgr"))
def _(s, d):
    f = fr(s, d)
    return f.positions.select("Book").distinct().join(f.managers.select("Book", "EntityName", "FirmType", "n_filings"), "Book", "left")


# ---- joins -----------------------------------------------------------------------------------------
@query("jn01_star_join", sql(tidy_sql("""SELECT e.date, p.book, e.position, e.factor, f.factorgroup, s.sector, s.country, e.loading, p.weight, sqrt(v.sv) AS specific_vol FROM expo e JOIN pos p ON p.date = e.date AND p.position = e.position
    LEFT JOIN sec s ON s.position = e.position LEFT JOIN fm f ON f.factor = e.factor LEFT JOIN sv v ON v.date = e.date AND v.position = e.position""", "loading weight specific_vol"), "expo", "pos", "sec", "fm", "sv"))
def _(s, d):
    f = fr(s, d)
    j = f.exposures.join(f.positions.select("Date", "Book", "Position", "Weight"), ["Date", "Position"])
    j = j.join(f.securities.select("Position", "Sector", "Country"), "Position", "left").join(F.broadcast(f.factor_meta), "Factor", "left")
    return j.join(f.specific_var, ["Date", "Position"], "left").withColumn("specific_vol", F.sqrt("SpecificVar")).drop("SpecificVar")


@query("jn02_fan_out", sql(tidy_sql("SELECT x.date, x.book, s.scenarioset, x.factor, x.x, s.days FROM xb x JOIN (SELECT scenarioset, factor, count(*) AS days FROM scn GROUP BY ALL) s ON s.factor = x.factor", "x"), "xb", "scn"))
def _(s, d):
    f = fr(s, d)
    x = at.book_factor_exposure(f)
    n = f.scenarios.groupBy("ScenarioSet", "Factor").agg(F.count(F.lit(1)).alias("days"))
    return x.join(F.broadcast(n), "Factor").select("Date", "Book", "ScenarioSet", "Factor", "x", "days")


@query("jn03_grain_guard", sql(tidy_sql("SELECT date, book, svar AS specific_variance FROM spec", "specific_variance"), "spec"))
def _(s, d):
    return pivot(fr(s, d), ["Date", "Book"], ["Net exposure", "Specific variance"]).drop("Net exposure")


@query("jn04_filings_asof", sql(tidy_sql("""SELECT c.date, f.book, f.position, f.mv / sum(f.mv) OVER (PARTITION BY f.book, c.date) AS weight FROM
    (SELECT m.date, b.book, max(b.filing_date) AS filing_date FROM (SELECT DISTINCT date FROM shares) m JOIN (SELECT DISTINCT book, filing_date FROM filings) b ON b.filing_date <= m.date GROUP BY ALL) c
    JOIN filings f ON f.book = c.book AND f.filing_date = c.filing_date""", "weight", 9), "filings", "shares"), 9)
def _(s, d):
    f = fr(s, d)
    w = build.filing_weights(f.filings.select("Book", "filing_date", "Position", "MV"))
    until = f.prices.agg(F.last_day(F.max("Date"))).scalar()
    return build.positions_on_calendar(w, until).select("Date", "Book", "Position", "Weight")


@query("ag04_collapse_lots", sql(tidy_sql("SELECT book, filing_date, position, mv, mv / sum(mv) OVER (PARTITION BY book, filing_date) AS weight FROM filings", "weight", 9), "filings"), 9)
def _(s, d):
    return build.filing_weights(fr(s, d).filings.select("Book", "filing_date", "Position", "MV"))


@query("jn07_latest_row", sql(tidy_sql(f"SELECT position, arg_max(sv, date) AS specificvar, max(date) AS date FROM sv WHERE date <= {AS} GROUP BY position", "specificvar", 9), "sv"), 9)
def _(s, d):
    v = fr(s, d).specific_var.filter(F.col("Date") <= F.lit(ASOF))
    return v.groupBy("Position").agg(F.max_by("SpecificVar", F.col("Date")).alias("SpecificVar"), F.max("Date").alias("Date"))


@query("jn10_semi_anti", sql("SELECT i.position, p.position IS NOT NULL AS held FROM (SELECT DISTINCT position FROM idx) i LEFT JOIN (SELECT DISTINCT position FROM pos) p USING (position)", "idx", "pos"))
def _(s, d):
    f = fr(s, d)
    i = f.index.select("Position").distinct()
    h = f.positions.select("Position")
    return i.join(h, "Position", "left_semi").withColumn("held", F.lit(True)).unionByName(i.join(h, "Position", "left_anti").withColumn("held", F.lit(False)))


@query("jn11_entity_stitch", sql(tidy_sql("""SELECT book, report_date, CAST(pref AS BIGINT) AS pref, sum(mv) AS value, count(*) AS n FROM (SELECT b.*, min(pref) OVER (PARTITION BY book, report_date) AS best FROM (SELECT book, report_date, position, mv,
    CASE WHEN report_date >= DATE '1998-06-30' AND CAST(substring(position, 2) AS BIGINT) % 2 = 0 THEN 0 ELSE 1 END AS pref FROM filings) b) WHERE pref = best GROUP BY ALL""", "value", 4), "filings"), 4)
def _(s, d):
    n = F.substring("Position", 2, 18).cast("long")
    h = fr(s, d).filings.withColumn("pref", F.when((F.col("report_date") >= "1998-06-30") & (n % 2 == 0), 0).otherwise(1))
    return landed.stitch_entities(h).groupBy("Book", "report_date", "pref").agg(F.sum("MV").alias("value"), F.count(F.lit(1)).alias("n"))


@query("jn14_parameter_default", sql(tidy_sql("SELECT x.date, x.book, x.factor, CASE x.factor WHEN 'Market' THEN -2.0::DOUBLE WHEN 'LARGE' THEN 1.0 ELSE 0 END AS sigma, x.x FROM xb x", "sigma x"), "xb"))
def _(s, d):
    p = s.createDataFrame([("Market", -2.0), ("LARGE", 1.0)], "Factor string, sigma double")
    j = at.book_factor_exposure(fr(s, d)).join(F.broadcast(p), "Factor", "left")
    return j.withColumn("sigma", F.coalesce("sigma", F.lit(0.0)))


# ---- sorts and sets ----------------------------------------------------------------------------------
@query("srt01_ordered", sql(tidy_sql("SELECT date, book, position, weight, adv FROM pos", "weight adv", 9), "pos"), 9)
def _(s, d):
    p = fr(s, d).positions.select("Date", "Book", "Position", "Weight", "ADV")
    return p.orderBy("Date", F.col("ADV").desc_nulls_last(), F.abs("Weight").desc())


@query("srt03_argmax_label", sql(tidy_sql("SELECT p.date, p.book, arg_max(s.sector, w) AS top_sector, max(w) AS weight FROM (SELECT date, book, sector, sum(weight) AS w FROM pos JOIN sec USING (position) GROUP BY ALL) p JOIN (SELECT DISTINCT sector FROM sec) s USING (sector) GROUP BY ALL", "weight", 9), "pos", "sec"), 9)
def _(s, d):
    f = fr(s, d)
    g = f.positions.join(f.securities.select("Position", "Sector"), "Position").groupBy("Date", "Book", "Sector").agg(F.sum("Weight").alias("w"))
    return g.groupBy("Date", "Book").agg(F.max_by("Sector", F.col("w")).alias("top_sector"), F.max("w").alias("weight"))


@query("srt04_first_row", sql(tidy_sql("SELECT date, position, arg_min(book, book) AS book, arg_min(weight, book) AS weight FROM pos GROUP BY ALL", "weight", 9), "pos"), 9)
def _(s, d):
    p = fr(s, d).positions
    return p.groupBy("Date", "Position").agg(F.min("Book").alias("Book"), F.min_by("Weight", F.col("Book")).alias("Weight"))


@query("srt05_top_factors", sql(tidy_sql("SELECT book, factor, x, rk FROM (SELECT x.book, x.factor, x.x, row_number() OVER (PARTITION BY x.book ORDER BY abs(x.x) DESC, x.factor) AS rk FROM xb x JOIN (SELECT book, max(date) AS md FROM xb GROUP BY book) m ON m.book = x.book AND m.md = x.date) WHERE rk <= 6", "x"), "xb"))
def _(s, d):
    x = at.book_factor_exposure(fr(s, d))
    last = x.groupBy("Book").agg(F.max("Date").alias("Date"))
    return top_k(x.join(F.broadcast(last), ["Book", "Date"], "left_semi"), ["Book"], [F.abs("x").desc(), "Factor"], 6, "rk").select("Book", "Factor", "x", "rk")


@query("set01_union", sql("SELECT position, max(CASE WHEN src = 'seed' THEN 1 ELSE 0 END) = 1 AS is_estimation FROM (SELECT position, 'seed' AS src FROM idx UNION ALL SELECT position, 'held' FROM pos) GROUP BY position", "idx", "pos"))
def _(s, d):
    f = fr(s, d)
    return build.coverage_universe(f.positions, f.index.select("Position").distinct())


@query("set02_intersection", sql("SELECT date, position FROM sv INTERSECT SELECT date, position FROM expo", "sv", "expo"))
def _(s, d):
    f = fr(s, d)
    return f.specific_var.select("Date", "Position").intersect(f.exposures.select("Date", "Position"))


@query("set04_first_mapping", "SELECT name, arg_min(src, pr) AS source FROM (SELECT p_name AS name, 'a' AS src, 1 AS pr FROM part WHERE p_size < 5 UNION ALL SELECT p_name, 'b', 2 FROM part WHERE p_size BETWEEN 3 AND 20 UNION ALL SELECT p_name, 'c', 3 FROM part WHERE p_size > 15) GROUP BY name")
def _(s, d):
    p = tables.table(s, d, "part")
    parts = [("a", 1, F.col("p_size") < 5), ("b", 2, F.col("p_size").between(3, 20)), ("c", 3, F.col("p_size") > 15)]
    u = None
    for src, pr, cond in parts:
        x = p.filter(cond).select(F.col("p_name").alias("name"), F.lit(src).alias("source"), F.lit(pr).alias("pr"))
        u = x if u is None else u.unionByName(x)
    return u.groupBy("name").agg(F.min_by("source", F.col("pr")).alias("source"))


@query("mod37_build_frames")
def _(s, d):
    """The whole pipeline from landed tables to frames; row counts and date spans per frame."""
    f = fr(s, d)
    g = build.build_frames(f.filings.select("Book", "filing_date", "Position", "MV"), f.prices, proxy(f, "MKT"), {"RateBeta": proxy(f, "RATE"), "NdxBeta": proxy(f, "INDEX")},
                           f.fundamentals, f.securities.withColumn("Sector", F.col("Country")), f.universe.filter("is_estimation").select("Position"), min_names=8)
    out = None
    for n in ("exposures", "positions", "factor_returns", "specific_returns", "specific_var"):
        r = g[n].agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first"), F.max("Date").alias("last")).select(F.lit(n).alias("frame"), "n", "first", "last")
        out = r if out is None else out.unionByName(r)
    return out
