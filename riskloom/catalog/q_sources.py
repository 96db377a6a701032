"""Source queries: Spark lands files derived from the tables, the parsers read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom import frames as fm, schema
from riskloom.catalog.oracle import sql
from riskloom.catalog.q_risk import AS, ASOF, fr
from riskloom.catalog.registry import query, tidy_sql
from riskloom.plans.pivot import pivot
from riskloom.sources import landed, tables


def landing(s, name: str) -> str:
    return f"{fm.shared_folder(s)}/riskloom/{s.sparkContext.applicationId}/landed-{name}-{uuid.uuid4().hex}"


def per_customer_filings(s, d):
    """Columnar filing arrays per customer, half in the recent block, half in a page."""
    o = tables.table(s, d, "orders")
    st = F.struct(F.when(F.col("o_orderstatus") == "F", "13F-HR").otherwise("10-K").alias("form"), F.concat(F.lit("a"), "o_orderkey").alias("accessionNumber"),
                  F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reportDate"), F.lit("x.xml").alias("primaryDocument"))
    return o.select(F.col("o_custkey").cast("string").alias("cik"), (F.col("o_orderkey") % 2 == 0).alias("page"), st.alias("r"))


def _columnar(df):
    g = df.groupBy("cik").agg(F.collect_list("r").alias("r"))
    return g.select("cik", *[F.col(f"r.{c}").alias(c) for c in landed.FILING_COLUMNS])


@query("src03_filing_index", "SELECT CAST(o_custkey AS VARCHAR) AS cik, '13F-HR' AS form, 'a' || o_orderkey AS accessionnumber, strftime(o_orderdate, '%Y-%m-%d') AS filingdate, strftime(o_orderdate, '%Y-%m-%d') AS reportdate, 'x.xml' AS primarydocument FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    x = per_customer_filings(s, d)
    a, b = landing(s, "sub"), landing(s, "page")
    _columnar(x.filter("not page")).select("cik", F.struct(F.struct(*landed.FILING_COLUMNS).alias("recent")).alias("filings")).write.json(a)
    _columnar(x.filter("page")).write.json(b)
    return landed.filing_index(s, a, b, lines=True)


@query("src04_information_table", sql(tidy_sql("SELECT issuer, cusip, sum(value) AS value, sum(shares) AS shares, count(*) AS n FROM (SELECT p_name AS issuer, upper('c' || p_partkey) AS cusip, l_extendedprice AS value, l_quantity AS shares FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND l_linestatus = 'F') GROUP BY ALL", "value shares", 2)), 2)
def _(s, d):
    p = tables.table(s, d, "part").select("p_partkey", "p_name")
    li = tables.table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select(F.col("p_name").alias("nameOfIssuer"), F.concat(F.lit("c"), "p_partkey").alias("cusip"), F.col("l_extendedprice").alias("value"),
                     F.struct(F.col("l_quantity").alias("sshPrnamt"), F.when(F.col("l_linestatus") == "F", "SH").otherwise("PRN").alias("sshPrnamtType")).alias("shrsOrPrnAmt"),
                     F.when(F.col("l_returnflag") == "R", "Put").alias("putCall"))
    path = landing(s, "xml")
    rows.write.format("xml").option("rowTag", "infoTable").option("rootTag", "informationTable").save(path)
    t = landed.information_table(s, path, documents=False)
    return t.groupBy("issuer", "cusip").agg(F.sum("value").alias("value"), F.sum("shares").alias("shares"), F.count(F.lit(1)).alias("n"))


@query("src05_company_facts", sql(tidy_sql("""SELECT CAST(substring(position, 2) AS BIGINT) AS cik, name, filed, val FROM (
    SELECT position, filed, unnest(['Assets', 'Equity', 'NetIncome', 'Liabilities', 'Shares']) AS name, unnest([assets, equity, netincome, liabilities, shares]) AS val FROM funda) WHERE val IS NOT NULL""", "val", 4), "funda"), 4)
def _(s, d):
    f = fr(s, d).fundamentals
    pairs = [("Assets", "us-gaap", "Assets"), ("Liabilities", "us-gaap", "Liabilities"), ("Equity", "us-gaap", "StockholdersEquity"), ("NetIncome", "us-gaap", "NetIncomeLoss"), ("Shares", "dei", landed.COVER_SHARES)]

    def tag(col):
        return F.sort_array(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("filed", F.col("filed").alias("end"), F.col(col).alias("val")))))

    g = f.groupBy(F.substring("Position", 2, 18).cast("long").alias("cik")).agg(*[tag(c).alias(c) for c, _, _ in pairs])

    def units(items):
        return F.struct(*[F.struct(F.struct(F.col(c).alias("USD")).alias("units")).alias(t) for c, _, t in items])

    doc = g.select("cik", F.struct(units([p for p in pairs if p[1] == "us-gaap"]).alias("us-gaap"), units([p for p in pairs if p[1] == "dei"]).alias("dei")).alias("facts"))
    path = landing(s, "facts")
    doc.write.json(path)
    return landed.company_facts(s, path, lines=True).select("cik", "name", "filed", "val")


@query("src06_price_sources", sql(tidy_sql("SELECT position AS symbol, date, close, volume FROM px", "close", 8), "px"), 8)
def _(s, d):
    px = fr(s, d).prices
    n = F.substring("Position", 2, 18).cast("long")
    a, b = landing(s, "csv"), landing(s, "chart")
    first = px.filter(n % 2 == 0).select(F.col("Position").alias("symbol"), "Date", "Close", "Volume")
    first.write.partitionBy("symbol").option("header", True).csv(a)
    ch = px.groupBy(F.col("Position").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("Date").cast("timestamp")).alias("t"), "Close", "Volume"))).alias("x"))
    ch.select("symbol", F.col("x.t").alias("timestamp"), F.col("x.Close").alias("adjclose"), F.col("x.Volume").alias("volume")).write.json(b)
    return landed.prefer_prices(landed.price_csv(s, a + "/*"), landed.price_chart(s, b, lines=True))


@query("src07_constituents", "SELECT DISTINCT lower(translate(trim(p_brand || '.' || p_size), '.', '-')) AS ticker FROM part")
def _(s, d):
    p = tables.table(s, d, "part").select(F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("Symbol"), F.col("p_name").alias("Name"))
    path = landing(s, "const")
    p.write.option("header", True).csv(path)
    return landed.constituents(s, path)


@query("src08_registrants", "SELECT lower('T' || s_suppkey) AS ticker, s_suppkey AS cik, s_name AS title FROM supplier")
def _(s, d):
    sup = tables.table(s, d, "supplier")
    m = F.create_map(F.col("s_suppkey").cast("string"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title")))
    path = landing(s, "reg")
    sup.select(F.to_json(m).alias("value")).write.text(path)
    return landed.registrants(s, path, lines=True)


@query("src09_crosswalk_upsert", """SELECT 'c' || p_partkey AS cusip, CASE WHEN n THEN 'n' || p_partkey WHEN o THEN 'o' || p_partkey END AS figi,
    CASE WHEN n THEN p_brand WHEN o THEN p_type END AS ticker, CASE WHEN n OR o THEN p_name END AS name FROM
    (SELECT *, p_partkey % 5 <> 0 AND p_partkey % 3 = 0 AS n, p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AS o FROM part) WHERE p_partkey % 7 <> 0 OR p_partkey % 5 <> 0""")
def _(s, d):
    p = tables.table(s, d, "part")
    k = F.col("p_partkey")

    def side(seen, found, tag, ticker):
        return p.filter(seen).select(F.concat(F.lit("c"), k).alias("cusip"), F.when(found, F.concat(F.lit(tag), k)).alias("figi"),
                                     F.when(found, F.col(ticker)).alias("ticker"), F.when(found, F.col("p_name")).alias("name"))

    return landed.upsert_crosswalk(side(k % 7 != 0, k % 2 == 0, "o", "p_type"), side(k % 5 != 0, k % 3 == 0, "n", "p_brand"))


@query("src10_change_log", """SELECT CAST(o_orderdate AS DATE) AS effective_date, translate(upper(trim(t)), '. ', '--') AS member, count(*) AS n FROM
    (SELECT o_orderdate, unnest([o_orderstatus || '.' || (o_custkey % 10), o_orderpriority]) AS t FROM orders) GROUP BY ALL""")
def _(s, d):
    o = tables.table(s, d, "orders")
    log = o.select(F.col("o_orderdate").alias("date"), F.concat("o_orderstatus", F.lit("."), (F.col("o_custkey") % 10).cast("string"), F.lit(", "), "o_orderpriority").alias("tickers"))
    return landed.change_log(log).groupBy("effective_date", "member").agg(F.count(F.lit(1)).alias("n"))


@query("src11_published_factors", sql(tidy_sql("SELECT date, market, size, value, rf, mom AS momentum FROM (SELECT date, max(ret) FILTER (WHERE factor = 'Market') AS market, max(ret) FILTER (WHERE factor = 'SMALL') AS size, max(ret) FILTER (WHERE factor = 'LARGE') AS value, max(ret) FILTER (WHERE factor = 'STANDARD') AS rf, max(ret) FILTER (WHERE factor = 'PROMO') AS mom FROM panel GROUP BY date)",
    "market size value rf momentum", 12), "panel"), 12)
def _(s, d):
    from riskloom.operators import scenarios as sc

    p = sc.complete_panel(fr(s, d).factor_returns).groupBy("Date").pivot("Factor", ["Market", "SMALL", "LARGE", "STANDARD", "PROMO"]).agg(F.first("Return"))
    pct = lambda c: F.format_string("%.12f", F.col(c) * 100)
    a, b = landing(s, "f3"), landing(s, "mom")
    p.select(F.concat_ws(",", F.date_format("Date", "yyyyMMdd"), pct("Market"), pct("SMALL"), pct("LARGE"), pct("STANDARD")).alias("value")).write.text(a)
    s.createDataFrame([("Daily factors, preamble",), (",Mkt-RF,SMB,HML,RF",)], "value string").write.mode("append").text(a)
    p.select(F.concat_ws(",", F.date_format("Date", "yyyyMMdd"), pct("PROMO")).alias("value")).write.text(b)
    return landed.published_factors(s, a, b)


@query("src12_domicile", "SELECT CAST(s_suppkey AS VARCHAR) AS cik, CAST(s_nationkey * 100 AS VARCHAR) AS sic, 'x' AS sicdescription, CASE s_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'Canada' WHEN 2 THEN 'NATION_' || s_nationkey ELSE 'US' END AS country FROM supplier")
def _(s, d):
    sup = tables.table(s, d, "supplier")
    k = F.col("s_nationkey") % 4
    doc = sup.select(F.col("s_suppkey").cast("string").alias("cik"), (F.col("s_nationkey") * 100).cast("string").alias("sic"), F.lit("x").alias("sicDescription"),
                     F.when(k == 0, "CA").when(k == 1, "A6").when(k == 2, "K3").otherwise("").alias("stateOfIncorporation"),
                     F.when(k == 1, "Ontario, Canada").when(k == 2, F.concat(F.lit("NATION_"), "s_nationkey")).otherwise("").alias("stateOfIncorporationDescription"),
                     F.struct(F.struct(F.lit("NY").alias("stateOrCountry"), F.lit("").alias("stateOrCountryDescription")).alias("business")).alias("addresses"))
    path = landing(s, "dom")
    doc.write.json(path)
    return landed.domicile(s, path, lines=True)


@query("src01_load_frames", sql("SELECT 'exposures' AS frame, count(*) AS n FROM expo UNION ALL SELECT 'positions', count(*) FROM pos UNION ALL SELECT 'specific_var', count(*) FROM sv UNION ALL SELECT 'securities', count(*) FROM sec UNION ALL SELECT 'factor_meta', count(*) FROM fm UNION ALL SELECT 'factor_returns', count(*) FROM fr", "expo", "pos", "sv", "sec", "fm", "fr"))
def _(s, d):
    f = fr(s, d)
    path = landing(s, "frames")
    fm.save_frames({n: f[n] for n in schema.REQUIRED}, path)
    g = fm.load_frames(s, path)
    out = None
    for n in schema.REQUIRED:
        r = g[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("frame"), "n")
        out = r if out is None else out.unionByName(r)
    return out


@query("src02_write_frames", sql(tidy_sql("SELECT * FROM pos", "weight", 9), "pos"), 9)
def _(s, d):
    path = landing(s, "pos") + "/positions.parquet"
    fm.save_frame(fr(s, d).positions, path, ["Date"], partition_by=["Date"])
    return s.read.parquet(path).select("Date", "Book", "Position", "Weight", "MV", "ADV")


@query("src14_artifacts", sql("SELECT book, count(*) AS n FROM xb GROUP BY book", "xb"))
def _(s, d):
    from riskloom.operators import attribution as at

    path = landing(s, "drift")
    at.book_factor_exposure(fr(s, d)).withColumn("build_id", F.lit(s.sparkContext.applicationId)).write.partitionBy("Book").parquet(path)
    return s.read.parquet(path).groupBy("Book").agg(F.count(F.lit(1)).alias("n"))


@query("src15_pivot_csv", sql(tidy_sql(f"SELECT book, factor, x AS net_exposure FROM xb WHERE date = {AS}", "net_exposure"), "xb"))
def _(s, d):
    path = landing(s, "csvout")
    p = pivot(fr(s, d), ["Book", "Factor"], ["Net exposure"], filters={"Date": [ASOF]})
    p.write.option("header", True).csv(path)
    return s.read.option("header", True).schema("Book string, Factor string, `Net exposure` double").csv(path)
