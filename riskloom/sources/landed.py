"""Parsers of landed source files: filings, fundamentals, prices, constituents, factor files.

Files are read with Spark's own JSON, XML, CSV and text readers; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# fixed values: the fundamental tags read
FACT_TAGS = {"Assets": "Assets", "Liabilities": "Liabilities", "Equity": "StockholdersEquity",
             "NetIncome": "NetIncomeLoss", "Shares": "CommonStockSharesOutstanding"}
COVER_SHARES = "EntityCommonStockSharesOutstanding"
TAG_NAMES = ["Equity", "Assets", "Liabilities", "NetIncome", "Shares"]


def stitch_fundamentals(facts: DataFrame, by: list[str]) -> DataFrame:
    """Long facts ``(by, name, filed, end, pos, val)`` -> one row per (by, Equity filing date) with the
    latest value of every tag on or before it. Facts sharing a filing date order by (end, pos)."""
    w = Window.partitionBy(*by).orderBy("filed", "end", "pos").rowsBetween(Window.unboundedPreceding, 0)
    d = facts.withColumns({n: F.last(F.when(F.col("name") == n, F.col("val")), ignorenulls=True).over(w) for n in TAG_NAMES})
    eq = d.groupBy(*by, "filed").agg(F.max((F.col("name") == "Equity").cast("int")).alias("_e"))
    # the last row of a filing date carries every running value
    wl = Window.partitionBy(*by, "filed").orderBy("end", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = d.withColumns({n: F.last(n, ignorenulls=True).over(wl) for n in TAG_NAMES})
    out = run.groupBy(*by, "filed").agg(*[F.first(n).alias(n) for n in TAG_NAMES])
    return out.join(eq.filter("_e = 1").select(*by, "filed"), [*by, "filed"], "left_semi")


# ---- filings -----------------------------------------------------------------------------------
FILING_COLUMNS = ["form", "accessionNumber", "filingDate", "reportDate", "primaryDocument"]
_ARRAYS = "struct<" + ",".join(f"{c}:array<string>" for c in FILING_COLUMNS) + ">"


def filing_index(spark: SparkSession, submissions: str, pages: str | None = None, form: str = "13F-HR", lines: bool = False) -> DataFrame:
    """Filings of ``form`` from submission JSON: the recent block and the paginated blocks (columnar
    arrays), one row per accession number."""
    zipped = F.inline(F.arrays_zip(*[F.col(f"r.{c}").alias(c) for c in FILING_COLUMNS]))
    d = spark.read.schema(f"cik string, filings struct<recent:{_ARRAYS}>").option("multiLine", not lines).json(submissions)
    rows = d.select("cik", F.col("filings.recent").alias("r")).select("cik", zipped)
    if pages is not None:
        p = spark.read.schema("cik string, " + ", ".join(f"{c} array<string>" for c in FILING_COLUMNS)).option("multiLine", not lines).json(pages)
        rows = rows.unionByName(p.select("cik", F.struct(*FILING_COLUMNS).alias("r")).select("cik", zipped))
    return rows.filter(F.col("form") == form).dropDuplicates(["accessionNumber"])


_HOLDING = "nameOfIssuer string, cusip string, value double, shrsOrPrnAmt struct<sshPrnamt:double, sshPrnamtType:string>, putCall string"


def information_table(spark: SparkSession, path: str, documents: bool = True) -> DataFrame:
    """Holding rows of information-table XML: cash equities only, missing amounts read 0. Column
    ``accession`` is the file's name, to join the filing index.

    ``documents``: one filing per file with any namespace prefix, which is stripped before parsing.
    Otherwise large unprefixed files are split by the XML reader itself."""
    acc = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.xml$", 1).alias("accession")
    if documents:
        t = spark.read.text(path, wholetext=True).select(acc, F.regexp_replace("value", r"(</?)[A-Za-z0-9_]+:", "$1").alias("t"))
        blocks = F.regexp_extract_all("t", F.lit(r"(?s)<infoTable[ >].*?</infoTable>"), F.lit(0))
        d = t.select("accession", F.explode(blocks).alias("x")).select("accession", F.from_xml("x", _HOLDING).alias("r")).select("accession", "r.*")
    else:
        d = spark.read.format("xml").option("rowTag", "infoTable").schema(_HOLDING).load(path).select("*", acc)
    z = F.lit(0.0)
    rows = d.select("accession", F.col("nameOfIssuer").alias("issuer"), F.upper(F.trim("cusip")).alias("cusip"),
                    F.coalesce("value", z).alias("value"), F.coalesce("shrsOrPrnAmt.sshPrnamt", z).alias("shares"),
                    F.col("shrsOrPrnAmt.sshPrnamtType").alias("sshType"), "putCall")
    return rows.filter((F.coalesce("putCall", F.lit("")) == "") & (F.coalesce("sshType", F.lit("SH")) == "SH"))


def stitch_entities(holdings: DataFrame) -> DataFrame:
    """Several source entities of one book: on each report date only the preferred one (lowest
    ``pref``) that filed is kept."""
    best = holdings.groupBy("Book", "report_date").agg(F.min("pref").alias("pref"))
    return holdings.join(best, ["Book", "report_date", "pref"], "left_semi")


def upsert_crosswalk(old: DataFrame, new: DataFrame) -> DataFrame:
    """Monotone upsert of (cusip, figi, ticker, name): a resolution once found is never lost to a
    later miss; negatives may resolve later."""
    o = old.select("cusip", *[F.col(c).alias(f"o_{c}") for c in ("figi", "ticker", "name")])
    j = o.join(new, "cusip", "full_outer")
    hit = F.col("figi").isNotNull()
    return j.select("cusip", *[F.when(hit, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in ("figi", "ticker", "name")])


# ---- fundamentals ---------------------------------------------------------------------------------
def company_facts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Company-facts JSON -> long (cik, name, filed, end, pos, val). Shares prefer the cover-page tag;
    only the first unit of a tag is read. ``lines``: JSON lines instead of one document per file."""
    fact = "struct<units:map<string, array<struct<filed:date, end:date, val:double>>>>"
    d = spark.read.schema(f"cik long, facts struct<`us-gaap`:map<string, {fact}>, dei:map<string, {fact}>>").option("multiLine", not lines).json(path)
    g, e = F.col("facts.us-gaap"), F.col("facts.dei")
    parts = []
    for name, tag in FACT_TAGS.items():
        src = F.try_element_at(g, F.lit(tag))
        if name == "Shares":
            src = F.coalesce(F.try_element_at(e, F.lit(COVER_SHARES)), src)
        parts.append(F.struct(F.lit(name).alias("name"), F.get(F.map_values(src["units"]), 0).alias("v")))
    x = d.select("cik", F.explode(F.array(*parts)).alias("k")).select("cik", "k.name", F.posexplode("k.v").alias("pos", "f"))
    return x.select("cik", "name", "f.filed", "f.end", "pos", "f.val").filter("val is not null and filed is not null")


def registrants(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ticker -> CIK map (an object of objects) as rows."""
    d = spark.read.text(path, wholetext=not lines)
    m = F.from_json("value", "map<string, struct<cik_str:long, ticker:string, title:string>>")
    return d.select(F.explode(F.map_values(m)).alias("r")).select(F.lower("r.ticker").alias("ticker"), F.col("r.cik_str").alias("cik"), F.col("r.title").alias("title"))


def domicile(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SIC and country of incorporation per CIK from submission JSON."""
    from riskloom.operators.universe import country

    a = "struct<stateOrCountry:string, stateOrCountryDescription:string>"
    d = spark.read.schema(f"cik string, sic string, sicDescription string, stateOfIncorporation string, stateOfIncorporationDescription string, addresses struct<business:{a}>").option("multiLine", not lines).json(path)
    b = F.col("addresses.business")
    return d.select("cik", "sic", "sicDescription", country(F.col("stateOfIncorporation"), F.col("stateOfIncorporationDescription"),
                                                            b["stateOrCountry"], b["stateOrCountryDescription"]).alias("Country"))


# ---- prices, constituents, factors ------------------------------------------------------------------
def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily price CSV per symbol file (<symbol>.csv): Date, Close, Volume; a body that is no CSV (an
    error page) drops out with its malformed rows, and so do null closes."""
    d = spark.read.schema("Date string, Close string, Volume string").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    # <symbol>.csv, or a file inside a symbol=<symbol> folder
    part = F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1)
    sym = F.coalesce(F.nullif(part, F.lit("")), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    return d.select(sym.alias("symbol"), F.col("Date").try_cast("date").alias("Date"), F.col("Close").try_cast("double").alias("Close"),
                    F.col("Volume").try_cast("double").alias("Volume")).filter("Date is not null and Close is not null")


def price_chart(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The alternate JSON chart shape: epoch seconds, adjusted closes and volumes as aligned arrays."""
    d = spark.read.schema("symbol string, timestamp array<long>, adjclose array<double>, volume array<double>").option("multiLine", not lines).json(path)
    x = d.select("symbol", F.inline(F.arrays_zip("timestamp", "adjclose", "volume")))
    return x.select("symbol", F.to_date(F.timestamp_seconds("timestamp")).alias("Date"), F.col("adjclose").alias("Close"),
                    F.col("volume").alias("Volume")).filter(F.col("Close").isNotNull())


def prefer_prices(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per symbol the first source that has it."""
    return first.unionByName(fallback.join(first.select("symbol").distinct(), "symbol", "left_anti"))


def constituents(spark: SparkSession, path: str) -> DataFrame:
    """Index constituents CSV: column Symbol, else the first one; lower case, '.' -> '-'."""
    d = spark.read.option("header", True).csv(path)
    c = "Symbol" if "Symbol" in d.columns else d.columns[0]
    return d.select(F.lower(F.translate(F.trim(c), ".", "-")).alias("ticker")).filter("ticker <> ''").distinct()


def change_log(df: DataFrame) -> DataFrame:
    """(date, 'A,B,C') rows -> (effective_date, member), canonical tickers."""
    from riskloom.operators.universe import canon_ticker

    return (df.select(F.col("date").cast("date").alias("effective_date"), F.explode(F.split("tickers", ",")).alias("t"))
            .select("effective_date", canon_ticker(F.col("t")).alias("member")).filter("member <> ''"))


def factor_file(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A published daily factor file: preamble skipped, yyyymmdd rows, percent -> decimal."""
    t = spark.read.text(path).filter(F.trim("value").rlike(r"^[0-9]{8}\s*,"))
    c = F.split("value", ",")
    return t.select(F.to_date(F.trim(c[0]), "yyyyMMdd").alias("Date"), *[(F.trim(c[i + 1]).cast("double") / 100).alias(n) for i, n in enumerate(names)])


def published_factors(spark: SparkSession, base: str, momentum: str) -> DataFrame:
    """Three factors and the risk-free rate joined with momentum on common days."""
    b = factor_file(spark, base, ["Market", "Size", "Value", "rf"])
    return b.join(factor_file(spark, momentum, ["Momentum"]), "Date")


def long_factor_file(df: DataFrame, names: list[str]) -> DataFrame:
    """A long (date, name, ret) file pivoted to one column per factor, complete days."""
    return df.groupBy("date").pivot("name", names).agg(F.first("ret")).dropna()
