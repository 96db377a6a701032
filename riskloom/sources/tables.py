"""Model frames derived from the star-schema tables (orders, lineitem, part, ...).

A market segment is a book, a supplier a position, a part type a style factor, a ship day a trade
day. Line items are read in two column-pruned branches: one meets orders (for the book), one meets
part (for the factor); each shuffles the line items once and aggregates on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskloom.frames import Frames, materialized
from riskloom.operators import scenarios
from riskloom.operators.timeseries import month_adv

# fixed values of the given tables: the part types
STYLES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# windows replayed and shocks applied on this calendar
EVENTS = {
    "Evt:1996Q1": ("1996-01-01", "1996-03-31"),
    "Evt:1998H2": ("1998-07-01", "1998-12-31"),
    "Evt:2000Q4": ("2000-10-01", "2000-12-31"),
}
HYPOS = {
    "Hypo:LargeSelloff": {"Market": -2.0, "LARGE": -1.0},
    "Hypo:SmallRally": {"SMALL": 2.0, "ECONOMY": 1.0},
    "Hypo:PromoCrash": {"PROMO": -3.0},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position_id(col: str) -> Column:
    return F.concat(F.lit("P"), F.col(col).cast("string"))


def line_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its day, position and money columns (no join)."""
    li = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    return li.select(
        "l_orderkey", "l_partkey", position_id("l_suppkey").alias("Position"), day.alias("Day"),
        F.last_day(day).alias("Date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("mv"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.round(F.col("l_discount") * 100).cast("long").alias("cents"))


def book_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lots with their Book. Orders meet customers first, so lots are shuffled once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("Book"))
    ob = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "Book")
    lots = line_lots(spark, sf_dir)
    return lots.join(ob, lots.l_orderkey == ob.o_orderkey).drop("o_orderkey")


def factor_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lots with their style factor (part type)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("Factor"))
    lots = line_lots(spark, sf_dir)
    return lots.join(p, lots.l_partkey == p.p_partkey).drop("p_partkey")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean price and volume of a name, dealt by name alone so that windows over its days need no further shuffle."""
    lots = line_lots(spark, sf_dir).select("Position", "Day", "price", "qty")
    return (lots.repartition("Position")
            .groupBy("Position", F.col("Day").alias("Date"))
            .agg(F.round(F.avg(F.col("price") / F.col("qty")), 8).alias("Close"),
                 F.sum("qty").alias("Volume")))


def month_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MV per (Date, Book, Position), dealt by (Date, Position), on which it meets other frames."""
    lots = book_lots(spark, sf_dir).select("Date", "Book", "Position", "mv")
    return (lots.repartition("Date", "Position").groupBy("Date", "Book", "Position")
            .agg(F.round(F.sum("mv"), 4).alias("MV")))


def with_weights(mv: DataFrame, keys: list[str]) -> DataFrame:
    """Weight = MV / total of ``keys``. The total is an aggregate joined back, not a window, so a
    book of any breadth stays spread over tasks; it has one row per month-end and book."""
    tot = mv.groupBy(*keys).agg(F.sum("MV").alias("_tot"))
    return (mv.join(F.broadcast(tot), keys)
            .withColumn("Weight", F.col("MV") / F.col("_tot")).drop("_tot"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_weights(month_values(spark, sf_dir), ["Date", "Book"])
    adv = month_adv(prices(spark, sf_dir))
    return (p.join(adv, ["Date", "Position"], "left")
            .select("Date", "Book", "Position", "Weight", "MV", "ADV"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style loading = cross-sectional z of a name's revenue share per part type; Market = 1."""
    rev = (factor_lots(spark, sf_dir).groupBy("Date", "Position").agg(
        F.sum("mv").alias("_all"),
        *[F.sum(F.when(F.col("Factor") == s, F.col("mv"))).alias(f"_{s}") for s in STYLES]))
    sh = rev.select("Date", "Position", *[
        (F.coalesce(F.col(f"_{s}"), F.lit(0.0)) / F.col("_all")).alias(s) for s in STYLES])
    st = sh.groupBy("Date").agg(
        *[F.avg(s).alias(f"m_{s}") for s in STYLES], *[F.stddev_samp(s).alias(f"s_{s}") for s in STYLES])
    z = sh.join(F.broadcast(st), "Date").select("Date", "Position", F.lit(1.0).alias("Market"), *[
        F.when(F.col(f"s_{s}") > 0, F.try_divide(F.col(s) - F.col(f"m_{s}"), F.col(f"s_{s}"))).alias(s)
        for s in STYLES])
    return (z.unpivot(["Date", "Position"], ["Market", *STYLES], "Factor", "Loading")
            .filter(F.col("Loading").isNotNull()))


def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount over the neutral rate per day; summed in whole cents, so equal means tie exactly."""
    by = (factor_lots(spark, sf_dir).groupBy(F.col("Day").alias("Date"), "Factor")
          .agg(F.sum("cents").alias("s"), F.count("cents").alias("n")))
    mkt = by.groupBy("Date").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    both = by.unionByName(mkt.select("Date", F.lit("Market").alias("Factor"), "s", "n"))
    return both.select("Date", "Factor", (F.col("s").cast("double") / (100.0 * F.col("n")) - 0.05).alias("Return"))


def specific_returns(spark: SparkSession, sf_dir: str, fr: DataFrame) -> DataFrame:
    by = (line_lots(spark, sf_dir).groupBy(F.col("Day").alias("Date"), "Position")
          .agg((F.sum("cents").cast("double") / (100.0 * F.count("cents"))).alias("d")))
    mkt = fr.filter(F.col("Factor") == "Market").select("Date", F.col("Return").alias("m"))
    return by.join(mkt, "Date").select(
        "Date", "Position", (F.col("d") - 0.05 - F.col("m")).alias("SpecificReturn"))


def specific_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (line_lots(spark, sf_dir).groupBy("Date", "Position")
            .agg(F.var_samp("disc").alias("SpecificVar"))
            .filter(F.col("SpecificVar").isNotNull()))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        position_id("s_suppkey").alias("Position"),
        F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("Ticker"),
        F.col("s_suppkey").alias("CIK"),
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("CUSIP"),
        F.col("s_name").alias("Issuer"), F.col("n_name").alias("Sector"),
        F.col("r_name").alias("Country"))


def factor_meta(fr: DataFrame) -> DataFrame:
    return fr.select("Factor").distinct().select(
        "Factor", F.when(F.col("Factor") == "Market", "Market")
        .when(F.col("Factor").startswith("Ind:"), "Industry").otherwise("Style").alias("FactorGroup"))


def filing_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly holdings per book, filed 45 days after the quarter end."""
    q = F.last_day(F.add_months(F.trunc("Day", "quarter"), 2))
    return (book_lots(spark, sf_dir)
            .groupBy("Book", q.alias("report_date"), "Position")
            .agg(F.round(F.sum("mv"), 4).alias("MV"), F.count(F.lit(1)).alias("lots"))
            .withColumn("filing_date", F.date_add("report_date", 45)))


def managers(filings: DataFrame) -> DataFrame:
    a = filings.groupBy("Book").agg(
        F.min("filing_date").alias("first_filing_date"), F.max("filing_date").alias("last_filing_date"),
        F.count_distinct("filing_date").alias("n_filings"),
        F.count_distinct("Position").alias("n_positions_distinct"))
    return a.select(
        "Book", F.upper(F.substring("Book", 1, 4)).alias("CIK"),
        F.concat(F.initcap("Book"), F.lit(" Desk")).alias("EntityName"),
        F.when(F.col("Book").isin("MACHINERY", "AUTOMOBILE"), "Industrial").otherwise("Consumer")
        .alias("FirmType"),
        "first_filing_date", "last_filing_date", "n_filings",
        F.col("n_positions_distinct").alias("n_distinct_cusips_parsed"),
        F.lit(0.0).alias("dropped_value_share_latest"), "n_positions_distinct")


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    """The model frames of ``sf_dir``, built once per application as written tables."""
    tag = f"{sf_dir.strip('/').replace('/', '_')}"

    def mat(name, build, cluster=None):
        return materialized(spark, f"{tag}/{name}", build, cluster)

    f: dict = {}
    out = Frames(spark, f)

    def lazy(name, build, cluster=None):
        f[name] = lambda: mat(name, build, cluster)

    lazy("factor_returns", lambda: factor_returns(spark, sf_dir))
    lazy("prices", lambda: prices(spark, sf_dir), ["Position"])
    lazy("factor_meta", lambda: factor_meta(out.factor_returns))
    lazy("exposures", lambda: exposures(spark, sf_dir), ["Date"])
    lazy("positions", lambda: positions(spark, sf_dir), ["Date"])
    lazy("securities", lambda: securities(spark, sf_dir))
    lazy("specific_var", lambda: specific_var(spark, sf_dir), ["Date"])
    lazy("specific_returns", lambda: specific_returns(spark, sf_dir, out.factor_returns), ["Date"])
    lazy("filings", lambda: filing_lots(spark, sf_dir))
    lazy("fundamentals", lambda: fundamentals(spark, sf_dir))
    lazy("index", lambda: index_snapshots(spark, sf_dir))
    lazy("universe", lambda: universe(spark, sf_dir))
    lazy("proxies", lambda: proxies(spark, sf_dir))
    lazy("managers", lambda: managers(out.filings))
    lazy("scenarios", lambda: scenarios.scenario_sets(out.factor_returns, EVENTS, HYPOS))
    return out


def proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily proxy closes (Series, Date, Close): the market and two part-type indices."""
    lots = factor_lots(spark, sf_dir)
    by = lots.groupBy(F.col("Day").alias("Date"), "Factor").agg(
        F.sum(F.col("price") / F.col("qty")).alias("s"), F.count(F.lit(1)).alias("n"))
    mkt = by.groupBy("Date").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("Series", F.lit("MKT"))
    other = by.filter(F.col("Factor").isin("PROMO", "SMALL")).select(
        "Date", "s", "n", F.when(F.col("Factor") == "PROMO", "RATE").otherwise("INDEX").alias("Series"))
    return mkt.unionByName(other).select("Series", "Date", F.round(F.col("s") / F.col("n"), 8).alias("Close"))


def _number(col: str = "Position") -> Column:
    return F.substring(F.col(col), 2, 18).cast("long")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts per position, filed 45 days after the quarter; some names lack a tag."""
    q = F.last_day(F.add_months(F.trunc("Day", "quarter"), 2))
    a = (line_lots(spark, sf_dir).groupBy("Position", F.date_add(q, 45).alias("filed"))
         .agg(F.sum("qty").alias("qty"), F.round(F.sum("price"), 4).alias("Assets"),
              F.round(F.sum(F.col("price") * F.col("disc")), 4).alias("d")))
    n = _number()
    return a.select(
        "Position", "filed", F.round(F.col("Assets") * 0.6, 4).alias("Equity"), "Assets",
        F.when(n % 7 != 0, F.round(F.col("d") * 8, 4)).alias("Liabilities"),
        F.round(F.col("Assets") * 0.06 - F.col("d"), 4).alias("NetIncome"),
        F.when(n % 11 != 0, F.col("qty") * 1000).alias("Shares"))


def index_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(effective_date, Position): members of the index from each half-year start, the names at or
    above that half-year's median revenue."""
    from riskloom.functions.quantiles import exact_quantiles

    m = F.month("Day")
    half = F.make_date(F.year("Day"), F.when(m <= 6, 1).otherwise(7), F.lit(1))
    r = (line_lots(spark, sf_dir).groupBy(half.alias("effective_date"), "Position")
         .agg(F.round(F.sum("mv"), 4).alias("rev")))
    med = exact_quantiles(r, ["effective_date"], "rev", {"med": 0.5})
    return r.join(F.broadcast(med), "effective_date").filter(F.col("rev") >= F.col("med")).select("effective_date", "Position")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Position, is_estimation): coverage names; the estimation seed is the index of any half-year
    among names that report shares."""
    seed = index_snapshots(spark, sf_dir).groupBy("Position").agg(F.count(F.lit(1)).alias("halves"))
    return (securities(spark, sf_dir).select("Position").join(seed, "Position", "left")
            .select("Position", ((F.coalesce("halves", F.lit(0)) >= 5) & (_number() % 11 != 0)).alias("is_estimation")))
