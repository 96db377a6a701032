"""Two states of a book: what-if trades and what changed since the previous filing."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from riskloom.catalog.oracle import sql
from riskloom.catalog.registry import query, tidy_sql
from riskloom.frames import staged
from riskloom.functions.joins import broadcast_if_small
from riskloom.operators import changes
from riskloom.sources import tables

_K = "branch, date, book"


def risk_ctes(holdings: str, read_off: bool) -> dict:
    """SQL twin of the risk block: ``wr`` has one row per (branch, date, book) of the CTE ``holdings`` (branch, date, book,
    position, weight), ``wrl`` one per metric."""
    scale = "read99" if read_off else "var99"
    part = f"PARTITION BY {_K}"
    wide = {"model_vol_1d": "sqrt(vol * vol + svar)", "scenario_var_99": "var99", "scenario_var_975": "var975", "es_975": "es975", "es_99": "es99",
            "specific_vol": "sqrt(svar)", "total_var_99": "sqrt(var99 * var99 + 2.326 * 2.326 * svar)", "top5_ctr_share": "top5", "gross": "gross", "net": "net"}
    return {
        "wn": ((holdings, "prx", "sv"), f"SELECT h.branch, h.date, h.book, h.position, h.weight, coalesce(sv.sv, 0) AS sv FROM {holdings} h JOIN (SELECT DISTINCT date, position FROM prx) e USING (date, position) LEFT JOIN sv USING (date, position)"),
        "wx": (("wn", "prx"), f"SELECT {_K}, factor AS k, sum(weight * loading) AS x FROM wn JOIN prx USING (date, position) GROUP BY ALL"),
        "hf": (("scn",), "SELECT * FROM scn WHERE scenarioset = 'HistFull'"),
        "wp": (("wx", "hf"), f"SELECT {_K}, day_idx, sum(x * shock) AS b FROM wx JOIN hf ON k = factor GROUP BY ALL"),
        "wk": (("wp",), f"SELECT *, row_number() OVER ({part} ORDER BY b, day_idx) AS rk, count(*) OVER ({part}) AS n FROM wp"),
        "ws": (("wk",), f"""SELECT {_K}, stddev_samp(b) AS vol, -quantile_cont(b, 0.01) AS var99, -quantile_cont(b, 0.025) AS var975, -avg(CASE WHEN rk <= ceil(0.025 * n) THEN b END) AS es975,
            -avg(CASE WHEN rk <= ceil(0.01 * n) THEN b END) AS es99, -max(CASE WHEN rk = floor(0.01 * (n - 1)) + 1 THEN b END) AS read99,
            max(CASE WHEN rk = floor(0.01 * (n - 1)) + 1 THEN day_idx END) AS tday FROM wk GROUP BY ALL"""),
        "wm": (("wn", "prx", "ws", "hf"), f"""SELECT {_K}, position, -sum(weight * loading * shock) * any_value({scale}) + any_value(2.326 * 2.326 * weight * weight * sv) AS m
            FROM wn JOIN prx USING (date, position) JOIN ws USING ({_K}) JOIN hf ON hf.factor = prx.factor AND hf.day_idx = tday GROUP BY ALL"""),
        "wt": (("wm",), f"SELECT {_K}, sum(CASE WHEN r <= 5 THEN m END) / sum(m) AS top5 FROM (SELECT *, row_number() OVER ({part} ORDER BY m DESC) AS r FROM wm) GROUP BY ALL"),
        "wsp": (("wn",), f"SELECT {_K}, sum(weight * weight * sv) AS svar, sum(abs(weight)) AS gross, sum(weight) AS net FROM wn GROUP BY ALL"),
        "wr": (("ws", "wt", "wsp"), f"SELECT {_K}, {', '.join(f'{e} AS {m}' for m, e in wide.items())} FROM ws JOIN wt USING ({_K}) JOIN wsp USING ({_K})"),
        "wrl": (("wr",), " UNION ALL ".join(f"SELECT {_K}, '{m}' AS metric, {m} AS v FROM wr" for m in wide)),
    }


# ---- what if: the largest name halved, and a name that is not held bought, in every book on every date -----------------
TRADES = {
    # only names with a residual variance are covered by the model here; others are held but unpriced
    "prx": (("expo", "sv"), "SELECT e.* FROM expo e SEMI JOIN sv USING (date, position)"),
    "cov": (("prx",), "SELECT DISTINCT date, position FROM prx"),
    "tr": (("pos", "cov"), """SELECT 'TrimTop' AS branch, date, book, position, weight / 2 AS weight FROM
        (SELECT *, row_number() OVER (PARTITION BY date, book ORDER BY weight DESC, position) AS r FROM pos SEMI JOIN cov USING (date, position)) WHERE r = 1 UNION ALL
        SELECT 'BuyNew', date, book, min(position), 0.05 FROM (SELECT c.date, b.book, c.position FROM cov c JOIN (SELECT DISTINCT date, book FROM pos) b USING (date)) x
        ANTI JOIN pos USING (date, book, position) GROUP BY date, book UNION ALL
        SELECT 'DropTop', date, book, position, 0.0 FROM
        (SELECT *, row_number() OVER (PARTITION BY date, book ORDER BY weight DESC, position) AS r FROM pos SEMI JOIN cov USING (date, position)) WHERE r = 1"""),
    "br": (("tr",), "SELECT DISTINCT branch, date, book FROM tr"),
    "hb": (("pos", "tr", "br"), """SELECT 'Base' AS branch, date, book, position, weight FROM pos SEMI JOIN br USING (date, book) UNION ALL
        SELECT branch, date, book, position, coalesce(tr.weight, p.weight) FROM (SELECT br.branch, pos.* FROM pos JOIN br USING (date, book)) p
        FULL OUTER JOIN tr USING (branch, date, book, position) WHERE coalesce(tr.weight, p.weight) <> 0"""),
}


def model(spark, sf_dir):
    """The frames with names covered where they have a residual variance, and trades derived from the books."""
    f = tables.frames(spark, sf_dir)
    names = ["Date", "Position"]
    covered = staged(f.exposures.select(*names).distinct().join(f.specific_var.select(*names), names, "left_semi"))
    f = f.replace(exposures=f.exposures.join(covered, names, "left_semi"))
    p = f.positions.select("Date", "Book", "Position", "Weight")
    top = p.join(covered, names, "left_semi").withColumn(
        "r", F.row_number().over(Window.partitionBy("Date", "Book").orderBy(F.col("Weight").desc(), "Position"))).filter("r = 1")
    # a covered name carries the books that hold it, so that no row per name and book is dealt
    holders = p.groupBy(*names).agg(F.collect_set("Book").alias("held"))
    books = staged(p.select("Date", "Book").distinct())
    new = (covered.join(holders, names, "left").join(broadcast_if_small(books), "Date")
           .filter(~F.coalesce(F.array_contains("held", F.col("Book")), F.lit(False)))
           .groupBy("Date", "Book").agg(F.min("Position").alias("Position")))
    cols = ["Branch", "Date", "Book", "Position", "Weight"]
    cut = F.inline(F.array(F.struct(F.lit("TrimTop").alias("Branch"), (F.col("Weight") / 2).alias("Weight")), F.struct(F.lit("DropTop").alias("Branch"), F.lit(0.0).alias("Weight"))))
    trades = (top.select("Date", "Book", "Position", cut).select(*cols)
              .unionByName(new.withColumns({"Branch": F.lit("BuyNew"), "Weight": F.lit(0.05)}).select(*cols)))
    return f, trades


@query("mod07_whatif_risk", sql(tidy_sql("""SELECT a.branch, a.date, a.book, a.metric, b.v AS before, a.v AS after, a.v - b.v AS delta FROM wrl a JOIN wrl b ON a.date = b.date AND a.book = b.book AND a.metric = b.metric
    WHERE a.branch <> 'Base' AND b.branch = 'Base'""", "before after delta"), "wrl", **TRADES, **risk_ctes("hb", False)))
def _(s, d):
    return changes.whatif(*model(s, d))["risk"]


@query("mod07_whatif_holdings", sql(tidy_sql("""SELECT branch, date, book, position, coalesce(ticker, position) AS ticker, coalesce(p.weight, 0) AS old, coalesce(tr.weight, p.weight) AS new,
    CASE WHEN tr.weight IS NULL THEN 'held' WHEN p.weight IS NULL THEN 'added' WHEN tr.weight = 0 THEN 'dropped' ELSE 'resized' END AS change, (date, position) IN (SELECT (date, position) FROM cov) AS priced
    FROM (SELECT br.branch, pos.* FROM pos JOIN br USING (date, book)) p FULL OUTER JOIN tr USING (branch, date, book, position) LEFT JOIN sec USING (position)""", "old new"), "sec", **TRADES))
def _(s, d):
    return changes.whatif(*model(s, d))["holdings"]


@query("mod07_whatif_unpriced", sql(tidy_sql("""SELECT date, book, position, coalesce(ticker, position) AS ticker, weight FROM pos SEMI JOIN br USING (date, book) LEFT JOIN sec USING (position)
    WHERE (date, position) NOT IN (SELECT (date, position) FROM cov)""", "weight"), "sec", **TRADES))
def _(s, d):
    return changes.whatif(*model(s, d))["unpriced"]


# ---- what changed: every book on every date against its previous distinct book ---------------------------------------
CHANGED = {
    "prx": (("expo",), "SELECT * FROM expo"),
    "hb": (("pos",), "SELECT 'Base' AS branch, date, book, position, weight FROM pos"),
    "st": (("pos",), "SELECT book, date, list(position ORDER BY position) AS m FROM pos GROUP BY ALL"),
    "pr": (("st",), """SELECT * FROM (SELECT a.book, a.date, coalesce(max(b.date), (SELECT min(date) FROM st c WHERE c.book = a.book)) AS previous
        FROM st a LEFT JOIN st b ON b.book = a.book AND b.date < a.date AND b.m <> a.m GROUP BY a.book, a.date) WHERE previous < date"""),
    "nn": (("pos", "pr"), """SELECT book, date, previous, position, a.weight AS w0, b.weight AS w1 FROM (SELECT pr.*, pos.position, pos.weight FROM pr JOIN pos ON pos.book = pr.book AND pos.date = pr.previous) a
        FULL OUTER JOIN (SELECT pr.*, pos.position, pos.weight FROM pr JOIN pos ON pos.book = pr.book AND pos.date = pr.date) b USING (book, date, previous, position)"""),
    "nf": (("nn", "expo"), """SELECT n.*, k.factor, coalesce(a.loading, 0) AS l0, coalesce(b.loading, 0) AS l1 FROM nn n JOIN
        (SELECT DISTINCT n.book, n.date, n.position, e.factor FROM nn n JOIN expo e ON e.position = n.position AND ((e.date = n.previous AND w0 IS NOT NULL) OR (e.date = n.date AND w1 IS NOT NULL))) k USING (book, date, position)
        LEFT JOIN expo a ON a.date = n.previous AND a.position = n.position AND a.factor = k.factor AND w0 IS NOT NULL
        LEFT JOIN expo b ON b.date = n.date AND b.position = n.position AND b.factor = k.factor AND w1 IS NOT NULL"""),
    "fx": (("nf",), """SELECT book, date, previous, factor, sum(coalesce(w0, 0) * l0) AS x0, sum(coalesce(w1, 0) * l1) AS x1, sum(CASE WHEN w0 IS NULL THEN w1 * l1 ELSE 0 END) AS entered,
        sum(CASE WHEN w1 IS NULL THEN -w0 * l0 ELSE 0 END) AS exited, sum(CASE WHEN w0 IS NOT NULL AND w1 IS NOT NULL THEN (w1 - w0) * l0 ELSE 0 END) AS reweighted,
        sum(CASE WHEN w0 IS NOT NULL AND w1 IS NOT NULL THEN w1 * (l1 - l0) ELSE 0 END) AS loading_drift FROM nf GROUP BY ALL"""),
}


@query("mod31_what_changed", sql(tidy_sql("""SELECT book, date, previous, 'position' AS part, position AS item, issuer AS label, CASE WHEN w0 IS NULL THEN 'entered' WHEN w1 IS NULL THEN 'exited' ELSE 'resized' END AS change,
    w0 AS before, w1 AS after, coalesce(w1, 0) - coalesce(w0, 0) AS delta, NULL::DOUBLE AS entered, NULL::DOUBLE AS exited, NULL::DOUBLE AS reweighted, NULL::DOUBLE AS loading_drift
    FROM nn LEFT JOIN sec USING (position) WHERE w0 IS NULL OR w1 IS NULL OR abs(w1 - w0) > 0.005 UNION ALL
    SELECT book, date, previous, 'factor', factor, factorgroup, NULL, x0, x1, entered + exited + reweighted + loading_drift, entered, exited, reweighted, loading_drift FROM fx LEFT JOIN fm USING (factor) UNION ALL
    SELECT pr.book, pr.date, pr.previous, 'risk', a.metric, NULL, NULL, b.v, a.v, a.v - b.v, NULL, NULL, NULL, NULL FROM pr JOIN wrl a ON a.book = pr.book AND a.date = pr.date
    JOIN wrl b ON b.book = pr.book AND b.date = pr.previous AND b.metric = a.metric""", "before after delta entered exited reweighted loading_drift"), "sec", "fm", "fx", "wrl", **CHANGED, **risk_ctes("hb", True)))
def _(s, d):
    return changes.what_changed(tables.frames(s, d))
