"""Mixing sources to target weights by weighted fair queueing.

Sources, ordered by name with the null source last, weigh 1, 2, 3, repeating, and share the budget
(all words). No source is taken more than ``cap`` times: what it cannot use is shared again by
weight, i.e. the targets are min(cap x size, level x weight) with the level that uses the budget up.

Every document, in an order shuffled by hash, is a packet of its source's flow; its virtual finish
time is the source's running word count, over all repeats, divided by the target. All flows are
merged by finish time and the queue is truncated at the budget. The one document per source that
straddles time 1 is cut into packets of ``packet`` words, so that a source ends within one packet of
its target. A running word count is a sum of hash buckets plus a window inside one bucket, the merged
queue a sum of time buckets plus a window inside one: no source and no queue is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.functions.joins import broadcast_if_small
from riskloom.llm.common import WORD, Stages, free

WEIGHTS = (1, 2, 3)
SEED = "mix-1"
BUCKETS = 4096  # three hex digits


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so its windows
    are over source names only. Sources without words get target 0."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_k", F.row_number().over(order))
    w = w.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") - 1) % len(weights) + 1))
    w = w.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "_k")
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    w = w.withColumn("_level", (total - before) / rest)
    w = w.withColumn("_level", F.max("_level").over(everything))
    return w.select("source", "source_size", F.least("limit", F.col("_level") * F.col("w")).alias("target"))


def _prefix(df: DataFrame, by: list[str], bucket: str, value: str, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, the running sum of ``value`` up to and including the row, inside ``by`` in the order
    (bucket, order): sums of whole buckets plus a window inside one bucket."""
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*by, bucket)], F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_off"))
    cond = F.lit(True)
    for c in (*by, bucket):
        cond = cond & df[c].eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keep = df.columns
    return (df.join(broadcast_if_small(sums), cond)
            .select(*keep, (F.col("_off") + F.sum(value).over(inside)).alias(out)))


def schedule(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
             weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, packet: int = 256) -> tuple[Stages, DataFrame]:
    """(stages, rows): every row of ``docs`` as key, source, size with source_size, target and taken.

    Null texts and texts without words have size 0 and are taken 0 times. Rows that repeat a key are
    documents of their own; equal rows may swap their places. Null keys sort first. An empty table
    gives an empty result; texts of any length are counted whole; other columns are not read. Reruns agree:
    the order comes from a hash of the key."""
    st = Stages(docs.sparkSession)
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    d = d.withColumn("_h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))))
    d = st.write("sizes", d.withColumn("_b", F.substring("_h", 1, 3)))
    src = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    src = st.write("targets", src)
    d = _prefix(d, ["source"], "_b", "size", [F.col("_h"), F.col("doc_id"), F.col("size")], "_c")
    s = src.withColumnRenamed("source", "_s")
    d = st.write("flows", d.join(broadcast_if_small(s), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_h", "_b"))
    st.drop("sizes")

    # copies of a document that can start before time 1
    copies = (d.filter("size > 0 and target > 0")
              .withColumn("_e", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)))
              .withColumn("_f", F.col("_e") * F.col("source_size") + F.col("_c"))
              .filter(F.col("_f") - F.col("size") < F.col("target")))
    whole = copies.filter(F.col("_f") <= F.col("target")).select("source", "target", F.col("_f").alias("f"), F.col("size").alias("n"))
    cut = (copies.filter(F.col("_f") > F.col("target"))
           .withColumn("_i", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / packet).cast("long"))))
           .select("source", "target", F.least(F.col("_f") - F.col("size") + (F.col("_i") + 1) * packet, "_f").alias("f"),
                   F.least(F.lit(packet), F.col("size") - F.col("_i") * packet).cast("long").alias("n"))
           .filter(F.col("f") - F.col("n") < F.col("target")))
    queue = whole.unionByName(cut).select("source", "n", (F.col("f") / F.col("target")).alias("t"))
    queue = queue.withColumn("_b", F.least(F.floor(F.col("t") * BUCKETS), F.lit(BUCKETS)))
    run = _prefix(queue, [], "_b", "n", [F.col("t"), F.col("source").asc_nulls_last(), F.col("n")], "_run")
    budget = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_budget"))
    got = (run.join(F.broadcast(budget))  # one row
           .withColumn("_n", F.greatest(F.lit(0), F.least("n", F.col("_budget") - F.col("_run") + F.col("n"))))
           .groupBy("source").agg(F.sum("_n").alias("_got")).withColumnRenamed("source", "_s"))
    got = st.write("got", got)
    # what a flow got is a prefix of it, so each copy's share follows from its start
    d = d.join(broadcast_if_small(got), F.col("source").eqNullSafe(F.col("_s")), "left")
    share = F.lit(0)
    for e in range(int(-(-cap // 1))):
        start = F.lit(e) * F.col("source_size") + F.col("_c") - F.col("size")
        share = share + F.greatest(F.lit(0), F.least("size", F.coalesce("_got", F.lit(0)) - start))
    return st, d.select("doc_id", "source", "size", "source_size", "target", share.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the schedule takes it as a whole (the last,
    cut copy counts if at least half of its words fit). Keys must be unique for this form; equal keys
    share one decision, also null keys. ``docs`` keeps its columns."""
    key = kw.get("key", "doc_id")
    _, plan = schedule(docs, **kw)
    k, n, i = free(docs, "_key", "_n", "_i")
    often = plan.filter("taken > 0").select(F.col("doc_id").alias(k), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(n))
    often = often.groupBy(k).agg(F.max(n).alias(n)).filter(F.col(n) > 0)
    return (docs.join(often, docs[key].eqNullSafe(F.col(k))).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return schedule(docs)[1].select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
           md5(coalesce(doc_id::VARCHAR, '') || '{SEED}') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w1 AS (SELECT *, [{', '.join(f'{float(x)}::DOUBLE' for x in WEIGHTS)}][((k - 1) % {len(WEIGHTS)} + 1)::INT] AS w, source_size::DOUBLE * 3.0::DOUBLE AS lim FROM w),
w2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
       / sum(w) OVER (ORDER BY lim / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w1),
t AS (SELECT source, source_size, least(lim, max(lv) OVER () * w) AS target FROM w2),
f AS (SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
cp AS (SELECT *, e * source_size + c AS fin FROM f, range(0, 3) g(e) WHERE size > 0 AND target > 0 AND e * source_size + c - size < target),
q AS (SELECT source, fin / target AS tm, size AS n FROM cp WHERE fin <= target
      UNION ALL SELECT source, least(fin - size + (i + 1) * 256, fin) / target, least(256, size - i * 256)
      FROM (SELECT *, unnest(range(0, (size - 1) // 256 + 1)) AS i FROM cp WHERE fin > target)
      WHERE least(fin - size + (i + 1) * 256, fin) - least(256, size - i * 256) < target),
r AS (SELECT source, n, sum(n) OVER (ORDER BY tm, source NULLS LAST, n ROWS UNBOUNDED PRECEDING) AS run FROM q),
got AS (SELECT source, sum(greatest(0, least(n, (SELECT sum(source_size) FROM s) - run + n)))::BIGINT AS got FROM r GROUP BY source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ({' + '.join(f'greatest(0, least(size, coalesce(got, 0) - ({e} * source_size + c - size)))' for e in range(3))})::BIGINT AS taken
FROM f LEFT JOIN got ON f.source IS NOT DISTINCT FROM got.source
"""
