import duckdb
import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from riskloom.llm import line_dedup, mixing, quality, simhash  # noqa: E402
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_packing import check, whole_ids  # noqa: E402
from test_simhash import plain_classes  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        d = stage(spark, out[-1], SF)
        d.write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert out[-1].columns == docs.columns
    sql = duckdb.connect()

    def table(k, name):
        sql.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")

    # quality: the decisions are the classifier's, clean labelled documents stay, rejected ones go
    kept = {r.doc_id for r in out[1].select("doc_id").collect()}
    scored = quality.op8_quality(spark, SF).toPandas()
    assert kept == set(scored.doc_id[scored.predicted == 1])
    lab = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good, bad = set(lab.doc_id[lab.quality == 1]), set(lab.doc_id[lab.quality == 0])
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.1 * len(bad)

    # line dedup: texts equal the SQL twin's over this stage's own input
    table(0, "documents")
    want = {r[0]: (r[3], r[4]) for r in sql.execute(line_dedup.OP1_SQL).fetchall()}
    table(1, "after")
    got = dict(sql.execute("SELECT doc_id, (length(text), md5(text)) FROM after").fetchall())
    assert all(got[k] == want[k] for k in got)
    gone = set(want) - set(got)
    blank = {k for k, in sql.execute(rf"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[^\x20\x09-\x0D]')").fetchall()}
    assert all(want[k][0] < 40 for k in gone - blank)

    # SimHash: one document of each all-pairs class stays, up to the pairs that no bit set brings together
    texts = dict(sql.execute("SELECT doc_id, text FROM after").fetchall())
    fps = {k: simhash.simhash(t.encode(), pipeline.SHINGLE) for k, t in texts.items()}
    first = {}
    for k in sorted(fps):
        first.setdefault(fps[k], k)
    classes = plain_classes({v: k for k, v in first.items()}, pipeline.RADIUS)
    want = {classes[first[f]] for f in fps.values()}
    left = {r.doc_id for r in out[3].select("doc_id").collect()}
    assert want <= left and len(left - want) <= 0.01 * len(texts)

    # mixing: whole copies as often as the schedule takes them
    table(2, "documents")
    plan = {r[0]: (r[1], r[4]) for r in sql.execute(mixing.OP10_SQL).fetchall()}
    want = {k: int(np.floor(t / n + 0.5)) for k, (n, t) in plan.items() if t}
    got = {r.doc_id: r["count"] for r in out[4].groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}

    # packing: every id of every copy once
    rows = out[4].select("doc_id", "text").collect()
    total = sum(len(x) for x in whole_ids([r.text for r in rows]))
    pieces = out[5].collect()
    assert sum(p.length for p in pieces) == total
    once = {r.doc_id: r.text for r in rows if got[r.doc_id] == 1}
    assert {p.doc_id for p in pieces} == set(got)
    check_only = [p for p in pieces if p.doc_id in once]
    by = {}
    for p in check_only:
        by.setdefault(p.doc_id, []).append((p.start, p.length))
    ids = dict(zip(once, whole_ids(once.values())))
    for k, v in by.items():
        assert sorted(v)[0][0] == 0 and sum(n for _, n in v) == len(ids[k])


def test_run_returns_the_last_stage(spark):
    from __spark_entry__ import queries

    got = queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
