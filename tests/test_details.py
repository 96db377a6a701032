"""What the data checks object to, on frames with planted faults."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom import schema
from riskloom.operators import quality as qa
from toys import risk_frames


def test_details_name_the_rows(spark):
    f, n = risk_frames(spark)
    assert qa.check_details(f).filter(~F.col("name").startswith("held")).count() == 0
    d, mk = n["date"], lambda rows, name: spark.createDataFrame(rows, schema.SCHEMAS[name])
    bad = f.replace(
        positions=f.positions.unionByName(mk([(d, "A", "P1", -0.5, 1.0, None), (d, "A", "ghost", 0.1, 1.0, None), (d, None, "P2", 0.1, 1.0, None)], "positions")),
        exposures=f.exposures.unionByName(mk([(d, f"P{i}", "Value", 99.0) for i in range(1, 7)], "exposures")),
        factor_returns=f.factor_returns.unionByName(mk([(dt.date(2030, 1, 1), "Unknown", 0.9)], "factor_returns")))
    got = {}
    for r in qa.check_details(bad, 3).collect():
        got.setdefault(r.name, (r.n, []))[1].append((r.rank, r.key))
    keys = {k: (n, [x for _, x in sorted(v)]) for k, (n, v) in got.items()}
    assert keys["positions: no negative weights"] == (1, [f"{d} / A / P1"]) and keys["positions: key unique"] == (1, [f"{d} / A / P1"])
    assert keys["positions: no null keys"] == (1, [f"{d} / null / P2"]) and keys["positions.Position in securities"] == (1, ["ghost"])
    assert keys["exposures: loadings within the coverage cap"] == (6, [f"{d} / P{i} / Value" for i in (1, 2, 3)])
    assert keys["factor_returns.Factor in factor_meta"] == (1, ["Unknown"]) and keys["factor_returns: |return| <= 50%"][0] == 1
    assert keys["held positions have exposures on the same date"] == (1, [f"{d} / ghost"])
    text = {r.name: r.detail for r in qa.detail_text(qa.check_details(bad, 3)).collect()}
    assert text["exposures: loadings within the coverage cap"] == f"6 rows: {d} / P1 / Value; {d} / P2 / Value; {d} / P3 / Value; ..."
    assert text["positions.Position in securities"] == "1 row: ghost"
