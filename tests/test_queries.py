"""Registered queries against their SQL twins (all of them with RISKLOOM_ALL_QUERIES=1)."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))
SF = os.environ.get("RISKLOOM_TEST_SF", "/root/testdata/sf0.01")
SAMPLE = ["frame_exposures", "vec04_var_ladder", "vec11_marginal_var", "vec13_marginal_total_var", "vec14_risk_hhi", "vec16_incremental_var",
          "ag07_margins", "qry02_whatif", "win08_hysteresis", "win11_var_threshold_fhs", "mod15_drawdown", "mod17_carino_linking",
          "mod21_linkage", "mod29_limits", "jn04_filings_asof", "src04_information_table"]

from riskloom.catalog import oracle_sql, queries  # noqa: E402

NAMES = list(queries()) if os.environ.get("RISKLOOM_ALL_QUERIES") else SAMPLE


@pytest.mark.skipif(not Path(SF).exists(), reason="given tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from check import compare, connect

    status, msg, _ = compare(spark, connect(SF), SF, name, queries()[name], oracle_sql().get(name))
    assert status in ("ok", "rows"), msg


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
