"""The matrix of a pivot result."""

import pytest

from riskloom.plans import grid as gr
from riskloom.plans.pivot import PivotError

M = ["Net exposure", "% of Model vol"]


@pytest.fixture(scope="module")
def tidy(spark):
    rows = [("K", "Tech", "Size", 1.0, 0.25, "cell"), ("K", "Tech", "Value", -2.0, None, "cell"), ("K", "Oil", "Size", 4.0, 0.5, "cell"), ("K", "Dead", "Size", None, None, "cell"),
            ("K", "Tech", "Empty", None, float("nan"), "cell"), ("K", "TOTAL", "Size", 5.0, 0.75, "per_col"), ("K", "TOTAL", "Empty", None, None, "per_col"), ("K", "TOTAL", "TOTAL", 3.0, None, "grand"),
            ("K", "Tech", "TOTAL", -1.0, None, "per_row"), ("K", "Oil", "TOTAL", 4.0, 0.5, "per_row")]
    return spark.createDataFrame(rows, "Book string, Sector string, Factor string, `Net exposure` double, `% of Model vol` double, Margin string")


def test_measures_behind_columns_with_totals_and_blanks(tidy):
    g = gr.grid(tidy, ["Book", "Sector"], ["Factor"], M, sort=[("Size / Net exposure", True)])
    # blank columns go, the total column stays even where it is blank
    assert g.columns == ["Book", "Sector", "Size / Net exposure", "Size / % of Model vol", "Value / Net exposure", "TOTAL / Net exposure", "TOTAL / % of Model vol", "is_total"]
    rows = [(r["Sector"], r["Size / Net exposure"], r["Size / % of Model vol"], r["TOTAL / Net exposure"], r["is_total"]) for r in g.collect()]
    assert rows == [("Oil", 4.0, 50.0, 4.0, False), ("Tech", 1.0, 25.0, -1.0, False), ("TOTAL", 5.0, 75.0, 3.0, True)]  # no row of blanks
    everything = gr.grid(tidy, ["Book", "Sector"], ["Factor"], M, hide_empty=False)
    assert everything.count() == 4 and "Empty / Net exposure" in everything.columns and "Value / % of Model vol" in everything.columns


def test_measures_on_either_axis(tidy):
    g = gr.grid(tidy, ["Sector", gr.MEASURES], ["Factor"], M)
    got = {(r["Sector"], r["Measure"]): r["Size"] for r in g.collect()}
    assert got["Oil", "Net exposure"] == 4.0 and got["Oil", "% of Model vol"] == 50.0 and ("Dead", "Net exposure") not in got
    first = gr.grid(tidy, ["Sector"], [gr.MEASURES, "Factor"], M[:1])
    assert first.columns == ["Sector", "Net exposure / Size", "Net exposure / Value", "Net exposure / TOTAL", "is_total"]
    flat = gr.grid(tidy.filter("Factor = 'Size'"), ["Sector", gr.MEASURES], [], M, sort=[("Measure", False), ("value", True)])
    assert [(r["Sector"], r["value"]) for r in flat.collect()][:2] == [("Oil", 50.0), ("Tech", 25.0)] and flat.collect()[-1]["Sector"] == "TOTAL"


def test_what_a_grid_refuses(tidy):
    with pytest.raises(PivotError, match="columns"):
        gr.grid(tidy, ["Sector"], ["Factor"], M, max_columns=3)
    with pytest.raises(PivotError, match="one axis"):
        gr.grid(tidy, ["Sector", gr.MEASURES], [gr.MEASURES], M)
    with pytest.raises(PivotError, match="needs rows"):
        gr.grid(tidy, [], ["Factor"], M)
    with pytest.raises(PivotError, match="sort"):
        gr.grid(tidy, ["Sector"], ["Factor"], M, sort=[("nothing", True)])
    assert gr.grid(tidy.limit(0), ["Sector"], ["Factor"], M).count() == 0
