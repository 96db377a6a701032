"""Keyset pages cover all rows, null keys included."""

import pytest

from riskloom.plans import views


@pytest.mark.parametrize("down", [False, True])
def test_pages_with_null_keys(spark, down):
    rows = [(x, y, f"{x}-{y}") for x in (None, 1.0, 2.0, 2.5) for y in (None, "a", "b")]
    df = spark.createDataFrame(rows, "x double, y string, v string")
    order = [("x", down), ("y", not down)]
    seen, after = [], None
    while True:
        page = views.page(df, order, 5, after).collect()
        if not page:
            break
        seen += page
        after = (page[-1].x, page[-1].y)
    assert [r.v for r in seen] == [r.v for r in views.page(df, order, 99).collect()] and len(seen) == 12
    assert [r.x for r in seen][-3:] == [None] * 3 and seen[0].y is not None
