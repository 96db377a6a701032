import sys
import zlib
from pathlib import Path

import pytest

packing = pytest.importorskip("riskloom.llm.packing")
sys.path.insert(0, str(Path(__file__).parent))
from test_packing import PATH, whole_ids  # noqa: E402


def test_every_piece_has_its_ids(spark):
    import numpy as np

    rows = [(1, None), (2, "short text"), (3, "a text of some whole windows " * 900), (4, "odd  spaces\n" * 1500)]
    ids = {k: np.array(x, "<u4").tobytes() for (k, _), x in zip(rows, whole_ids([t for _, t in rows]))}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, with_ids=True).collect()
    assert any(r.length == packing.WINDOW for r in got)
    for k in ids:
        assert b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)) == ids[k]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
