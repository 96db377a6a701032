import json

import pytest
from pyspark.sql import functions as F

chat = pytest.importorskip("riskloom.llm.chat_format")
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True)}, "say": {"text": ("string", True), "loud": ("boolean", False)}}
SCHEMA = "conv_id long, turn long, role string, text string"


def calls(*cs):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c)) for c in cs]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def test_calls_and_results(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hé \"x\"\n\t1"),
            (1, 2, "assistant", calls(("c1", "add", {"b": 2.5, "a": 1}), ("c2", "say", {"text": "hi", "loud": True}))),
            (1, 3, "tool", result("c1", "3.5")), (1, 4, "tool", result("c9", "nobody asked")),
            (1, 5, "assistant", calls(("c3", "add", {"a": "one", "b": 1}), ("c4", "nope", {}), ("c5", "say", {"text": "x", "extra": 1}), ("c1", "say", {"text": "again"}))),
            # written before what it needs: d2 needs d1's result; e1 and e2 need each other
            (2, 0, "tool", result("d2", "last")), (2, 1, "assistant", calls(("d2", "say", {"text": "b"}, ["d1"]))), (2, 2, "tool", result("d1", "first")),
            (2, 3, "assistant", calls(("d1", "say", {"text": "a"}))),
            (3, 0, "assistant", calls(("e1", "say", {"text": "a"}, ["e2"]), ("e2", "say", {"text": "b"}, ["e1"]))), (3, 1, "tool", result("e1", "1")), (3, 2, "tool", result("e2", "2"))]
    got = chat.link(chat.events_from_messages(spark.createDataFrame(rows, SCHEMA)), SCHEMAS).collect()
    status = {(r.conv_id, r.turn, r.idx): r.status for r in got}
    assert len(got) == 18
    assert status[1, 2, 0] == "ok" and status[1, 2, 1] == "no_result" and status[1, 3, 0] == "ok" and status[1, 4, 0] == "orphan"
    assert [status[1, 5, i] for i in range(4)] == ["invalid", "invalid", "invalid", "duplicate"]
    assert status[3, 0, 0] == status[3, 0, 1] == "cycle"
    for r in got:
        assert r.line == json.dumps(json.loads(r.line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    two = [r.call_id + r.type[0] for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: (r.level, r.turn, r.idx))]
    assert two == ["d1c", "d1r", "d2c", "d2r"]
    first = next(r for r in got if (r.conv_id, r.turn, r.idx) == (1, 2, 0))
    assert json.loads(first.line) == {"arguments": {"a": 1, "b": 2.5}, "id": "c1", "name": "add", "type": "call"}


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (None, 0, "user", ""), (2, None, "user", "x"), (2, 1, None, "y"), (3, 0, "user", "same"), (3, 0, "user", "same"),
            (3, 1, "assistant", "a"), (4, 0, "tool", "{broken"), (4, 1, "assistant", "{also broken"), (5, 0, "user", "w " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("status", F.lit(1)).withColumn("type", F.lit("t"))
    for events in (chat.events_from_turns(df), chat.events_from_messages(df)):
        got = chat.link(events, chat.REPLY).collect()
        assert len(got) == len(rows)
        for r in got:
            json.loads(r.line)
        assert chat.link(events.limit(0), chat.REPLY).count() == 0
    got = chat.link(chat.events_from_turns(df), chat.REPLY).collect()
    by = sorted(r.status for r in got if r.conv_id == 3)
    assert by == ["duplicate", "ok", "ok"]
    assert {r.status for r in got if r.conv_id == 1 and r.turn == 0} == {"invalid"}
