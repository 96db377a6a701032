"""Chat formatting: tool calls linked to their results.

Events are messages, calls and results. Calls and results meet in a hash join on (conversation,
identifier); arguments are checked against the tool's schema; every event becomes one line of
canonical JSON (keys sorted, no blanks). Events are ordered topologically: a result follows its call, a
call follows the results that it names as dependencies. Most conversations are written down in such
an order, which their turns then give; only those with an edge against it are peeled level by level.

One row per event: a conversation is never gathered in one task, however long. Sorting by
(conv_id, level, turn, idx) gives the linked conversation. Only DataFrame expressions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import Stages

#: argument schema of a tool: field -> (JSON type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {"integer": "^(BIGINT|DECIMAL[(][0-9]+,0[)])$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "string": "^STRING$", "boolean": "^BOOLEAN$",
          "array": "^ARRAY", "object": "^OBJECT"}
EVENT = ("conv_id", "turn", "idx", "type", "call_id", "name", "arguments", "content", "role", "depends_on")


def events_from_messages(df: DataFrame) -> DataFrame:
    """Events of messages (conv_id, turn, role, text). An assistant text that is a JSON object with
    ``tool_calls`` [{id, name, arguments, depends_on}] is its calls; a message with role ``tool`` and a
    JSON text {tool_call_id, content} is a result; any other is a plain message."""
    t = F.col("text")
    calls = F.from_json(t, "tool_calls array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>")["tool_calls"]
    d = df.select("conv_id", "turn", "role", "text", F.when((F.col("role") == "assistant") & F.ltrim(t).startswith("{"), calls).alias("_calls"),
                  F.when(F.col("role") == "tool", F.from_json(t, "tool_call_id string, content string")).alias("_res"))
    none = F.lit(None).cast("string")
    call = d.filter(F.size("_calls") > 0).select("conv_id", "turn", "role", F.posexplode("_calls").alias("idx", "c")).select(
        "conv_id", "turn", "idx", F.lit("call").alias("type"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"), none.alias("content"), "role", F.col("c.depends_on").alias("depends_on"))
    result = F.col("_res.tool_call_id").isNotNull()
    rest = d.filter(F.coalesce(F.size("_calls"), F.lit(0)) <= 0).select(
        "conv_id", "turn", F.lit(0).alias("idx"), F.when(result, "result").otherwise("message").alias("type"), F.col("_res.tool_call_id").alias("call_id"),
        none.alias("name"), none.alias("arguments"), F.when(result, F.col("_res.content")).otherwise(F.col("text")).alias("content"), "role",
        F.lit(None).cast("array<string>").alias("depends_on"))
    return call.unionByName(rest)


def events_from_turns(df: DataFrame) -> DataFrame:
    """Plain conversations as calls and results: a user turn calls the tool ``reply`` with its text, turn
    and word count, under the identifier ``conv_id-turn``, and depends on the reply before it; an
    assistant turn is the result of the turn before it. Other roles are messages."""
    ident = lambda back: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), (F.col("turn") - back).cast("string"))
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    args = F.to_json(F.struct("text", "turn", words.alias("words")), {"ignoreNullFields": "false"})
    return df.select(
        "conv_id", "turn", F.lit(0).alias("idx"), F.when(user, "call").when(bot, "result").otherwise("message").alias("type"),
        F.when(user, ident(0)).when(bot, ident(1)).alias("call_id"), F.when(user, "reply").alias("name"), F.when(user, args).alias("arguments"),
        F.when(~user | user.isNull(), F.col("text")).alias("content"), "role",
        F.when(user & (F.col("turn") > 1), F.array(ident(2))).alias("depends_on"))


def valid(name: Column, value: Column, schemas: Schemas) -> Column:
    """Whether a variant is an object that fits the schema of the tool ``name``: known tool, required
    fields there, types right, no other fields."""
    kind = lambda v: F.schema_of_variant(v)
    ok = F.lit(False)
    for tool, fields in schemas.items():
        fit = kind(value).startswith("OBJECT")
        for f, (t, required) in fields.items():
            v = F.try_variant_get(value, f"$['{f}']", "variant")
            fit = fit & F.coalesce(kind(v).rlike(_TYPES[t]), F.lit(not required))
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        extra = F.array_except(F.coalesce(F.map_keys(F.from_json(F.to_json(value), "map<string,string>")), F.array().cast("array<string>")), known)
        ok = F.when(name == tool, fit & (F.size(extra) == 0)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def _levels(st: Stages, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, type, call_id, level, cycle) of the nodes: level = longest path to it; what never
    becomes free lies on or behind a cycle. One round per level, each a written table."""
    done, k = [], 0
    on = ["conv_id", "type", "call_id"]
    while True:
        wait = edges.select("conv_id", F.col("to").alias("type"), F.col("to_id").alias("call_id")).distinct()
        free = st.write(f"free_{k}", nodes.join(wait, on, "left_anti"))
        nodes = st.write(f"nodes_{k}", nodes.join(free, on, "left_anti"))
        if free.isEmpty():
            done.append(nodes.withColumns({"level": F.lit(k), "cycle": F.lit(True)}))
            break
        done.append(free.withColumns({"level": F.lit(k), "cycle": F.lit(False)}))
        gone = free.select("conv_id", F.col("type").alias("from"), F.col("call_id").alias("from_id"))
        edges = st.write(f"open_{k}", edges.join(gone, ["conv_id", "from", "from_id"], "left_anti"))
        k += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def link(events: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per event: conv_id, level, turn, idx, type, call_id, status, line (canonical JSON).

    status: ``ok``; a call may be ``duplicate`` (its identifier was used before in its conversation),
    ``cycle``, ``invalid`` (arguments do not fit, or are no JSON) or ``no_result``; a result may be
    ``duplicate`` or ``orphan``; the first that holds. Events without an identifier link with nothing.
    Null texts are JSON nulls, arguments that are no JSON are kept as a string. Rows that repeat an
    event: one is the first, the others are duplicates. An empty table gives an empty result."""
    st = Stages(events.sparkSession)
    e = st.write("events", events.select(*EVENT))
    place = F.struct("turn", "idx").alias("at")
    tied = e.filter("type <> 'message' and call_id is not null")
    first = tied.groupBy("conv_id", "type", "call_id").agg(F.min(place).alias("at"))
    first = st.write("first", first)
    calls = first.filter("type = 'call'").select("conv_id", "call_id", F.col("at").alias("call_at"))
    results = first.filter("type = 'result'").select("conv_id", "call_id", F.col("at").alias("result_at"))
    pairs = st.write("pairs", calls.join(results, ["conv_id", "call_id"], "full_outer"))

    after_call = pairs.filter("call_at is not null and result_at is not null").select(
        "conv_id", F.lit("call").alias("from"), F.col("call_id").alias("from_id"), F.col("call_at").alias("a"),
        F.lit("result").alias("to"), F.col("call_id").alias("to_id"), F.col("result_at").alias("b"))
    deps = (tied.filter("type = 'call'").select("conv_id", "call_id", place, F.explode("depends_on").alias("need"))
            .join(calls, ["conv_id", "call_id"]).filter("at = call_at").select("conv_id", "call_id", "at", "need").distinct())
    after_need = deps.join(results.withColumnRenamed("call_id", "need"), ["conv_id", "need"]).select(
        "conv_id", F.lit("result").alias("from"), F.col("need").alias("from_id"), F.col("result_at").alias("a"),
        F.lit("call").alias("to"), F.col("call_id").alias("to_id"), F.col("at").alias("b"))
    edges = st.write("edges", after_call.unionByName(after_need))
    odd = st.write("odd", edges.filter("a >= b").select("conv_id").distinct())
    if odd.isEmpty():
        levels = first.select("conv_id", "type", "call_id", F.lit(0).alias("level"), F.lit(False).alias("cycle")).limit(0)
    else:
        levels = st.write("levels", _levels(st, first.join(odd, "conv_id", "left_semi").select("conv_id", "type", "call_id"), edges.join(odd, "conv_id", "left_semi")))

    k = ["conv_id", "call_id"]
    d = e.join(pairs, k, "left").join(levels, ["conv_id", "type", "call_id"], "left")
    same = F.when(F.col("type") == "call", F.col("call_at")).otherwise(F.col("result_at"))
    dup = F.col("call_id").isNotNull() & (F.struct("turn", "idx") != same)
    twin = Window.partitionBy("conv_id", "type", "call_id", "turn", "idx").orderBy(F.col("content").asc_nulls_first(), F.col("arguments").asc_nulls_first())
    twins = st.write("linked", d.select(*d.columns, F.coalesce(dup, F.lit(False)).alias("dup")))
    repeated = (twins.filter("call_id is not null").groupBy("conv_id", "type", "call_id", "turn", "idx").agg(F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1").select("conv_id", "type", "call_id", "turn", "idx"))
    key5 = ["conv_id", "type", "call_id", "turn", "idx"]
    again = twins.join(repeated, key5, "left_semi").withColumn("dup", F.col("dup") | (F.row_number().over(twin) > 1))  # copies of one identifier
    d = twins.join(repeated, key5, "left_anti").unionByName(again)

    value = F.try_parse_json("arguments")
    status = (F.when(F.col("type") == "message", "ok")
              .when(F.col("dup"), "duplicate")
              .when(F.col("type") == "result", F.when(F.col("call_at").isNotNull(), "ok").otherwise("orphan"))
              .when(F.col("cycle"), "cycle")
              .when(~valid(F.col("name"), value, schemas), "invalid")
              .when(F.col("result_at").isNull(), "no_result").otherwise("ok"))
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("x")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("x"))))) - 6), F.lit("null"))
    args = F.coalesce(F.to_json(value), text("arguments"))
    line = (F.when(F.col("type") == "call", F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"type":"call"}')))
            .when(F.col("type") == "result", F.concat(F.lit('{"content":'), text("content"), F.lit(',"id":'), text("call_id"), F.lit(',"type":"result"}')))
            .otherwise(F.concat(F.lit('{"content":'), text("content"), F.lit(',"role":'), text("role"), F.lit(',"type":"message"}'))))
    return d.select("conv_id", F.coalesce("level", F.lit(0)).cast("long").alias("level"), "turn", F.col("idx").cast("long").alias("idx"), "type", "call_id",
                    status.alias("status"), line.alias("line"))


#: schema of the tool that plain turns are read as
REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", False)}}


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a linked event with its canonical JSON line."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return link(events_from_turns(df), REPLY)


OP5_SQL = r"""
WITH e AS (SELECT conv_id, turn, role, text,
             CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS type,
             CASE WHEN role = 'user' THEN conv_id::VARCHAR || '-' || turn WHEN role = 'assistant' THEN conv_id::VARCHAR || '-' || (turn - 1) END AS call_id
           FROM conversations),
c AS (SELECT conv_id, call_id FROM e WHERE type = 'call'), r AS (SELECT conv_id, call_id FROM e WHERE type = 'result'),
q AS (SELECT *, CASE WHEN text IS NULL THEN 'null' ELSE to_json(text)::VARCHAR END AS js,
        row_number() OVER (PARTITION BY conv_id, type, call_id, turn ORDER BY text NULLS FIRST) AS k FROM e)
SELECT conv_id, 0::BIGINT AS level, turn, 0::BIGINT AS idx, type, call_id,
  CASE WHEN type = 'message' THEN 'ok' WHEN k > 1 THEN 'duplicate'
       WHEN type = 'result' THEN CASE WHEN (conv_id, call_id) IN (SELECT conv_id, call_id FROM c) THEN 'ok' ELSE 'orphan' END
       WHEN text IS NULL THEN 'invalid'
       WHEN (conv_id, call_id) IN (SELECT conv_id, call_id FROM r) THEN 'ok' ELSE 'no_result' END AS status,
  CASE type WHEN 'call' THEN '{"arguments":{"text":' || js || ',"turn":' || turn || ',"words":' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || '},"id":"' || call_id || '","name":"reply","type":"call"}'
       WHEN 'result' THEN '{"content":' || js || ',"id":"' || call_id || '","type":"result"}'
       ELSE '{"content":' || js || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}' END AS line
FROM q
"""
