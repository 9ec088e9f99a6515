"""Tool-call linking: join calls and results by identifier, order them, check arguments, write canonical JSON.

Native: DataFrame functions alone. Calls and results are hash-joined by (conversation, identifier). The
topological order comes from levels: a call without a parent, or whose parent is unknown, has level 0,
any other one more than its parent; a result follows its call. Levels spread along parent links by
pointer doubling, so a chain of n calls takes log2(n) joins, and no conversation is collected in one
place. Calls on a cycle have no level; they come last, marked ``cyclic``. Arguments are checked against a
schema of field names and types (string, integer, number, boolean, array, object, null) with
required fields and, if said so, no others. Canonical JSON has keys in code-point order, no spaces, and
one line for each message.

Defined results: null text counts as empty. Of several results for one identifier, the first turn (then
the smallest content) is linked and the others are ``orphan``; of several calls with one identifier the
first is linked to. A null identifier links with nothing. Arguments that are not a JSON object are invalid. Repeated rows
are kept. Very long texts are one string each and are whole. Extra columns are not read. An empty table gives an
empty table.

The query over ``conversations``, which has plain turns: every user turn is taken as a call of the tool
``reply`` with arguments {"n": turn, "text": text} and identifier "turn", child of the user turn two
before it; an assistant turn is the result of the turn before it; system turns are plain messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, remove

#: Types and requirements of the arguments of each tool.
SCHEMAS = {
    "reply": {"required": ["n", "text"], "properties": {"n": "integer", "text": "string"}, "additional": False},
}
_IS = {
    "string": lambda v: v.rlike('^"'),
    "integer": lambda v: v.rlike("^-?(?:0|[1-9][0-9]*)(?:\\.0+)?$"),
    "number": lambda v: v.rlike("^-?[0-9]"),
    "boolean": lambda v: v.isin("true", "false"),
    "array": lambda v: v.rlike("^\\["),
    "object": lambda v: v.rlike("^\\{"),
    "null": lambda v: v == "null",
}


def raw_fields(json: Column) -> Column:
    """An object's fields as a map from name to the raw JSON of the value; null if it is no object."""
    variant = F.try_parse_json(json)
    fields = F.from_json(json, "map<string,variant>")
    is_object = F.schema_of_variant(variant).startswith("OBJECT")
    return F.when(is_object, F.transform_values(fields, lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))))


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def canonical(fields: Column) -> Column:
    """The JSON object of a map from name to raw JSON, keys in order, without spaces."""
    names = F.array_sort(F.map_keys(fields))
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda k: F.concat(quoted(k), F.lit(":"), F.element_at(fields, k))), ","), F.lit("}"))


def valid(tool: Column, fields: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether ``fields`` meet the schema of the tool; an unknown tool's never do."""
    out = F.lit(False)
    for name, schema in schemas.items():
        checks = [fields.isNotNull()]
        checks += [F.array_contains(F.map_keys(fields), k) for k in schema.get("required", [])]
        for key, kind in schema.get("properties", {}).items():
            value = F.try_element_at(fields, F.lit(key))
            checks.append(value.isNull() | _IS[kind](value))
        if not schema.get("additional", True):
            checks.append(F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))) == 0)
        ok = checks[0]
        for c in checks[1:]:
            ok = ok & c
        out = F.when(tool == name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def link(messages: DataFrame) -> DataFrame:
    """Adds ``linked``: whether a call has a result, or a result is its call's first.

    ``messages``: conv_id, turn, kind (call, result or message), call_id, parent_id, tool, payload.
    """
    keyed = messages.where(F.col("call_id").isNotNull())
    key = ["conv_id", "call_id"]
    first = F.min(F.struct("turn", "payload"))
    calls = keyed.where("kind = 'call'").groupBy(key).agg(F.min("turn").alias("call_turn"))
    results = keyed.where("kind = 'result'").groupBy(key).agg(first.alias("first"))
    pairs = calls.join(results, key).select(*key, "call_turn", F.col("first.turn").alias("result_turn"), F.col("first.payload").alias("result_payload"))
    out = messages.join(pairs, key, "left")
    is_call = (F.col("kind") == "call") & (F.col("turn") == F.col("call_turn"))
    is_result = (F.col("kind") == "result") & (F.col("turn") == F.col("result_turn")) & F.col("payload").eqNullSafe(F.col("result_payload"))
    return out.withColumn("linked", F.coalesce(is_call | is_result, F.lit(False))).drop("call_turn", "result_turn", "result_payload")


def levels(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the number of ancestors of each call; null on and below a cycle."""
    calls = messages.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min_by("parent_id", "turn").alias("up"))
    calls = materialize(calls, "calls")
    known = calls.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("known"))
    now = calls.join(known, ["conv_id", "up"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known"), 1).otherwise(0).alias("level"))
    now = materialize(now, "levels")
    total = now.count()
    doubled = 1
    while doubled < 2 * max(1, total):
        if now.where("up IS NOT NULL").isEmpty():
            break
        step = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("far"), F.col("level").alias("more"))
        new = now.join(step, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("far").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        new = materialize(new, "levels")
        remove(now)
        now, doubled = new, doubled * 2
    remove(calls)
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def format_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each message: its link, level, argument verdict and canonical JSON.

    Within a conversation, rows ordered by (level, turn) are a topological order.
    """
    messages = messages.select("conv_id", "turn", "kind", "call_id", "parent_id", "tool", "payload")
    found = link(messages).join(levels(messages), ["conv_id", "call_id"], "left")
    fields = F.when(F.col("kind") == "call", raw_fields(F.col("payload")))
    found = found.withColumn("fields", fields)
    content = F.when(F.col("kind") == "call", F.coalesce(canonical(F.col("fields")), quoted(F.col("payload")))).otherwise(quoted(F.col("payload")))
    status = (
        F.when(F.col("kind") == "message", "plain")
        .when((F.col("kind") == "call") & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("level").isNull(), "cyclic")
        .when(F.col("linked"), "linked")
        .when(F.col("kind") == "call", "unanswered")
        .otherwise("orphan")
    )
    body = [
        ("call_id", F.coalesce(quoted(F.col("call_id")), F.lit("null")), F.col("call_id").isNotNull()),
        ("content", content, F.lit(True)),
        ("role", quoted(F.col("kind")), F.lit(True)),
        ("tool", quoted(F.col("tool")), F.col("tool").isNotNull()),
        ("turn", F.col("turn").cast("string"), F.col("turn").isNotNull()),
    ]
    parts = F.array(*[F.when(there, F.concat(F.lit(f'"{name}":'), value)) for name, value, there in body])
    json = F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ","), F.lit("}"))
    return found.select(
        "conv_id",
        "turn",
        "kind",
        "call_id",
        F.coalesce(F.col("level"), F.lit(-1)).cast("long").alias("level"),
        status.alias("status"),
        F.when(F.col("kind") == "call", valid(F.col("tool"), F.col("fields"), schemas)).alias("valid"),
        json.alias("json"),
    )


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain turns as messages, by the rule above."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), kind.alias("kind"), text.alias("text"))
    return rows.select(
        "conv_id",
        "turn",
        "kind",
        F.when(F.col("kind") == "call", F.col("turn").cast("string")).when(F.col("kind") == "result", (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.when(F.col("kind") == "call", (F.col("turn") - 2).cast("string")).alias("parent_id"),
        F.when(F.col("kind") != "message", "reply").alias("tool"),
        F.when(F.col("kind") == "call", F.to_json(F.struct(F.col("text"), F.col("turn").alias("n")))).otherwise(F.col("text")).alias("payload"),
    )


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``."""
    return format_calls(from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_SQL = """
WITH m AS (
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, coalesce(text, '') AS text
    FROM conversations
), k AS (
    SELECT *, CASE kind WHEN 'call' THEN turn WHEN 'result' THEN turn - 1 END AS id,
        replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') AS esc
    FROM m
), calls AS (
    SELECT conv_id, id, min(turn) AS call_turn FROM k WHERE kind = 'call' GROUP BY ALL
), results AS (
    SELECT conv_id, id, min(struct_pack(turn := turn, text := text)) AS r FROM k WHERE kind = 'result' GROUP BY ALL
), starts AS (
    SELECT c.conv_id, c.id, c.id - 2 IN (SELECT x.id FROM calls x WHERE x.conv_id = c.conv_id) AS has_up FROM calls c
), runs AS (
    SELECT s.*, max(CASE WHEN NOT has_up THEN id END) OVER (PARTITION BY conv_id, id % 2 ORDER BY id) AS root FROM starts s
)
SELECT k.conv_id, k.turn, k.kind, CAST(k.id AS VARCHAR) AS call_id,
    CAST(coalesce((runs.id - runs.root) // 2, -1) AS BIGINT) AS level,
    CASE WHEN k.kind = 'message' THEN 'plain'
         WHEN k.kind = 'call' THEN CASE WHEN results.id IS NOT NULL AND k.turn = calls.call_turn THEN 'linked' ELSE 'unanswered' END
         WHEN calls.id IS NOT NULL AND k.turn = results.r.turn AND k.text = results.r.text THEN 'linked' ELSE 'orphan' END AS status,
    CASE WHEN k.kind = 'call' THEN true END AS valid,
    '{' || CASE WHEN k.id IS NOT NULL THEN '"call_id":"' || k.id || '",' ELSE '' END
        || '"content":' || CASE WHEN k.kind = 'call' THEN '{"n":' || k.turn || ',"text":"' || k.esc || '"}' ELSE '"' || k.esc || '"' END
        || ',"role":"' || k.kind || '"' || CASE WHEN k.kind <> 'message' THEN ',"tool":"reply"' ELSE '' END || ',"turn":' || k.turn || '}' AS json
FROM k LEFT JOIN calls ON k.conv_id = calls.conv_id AND k.id = calls.id
    LEFT JOIN results ON k.conv_id = results.conv_id AND k.id = results.id
    LEFT JOIN runs ON k.conv_id = runs.conv_id AND k.id = runs.id
"""
