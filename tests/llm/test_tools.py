import json

from millrace.llm import tools as T

S = "conv_id long, turn long, kind string, call_id string, parent_id string, tool string, payload string, level int, status string"


def test_links_order_schemas_and_json(spark):
    call = lambda t, i, up, args, tool="reply", conv=1: (conv, t, "call", i, up, tool, args, 0, "")
    rows = [
        (1, 0, "message", None, None, None, 'hi "x"\n', 0, ""),
        call(1, "a", None, '{"text":"q\\u00e9","n":3}'),
        call(2, "b", "a", '{"n":"x","text":"t"}'),
        (1, 3, "result", "b", None, None, "out", 0, ""),
        (1, 4, "result", "b", None, None, "again", 0, ""),
        (1, 5, "result", "zz", None, None, None, 0, ""),
        call(6, "c", "b", "[1]"),
        call(7, "d", "e", "{}", "other"),
        call(8, "e", "d", None),
        call(9, "f", "e", '{"n":1,"text":"","z":[1,{"b":2,"a":1}]}'),
        call(10, None, None, '{"n":1,"text":"ok"}'),
        call(1, "a", None, '{"n":2.5,"text":"x"}', conv=None),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in T.format_calls(spark.createDataFrame(rows, S)).collect()}
    state = lambda t: (out[1, t]["status"], out[1, t]["level"], out[1, t]["valid"])
    assert [state(t) for t in range(11)] == [("plain", -1, None), ("unanswered", 0, True), ("linked", 1, False), ("linked", 1, None), ("orphan", 1, None), ("orphan", -1, None), ("unanswered", 2, False), ("cyclic", -1, False), ("cyclic", -1, False), ("cyclic", -1, False), ("unanswered", -1, True)]
    assert out[1, 1]["json"] == '{"call_id":"a","content":{"n":3,"text":"qé"},"role":"call","tool":"reply","turn":1}'
    assert json.loads(out[1, 9]["json"])["content"]["z"] == [1, {"a": 1, "b": 2}]
    assert json.loads(out[1, 0]["json"])["content"] == 'hi "x"\n' and out[None, 1]["status"] == "unanswered" and not out[None, 1]["valid"]


def test_long_chain(spark):
    rows = [(1, t, "call", str(t), str(t - 1), "reply", "{}", 0, "") for t in range(300)]
    got = T.levels(spark.createDataFrame(rows, S)).collect()
    assert {int(r["call_id"]): r["level"] for r in got} == {t: t for t in range(300)}


def test_query_and_edges(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    assert T.op6_tool_calls(spark, sf_dir).count() == n
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "x"), (1, 1, "assistant", ""), (2, None, "user", "t")], "conv_id long, turn long, role string, text string")
    assert T.format_calls(T.from_turns(odd)).count() == 5
    assert T.format_calls(T.from_turns(odd.limit(0))).count() == 0
