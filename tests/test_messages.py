import json

from pyspark.sql import functions as F

from tunemill.operators import messages as M
from tunemill.operators import tools as T


def norm(spark, turns, field="messages"):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps({"sample": 1, field: turns})]))
    r = M.normalize(df).first()
    return [x.asDict() for x in r.messages] if r.messages else None


def test_dialects(spark):
    got = norm(spark, [{"from": "human", "value": "q"}, {"from": "GPT ", "value": "a"}], "conversations")
    assert [(m["role"], m["content"]) for m in got] == [("user", "q"), ("assistant", "a")]
    got = norm(spark, [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "think": "t"}], "dialogue")
    assert got[1]["content"] == "" and got[1]["reasoning_content"] == "t"
    got = norm(spark, [{"role": "assistant", "content": "", "reasoning_content": "r", "reasoning": "x", "function_call": {"name": "f"}}, {"role": "function", "content": "out", "name": "f"}])
    assert got[0]["reasoning_content"] == "r" and json.loads(got[0]["tool_calls"])[0]["function"]["name"] == "f"
    assert (got[1]["role"], got[1]["name"]) == ("tool", "f")
    assert norm(spark, [{"content": "no role"}]) is None
    assert norm(spark, [{"role": "user", "body": "only other key"}])[0]["content"] == "only other key"


def test_each_turn_tells_its_only_other_field(spark):
    got = norm(spark, [{"role": "user", "body": "one"}, {"role": "assistant", "speech": "two"}, {"role": "user", "body": "a", "speech": "b"}, {"role": "user", "content": "c", "body": "d"}])
    assert [m["content"] for m in got] == ["one", "two", "", "c"]


def test_an_empty_list_falls_through(spark):
    lines = [{"sample": 1, "messages": [], "dialogue": [{"role": "user", "content": "here"}]}, {"sample": 2, "messages": [{"role": "user", "content": "first"}], "dialogue": []}, {"sample": 3, "messages": [], "dialogue": None}]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in lines]))
    got = {r["sample"]: r.messages for r in M.normalize(df).collect()}
    assert got[1][0].content == "here" and got[2][0].content == "first" and got[3] is None


def spans(spark, turns):
    df = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(turns)], "conv_id long, turn long, role string, content string")
    return M.turn_spans(df, "conv_id")


CHAT = [("system", "answer in one word"), ("user", "name a river"), ("assistant", "Volga"), ("user", "and a lake"), ("assistant", "Baikal"), ("user", "a sea then"), ("assistant", "Azov")]


def test_masks(spark):
    s = spans(spark, CHAT)
    trained = lambda **k: [r.content for r in M.trained_turns(s, "conv_id", **k).filter("trained").orderBy("turn").collect()]
    assert trained() == ["Volga", "Baikal", "Azov"] and trained(last_only=True) == ["Azov"]
    rows = s.orderBy("turn").collect()
    assert rows[0].start == 0 and all(a.end == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[-1].end == rows[0].total
    assert M.labels(M.trained_turns(spans(spark, CHAT[:2]), "conv_id"), "conv_id").collect() == []
    w = {r.turn: r.weight for r in M.turn_weights(M.trained_turns(s, "conv_id"), "conv_id", "last_heavy").collect()}
    assert w[6] == 2 * w[2]


def test_truncation(spark):
    long = [(r, c + " word" * 60) for r, c in CHAT]
    kept = M.truncate_turns(spans(spark, long), "conv_id", 250).orderBy("turn").collect()
    assert [r.turn for r in kept] == [0, 1, 2] and kept[-1].end <= 250
    assert M.truncate_turns(spans(spark, long), "conv_id", 100).collect() == []
    assert M.truncate_turns(spans(spark, CHAT), "conv_id", 1000).count() == 7


def test_reasoning(spark):
    df = spark.createDataFrame([("<think>why</think>\n\nanswer", None), ("plain", None), ("answer", "given")], "c string, r string")
    a, b = M.split_reasoning(F.col("c"), F.col("r"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("why", "answer"), ("", "plain"), ("given", "answer")]
    assert [r[0] for r in df.select(M.strip_reasoning(F.col("c"))).collect()] == ["answer", "plain", "answer"]


TOOL = '{"type":"function","function":{"name":"read_file","parameters":{"properties":{"path":{"type":"string"}},"required":["path"]}}}'


def errors(spark, calls, tools=(TOOL,)):
    declared = T.registry(spark.createDataFrame([(1, i, t) for i, t in enumerate(tools)], "sample long, pos int, tool string"))
    c = spark.createDataFrame([(1, i, 0, n, a) for i, (n, a) in enumerate(calls)], "sample long, turn int, call int, name string, arguments string")
    return [(r.turn, r.error, r.detail) for r in T.call_errors(c, declared).orderBy("turn", "error").collect()]


def test_tool_calls(spark):
    calls = [("read_file", '{"path":"x"}'), ("nuke", "{}"), ("read_file", '{"path":"x","encoding":"u"}'), ("read_file", "{}"), ("read_file", "{bad"), ("read_file", "[1]")]
    assert errors(spark, calls) == [(1, "unknown_tool", "nuke"), (2, "unknown_param", "encoding"), (3, "missing_param", "path"), (4, "bad_json", "{bad"), (5, "bad_json", "[1]")]
    assert errors(spark, [("read_file", "{}")], (TOOL, '{"name":"read_file","parameters":{}}')) == []
    assert errors(spark, [("a", '{"k":1}')], ('{"name":"a","input_schema":{"properties":{"k":{}}}}',)) == []


def test_no_tools_means_valid(spark):
    declared = T.registry(spark.createDataFrame([], "sample long, pos int, tool string"))
    c = spark.createDataFrame([(1, 0, 0, "x", "{bad")], "sample long, turn int, call int, name string, arguments string")
    assert T.call_errors(c, declared).collect() == []
