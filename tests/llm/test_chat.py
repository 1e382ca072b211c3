import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tunemill.llm import chat

BITS = ["[INST]", "[/INST]", "[\\INST]", "[\\\\/SYS]", "</s>", "<s>", "<\\/s>", "[", "<", "\\", "]", " ", "\n", "é😀", "ok", "[ROLE]", "[/ROLE]", "<|im_end|>", "<|\\im_sep|>", "<|", "|>", "im_start", "$0", ""]


def turns_of(rng, roles):
    return [(rng.choice(roles), "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(6))]


@pytest.mark.parametrize("template", [chat.INST, chat.IM])
def test_any_turns_come_back(spark, template):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", "[/ROLE]", "a</s>\n", "<|im_sep|>x"]
    data = [(i, turns_of(rng, roles)) for i in range(400)] + [(400, []), (401, None), (402, [(None, None), ("assistant", None)]), (403, [("assistant", "x[INST]" * 100_000)])]
    df = spark.createDataFrame(data, f"id long, turns {chat.TURNS}")
    made = chat.format_turns(df, "id", template)
    got = made.select("id", "formatted", "mask", chat.read_turns(F.col("formatted"), template).alias("t"), chat.read_loss(F.col("formatted"), F.col("mask"), template).alias("loss"))
    got = {r.id: r for r in got.collect()}
    for i, turns in data:
        if turns is None:
            assert got[i].formatted is None and got[i].mask is None
            continue
        want = [(a or "", b or "") for a, b in turns]
        assert [tuple(t) for t in got[i].t] == want
        assert got[i].loss == "".join(b for a, b in want if a == "assistant")
        assert sum(map(sum, got[i].mask)) == len(got[i].formatted)


def test_escapes_touch_control_strings_only(spark):
    texts = ["plain [x] <b> \\ text", "[INST]", "[\\INST]", "a</s>b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.INST.escaped(F.col("t"))).collect()]
    assert got == ["plain [x] <b> \\ text", "[\\INST]", "[\\\\INST]", "a<\\/s>b"]


RECORD = """struct<prompt:string, response:string, system:string, instruction:string, input:string, output:string,
    messages:array<struct<role:string,content:string>>, conversations:array<struct<from:string,value:string>>, meta:struct<tags:array<string>>>"""


def test_layouts_find_their_mapping(spark):
    names = ["prompt", "response", "system", "instruction", "input", "output", "messages", "conversations", "meta"]
    cases = [
        ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"response": ""}, "prompt", [("assistant", "")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"system": "s", "instruction": "i", "output": "o"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"messages": [("user", None), (None, "b")]}, "messages", [("user", ""), ("", "b")]),
        ({"messages": []}, "messages", []),
        ({"conversations": [("human", "q"), ("gpt", "a"), ("tool", "t")]}, "shared", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
        ({"prompt": "p", "output": "o"}, None, None),
        ({"prompt": "p", "messages": [("user", "x")]}, None, None),
        ({}, None, None),
        ({"prompt": "p", "meta": (["t"],)}, "prompt", [("user", "p")]),
    ]
    df = spark.createDataFrame([(i, tuple(c.get(n) for n in names), "clash") for i, (c, _, _) in enumerate(cases)], f"id long, record {RECORD}, turns string")
    got = {r.id: r for r in chat.canonical_turns(df, "id", "record", ignore=("meta",)).collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert got[i].mapping == name, i
        assert (got[i].turns if turns is None else [tuple(t) for t in got[i].turns]) == turns
    strict = chat.canonical_turns(df, "id", "record")
    assert strict.filter("id = 10").first().mapping is None
    assert chat.undeclared(strict).agg(F.sum("records")).first()[0] == 4
    assert chat.canonical_turns(df.limit(0), "id", "record").collect() == []


def test_fingerprint_is_of_sorted_paths(spark):
    df = spark.createDataFrame([((None, [("a", None)]),)], "record struct<z:string, list:array<struct<y:string,x:string>>>")
    got = df.select(chat.fingerprint(F.col("record"), df.schema["record"].dataType)).first()[0]
    assert got == hashlib.md5(b"list\nlist[]\nlist[].y").hexdigest()


def test_a_table_of_one_layout_and_own_mapping(spark):
    own = chat.Mapping("qa", (chat.One("user", ("q.text",)), chat.One("assistant", ("a", "b"))))
    df = spark.createDataFrame([(1, (("hi",), "x", "y")), (2, ((None,), None, "y"))], "id long, r struct<q:struct<text:string>,a:string,b:string>")
    got = [(r.mapping, [tuple(t) for t in r.turns or []]) for r in chat.canonical_turns(df, "id", "r", (own, *chat.MAPPINGS)).orderBy("id").collect()]
    assert got[0] == ("qa", [("user", "hi"), ("assistant", "x\n\ny")])
    assert got[1] == (None, [])  # q is there without a text: not the layout that was declared


def brute(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(b for a, b in turns if a == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_report_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(BITS) for _ in range(9))) for c in range(60) for t in range(rng.randrange(5))]
    rows += [(70, 0, "user", "q"), (70, 1, "assistant", "a"), (71, 0, "system", "s"), (71, 1, "user", "q"), (71, 2, "assistant", None), (72, 0, "human", "kept"), (72, 0, "gpt", "kept")]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (73, 0, "assistant", "same"), (73, 0, "assistant", "same"), (74, 0, "user", "long " * 200_000)]
    rows += [(75, i, "user" if i % 2 else "assistant", f"[INST]{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = chat.formatting_report(df)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows)
    assert chat.formatting_report(df.limit(0)).collect() == []


def test_no_python_workers(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.formatting_report(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
