import os
import random
import re

import pytest

from tunemill.operators import messages, subword
from tunemill.plans.q_sequence import tokenizer

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.01"
HOW = [subword.Masking(), subword.Masking(last_only=True), subword.Masking(reasoning=False), subword.Masking(observe=True, last_only=True, reasoning=False), subword.Masking(roles=("user", "assistant"))]


def brute(turns, how):
    """Each byte of the render has a flag; a token has the flags of its bytes. Another library gives the tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(brute, "t"):
        brute.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        brute.t.encode_special_tokens = True
    last = max((i for i, (r, _) in enumerate(turns) if r in how.roles), default=None)
    ids, labels = [], []
    for i, (role, content) in enumerate(turns):
        head, body = f"<{role}>\n".encode(), content.encode()
        train = role in how.roles and (not how.last_only or i == last) or how.observe and role not in how.roles and role in messages.OBSERVED_ROLES
        flags = [train] * len(body)
        if not how.reasoning:
            for m in re.finditer(r"<think>.*?</think>[ \t\r\n]*", content, re.S):
                a, b = len(content[: m.start()].encode()), len(content[: m.end()].encode())
                flags[a:b] = [None] * (b - a)
        train = train and any(f for f in flags)
        flags = [False] * len(head) + flags
        at = 0
        for token in brute.t.encode((head + body).decode(), add_special_tokens=False).ids:
            text = brute.t.id_to_token(token)  # one character for each byte
            part = flags[at : at + len(text)]
            at += len(text)
            ids.append(token)
            labels.append(token if train and any(part) and None not in part else -100)
        assert at == len(flags)
        newline = brute.t.encode("\n", add_special_tokens=False).ids
        ids += [50256, *newline]
        labels += [50256, *newline] if train else [-100] * (1 + len(newline))
    return ids, labels


def check(spark, conversations, how):
    df = spark.createDataFrame([(i, [(r, c) for r, c in t], "clash") for i, t in enumerate(conversations)], "conv_id long, messages array<struct<role:string,content:string>>, labels string")
    got = {r.conv_id: (r.input_ids, r.labels) for r in subword.subword_labels(df.repartition(2), tokenizer(), how=how).collect()}
    for i, turns in enumerate(conversations):
        ids, labels = brute([(r or "", c or "") for r, c in turns], how)
        if all(x == -100 for x in labels):
            assert i not in got
        else:
            assert got[i] == (ids, labels), (i, turns)
    return got


@pytest.mark.parametrize("how", HOW)
def test_labels_against_bytes(spark, how):
    rng = random.Random(5)
    bits = ["ok", " word", "é", "😀", "日本", "\n", "  ", "<think>", "</think>", "\n\n", "<|endoftext|>", "</assistant>", "<user>\n", "12345", "'s", ""]
    roles = ["user", "assistant", "assistant", "system", "tool", "function", None]
    cases = [[(rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(7))] for _ in range(150)]
    cases += [[], [("user", "q"), ("assistant", None)], [("user", "q"), ("assistant", "<think>only</think>\n")], [("assistant", "<think>x</think>  a")], [("assistant", "word " * 30_000)]]
    got = check(spark, cases, how)
    assert (151 in got) == ("user" in how.roles)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("how", HOW[:3])
def test_labels_of_all_conversations(spark, how):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").withColumnRenamed("text", "content")
    rows = messages.gathered(turns, "conv_id").collect()
    got = check(spark, [[(m.role, m.content) for m in r.messages] for r in rows], how)
    assert len(got) > 90


def test_end_of_turn_is_trained_and_its_string_is_text(spark):
    got = check(spark, [[("user", "a<|endoftext|>b"), ("assistant", "c")]], subword.Masking())[0]
    assert got[0].count(50256) == 2 and [x for x in got[1] if x != -100][-2:] == [50256, 198] and got[1].count(50256) == 1


def test_span_sweep_against_each_pair():
    rng = random.Random(2)
    for _ in range(200):
        ends = sorted(rng.sample(range(1, 60), rng.randrange(1, 20)))
        starts = [0, *ends[:-1]]
        spans = [tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(rng.randrange(5))]
        want = [any(a < e and b > s for a, b in spans if a < b) for s, e in zip(starts, ends)]
        assert subword.tokens_of(*map(__import__("numpy").array, (starts, ends)), spans).tolist() == want


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, messages array<struct<role:string,content:string>>")
    assert subword.subword_labels(df, tokenizer()).collect() == []
