import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunemill.llm import ranked

DOCS, ITEMS = "doc_id long, text string, score long, rank string", "item_id long, text string, doc_id string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, keep):
    held = [(i, words_of(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        found = []
        for i, w in held:
            score = 0
            for term in set(words_of(text)):
                df = sum(term in x for _, x in held)
                if tf := w.count(term):
                    m = 50 + 50 * len(w) * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:keep])]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, 0, "clash") for d in docs], DOCS), spark.createDataFrame([(*i, "clash") for i in items], ITEMS)


def sample(n=160):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "ÉTÉ", "The", "THE", "a1", "日本"]
    skewed = [w for k, w in enumerate(vocabulary) for _ in range(1 + 60 // (k + 1))]
    docs = [(i, rng.choice([" ", "-", "\x7f", "\n"]).join(rng.choice(skewed) for _ in range(rng.randrange(40)))) for i in range(n)]
    docs += [(i, "w3 w4 copy") for i in range(1000, 1060)]
    docs += [(None, "w1 w40"), (None, "w1 w40"), (5, docs[5][1]), (2000, None), (2001, ""), (2002, "?! ..."), (2003, "w50 the " * 20_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    return docs, [*items, (3, items[3][1]), (None, "w1 copy"), (50, None), (51, ""), (52, "unheard"), (53, "the THE The w50 w3 copy")]


@pytest.mark.parametrize("keep,parts,shard,block", [(50, 1, 1 << 24, 1 << 23), (3, 4, 300, 1 << 23), (7, 3, 2000, 100), (1, 2, 1, 60)])
def test_against_brute_force(spark, keep, parts, shard, block):
    docs, items = sample()
    d, i = tables(spark, docs, items)
    got = ranked.search(d.repartition(parts), i, keep=keep, shard_bytes=shard, query_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, keep)


def test_empty_tables(spark):
    docs, items = sample(5)
    d, i = tables(spark, docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.withColumn("text", F.lit(None).cast("string")), i), (d.limit(0), i.limit(0))):
        assert ranked.search(a, b).collect() == []


def test_max_score_probes_only_what_can_qualify():
    rng = np.random.default_rng(4)
    lists = [(np.sort(rng.choice(5000, n, replace=False)), rng.integers(1, top, n)) for n, top in ((4000, 5), (3000, 9), (60, 900), (20, 2000), (1, 3))]
    whole = np.zeros(5000, np.int64)
    for place, part in lists:
        whole[place] += part
    for least in (1, 10, 900, 2000, 2800, 10**6):
        at, got = ranked.max_score(lists, 5000, least)
        want = np.flatnonzero(whole >= least)
        order = np.argsort(at)
        assert at[order].tolist() == want.tolist() and got[order].tolist() == whole[want].tolist()
    assert ranked.max_score([], 10, 1)[0].tolist() == []


def test_ties_at_the_edge_go_by_id():
    best = ranked.Best(3)
    best.merge([9, 8, 7, 6, None], np.arange(5), np.full(5, 4))
    best.merge([1, 20], np.arange(2), np.array([4, 5]))
    assert [(-s, i) for s, _, i in best.rows] == [(5, 20), (4, 1), (4, 6)] and best.least() == 4


def test_a_hot_text_and_term(spark):
    docs = [(i, "hot words here" if i % 3 == 0 else f"u{i} hot") for i in range(3000)]
    d, i = tables(spark, docs, [(1, "hot words"), (2, "u7 hot"), (3, "here")])
    got = ranked.search(d.repartition(4), i, shard_bytes=4000).collect()
    mine = {k: [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.item_id == k] for k in (1, 2, 3)}
    assert mine[1] == mine[3] == list(range(0, 150, 3)) and mine[2] == [7]  # what all documents hold weighs nothing
