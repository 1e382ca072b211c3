"""Every stage of the pipeline, and run() as a whole, against plain Python over the same rows."""

import hashlib
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tunemill.llm import mixing, quality
from tunemill.session import written

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def plain(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def by_hand_exact(rows):
    last = {}
    for r in rows:
        last[r[1] or ""] = max(r[0], last.get(r[1] or "", r[0]))
    return [r for r in rows if r[0] == last[r[1] or ""]]


def by_hand_near(rows):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [r for i, r in enumerate(rows) if not sets[i] or r[0] == least[find(i)]]


def by_hand_encode(rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_run_against_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = plain(docs)
    good = {r.doc_id for r in quality.score_quality(docs, labels).filter("predicted = 1").collect()}
    kept = [r for r in rows if r[0] in good]
    first = written(STAGES["quality classifier"](spark, docs, DATA), "test-pipeline")
    assert Counter(plain(first)) == Counter(kept) and 0 < len(kept) < len(rows)

    second = written(STAGES["exact dedup"](spark, first, DATA), "test-pipeline")
    kept = by_hand_exact(kept)
    assert Counter(plain(second)) == Counter(kept)

    third = written(STAGES["n-gram Jaccard join"](spark, second, DATA), "test-pipeline")
    kept = by_hand_near(kept)
    assert Counter(plain(third)) == Counter(kept)

    taken = {r.doc_id: r for r in mixing.mix_plan(third)["taken"].collect()}
    kept = [r for r in kept for _ in range(-(-taken[r[0]].taken // max(1, taken[r[0]].size)))]
    fourth = written(STAGES["source mix"](spark, third, DATA), "test-pipeline")
    assert Counter(plain(fourth)) == Counter(kept)

    want = Counter(by_hand_encode(kept))
    got = corpus_pipeline.run(spark, DATA)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null ids, texts and sources, repeated rows, empty and very long texts, and columns whose names the stages use."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (1, text, "a"), (2, text, None), (None, text, "b"), (3, None, None), (4, "", "a"), (5, text + " eleven", "a"), (6, "w " * 200_000, "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in ("_id", "_digest", "_dropped", "_source", "_times", "_turn", "digest", "size", "row", "key", "predicted", "component_id", "keep_id")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, odd_rows, name):
    out = STAGES[name](spark, odd_rows, DATA)
    if name != "BPE encoding":
        assert out.columns == odd_rows.columns
    kept = Counter(r.doc_id for r in out.collect())
    if name == "quality classifier":
        scores = quality.score_quality(odd_rows, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 1").collect()
        assert set(kept) == {r.doc_id for r in scores}
    else:
        assert kept
    assert STAGES[name](spark, odd_rows.limit(0), DATA).count() == 0
    if name == "exact dedup":
        assert kept == Counter([2, 4, 5, 6])
