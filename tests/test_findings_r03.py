"""Cases of the third round's findings."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tunemill import session
from tunemill.operators import scoring, stateful
from tunemill.plans import q_metrics, q_more, q_selection, q_streams, q_training
from tunemill.streaming import buffers, processors


def test_source_summary_rounds_as_its_sql(spark, tmp_path):
    # losses that leave the weights 0.11499999999999999, 0.39444999999999997 and 0.13224999999999998, and a best of 2.37585
    falls = {1: [1.0] + [2.0] * 7 + [0.5], 2: [1.0] + [2.0] * 3 + [0.5], 3: [1.0] + [2.0] * 7 + [0.5, 0.2], 4: [4.0, 2.37585]}
    falls[2] += [9.0] * 3 + [0.4, 0.3, 0.2, 0.1]
    rows = [(r, f"2024-01-01 00:00:{i:02d}", x - 50, i * 10 + r) for r, xs in falls.items() for i, x in enumerate(xs)]
    rows += [(r, f"2024-01-01 00:00:{i:02d}", x - 50, 1000 + i * 100 + r) for r in range(5, 99) for i, x in enumerate([5.0] + [6.0] * (r % 7) + [5.0 - 0.2 * k for k in range(1, r % 9)])]
    made = spark.createDataFrame(rows, "user_id long, at string, value double, event_id long")
    made.selectExpr("event_id", "cast(at as timestamp) AS ts", "user_id", "'x' AS event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for query, sql in ((q_more.source_summary, q_more.ORACLE_SQL["source_summary"]), (q_metrics.source_weight_fold, q_metrics.ORACLE_SQL["source_weight_fold"])):
        assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(db.execute(sql).fetchall())


def test_source_summary_rounds_doubles_as_they_are(spark):
    row = spark.createDataFrame([("a", 0.00015, 1.00005, 0, 0), ("b", 1.0, None, 1, 1)], "source string, weight double, best double, rises long, decays long")
    got = {r.source: r.detail for r in stateful.source_summary(row).collect()}
    assert "weight=0.0001 " in got["a"] and f"best={1.00005:.4f}," in got["a"] and "no eval" in got["b"]


def test_only_rare_tokens_are_shuffled(spark, monkeypatch):
    rows = [(i, f"the of of w{i} v{i % 30}") for i in range(60)] + [(60, ""), (61, None), (62, "lonely words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted(scoring.score(docs).collect())
    kept = {}

    def written(df, what, by=None):
        kept[what] = session.written(df, what, by)
        return kept[what]

    monkeypatch.setattr("tunemill.operators.scoring.written", written)
    for most in (2, 40, 0):
        monkeypatch.setattr("tunemill.session.BROADCAST_ROWS", most)
        assert sorted(scoring.score(docs).collect()) == near
        tokens = {r.token for r in kept["sample-tokens"].collect()} - {None}
        assert ("w7" in tokens, "the" in tokens, "v3" in tokens) == (True, most == 0, most < 40)
        assert kept["sample-tokens"].filter("token is not null").count() == {2: 122, 40: 62, 0: 242}[most]


#: Queries that score documents, by finding.
SCORED = (
    "classify_difficulty",  # F5
    "ppl_stats",  # F6
    "prepared_manifest",  # F7
    "select_curriculum",  # F8
    "select_flow",  # F9
    "select_hard_focus",  # F10
    "select_medium_focus",  # F11
    "select_random",  # F12
    "select_balanced",  # F13
    "select_optimal",  # F14
    "prepare_flagship",  # F15
    "score_unigram_ppl",  # F16
    "filter_reasons",  # F17
    "filter_samples",  # F18
    "filter_full_score",  # F19
)


@pytest.fixture(scope="module")
def scored_docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scored"))
    words = [f"v{k}" for k in range(30)]
    rows = [(i, " ".join(words + [f"w{i}"] + words[: i % 25]), "ab"[i % 2]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", SCORED)
def test_a_query_shuffles_rare_tokens_once(spark, scored_docs, monkeypatch, name):
    query, joins, tables = q_selection.QUERIES[name], [], []
    near = sorted(map(tuple, query(spark, scored_docs).collect()))
    join, write = scoring.hot_safe_join, session.written
    monkeypatch.setattr(scoring, "hot_safe_join", lambda left, *a, **k: joins.append((left, k.get("many"))) or join(left, *a, **k))
    monkeypatch.setattr(q_selection, "written", lambda df, what, by=None: tables.append(what) or write(df, what, by))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 40)
    assert sorted(map(tuple, query(spark, scored_docs).collect())) == near
    [(rare, hot)] = joins
    assert rare.count() == 400 and rare.filter("token not like 'w%'").isEmpty()  # 12 400 pairs of a document and a token
    assert hot is not None and hot.isEmpty() and tables.count("scores") == 1


def test_hot_rare_tokens_come_from_the_counts(spark, scored_docs, monkeypatch):
    docs = spark.read.parquet(f"{scored_docs}/documents.parquet")
    near = sorted(scoring.score(docs).collect())
    monkeypatch.setattr(session, "BROADCAST_ROWS", 5)
    for most in (0, 300, 10**6):
        monkeypatch.setattr(scoring, "HOT", most, raising=False)
        assert sorted(scoring.score(docs).collect()) == near


def test_band_neighbors_asks_for_every_vector(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 6)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, q_training.band_neighbors(spark, str(tmp_path)).collect()))
    assert [r[0] for r in got] == list(range(90)) and got == sorted(db.execute(q_training.ORACLE_SQL["band_neighbors"]).fetchall())


def test_a_stream_in_order_has_bounded_batches(spark, tmp_path, monkeypatch):
    rows = [(i if i % 9 else None, i % 5, float(i * 7 % 11)) for i in range(100)][::-1]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = {}
    for most in (1000, 30):
        monkeypatch.setattr(buffers, "BATCH_ROWS", most, raising=False)
        stream = buffers.in_order(spark.read.parquet(f"{tmp_path}/events.parquet"), "event_id", f"{tmp_path}/rows-{most}")
        folder = f"{tmp_path}/s-{most}"
        left = processors.run_once(buffers.shuffle_buffer(stream, 4, "event_id", 2), "append", folder, [], rocksdb=True)
        per_batch = [r["count"] for r in spark.read.parquet(f"{folder}/batches").groupBy("batch").count().collect()]
        assert max(per_batch) <= most and sum(per_batch) == 92
        rest = buffers.left_in_buffer(spark, folder)
        found[most] = sorted((r.shard, r.position) for r in left.unionByName(rest).collect())
        assert len(found[most]) == 100
    assert found[30] == found[1000]
    empty = buffers.in_order(spark.read.parquet(f"{tmp_path}/events.parquet").limit(0), "event_id", f"{tmp_path}/none")
    assert processors.run_once(buffers.shuffle_buffer(empty, 4, "event_id", 2), "append", f"{tmp_path}/s-none", [], rocksdb=True).count() == 0


def test_the_shuffled_events_come_in_batches(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("id AS event_id", "id % 3 AS user_id", "id * 0.5D AS value").write.parquet(f"{tmp_path}/events.parquet")
    folders, run_once = [], processors.run_once
    monkeypatch.setattr(processors, "run_once", lambda stream, mode, folder, *a, **k: folders.append(folder) or run_once(stream, mode, folder, *a, **k))
    monkeypatch.setattr(q_streams, "BUFFER", 5)
    whole = sorted(map(tuple, q_streams.stream_shuffle_buffer(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(buffers, "BATCH_ROWS", 50, raising=False)
    assert sorted(map(tuple, q_streams.stream_shuffle_buffer(spark, str(tmp_path)).collect())) == whole
    batches = spark.read.parquet(f"{folders[-1]}/batches").groupBy("batch").count().collect()
    assert len(batches) >= 4 and max(r["count"] for r in batches) <= 50


def _watch(monkeypatch):
    tables, joins, join = [], [], scoring.hot_safe_join
    monkeypatch.setattr(scoring, "written", lambda df, what, by=None: tables.append(what) or session.written(df, what, by))
    monkeypatch.setattr(scoring, "hot_safe_join", lambda *a, **k: joins.append(a[0]) or join(*a, **k))
    return tables, joins


@pytest.mark.parametrize("name", SCORED)
def test_a_query_of_many_tokens_shuffles_none(spark, scored_docs, monkeypatch, name):
    query = q_selection.QUERIES[name]
    near = sorted(map(tuple, query(spark, scored_docs).collect()))
    tables, joins = _watch(monkeypatch)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 40)  # 430 distinct tokens
    monkeypatch.setattr(scoring, "PACK_FROM", 40, raising=False)
    assert sorted(map(tuple, query(spark, scored_docs).collect())) == near
    assert not joins and "sample-tokens" not in tables


def test_looked_up_scores_are_those_of_the_join(spark, monkeypatch):
    made = [(f"d{i // 2}", f"The of of w{i} v{i % 30} x{i % 7}," + " of v3 " * (i % 5) + "y" * (i % 3), i % 9) for i in range(90)]
    docs = spark.createDataFrame([*made, ("e", "", 0), ("n", None, 1), ("l", "lonely words é", None)], "doc_id string, text string, p int")
    spaced = lambda t: F.transform(F.split(t, " "), lambda w: F.when(w != "of", w))
    longer = lambda counts: counts.withColumn("nll", F.length("token").cast("double") + F.col("c"))
    ways = [{}, {"prefix_col": "p"}, {"tokenizer": spaced}, {"scorer": longer}, {"limit": 3}]
    joined = [sorted(map(tuple, scoring.score(docs, **k).collect())) for k in ways]
    monkeypatch.setattr(scoring, "PACK_FROM", 10)
    monkeypatch.setattr(scoring, "LOOKUP_TOKENS", 5)
    _, joins = _watch(monkeypatch)
    for most in (1000, 12, 0):
        monkeypatch.setattr(scoring, "PACKED", most)
        joins.clear()
        assert [sorted(map(tuple, scoring.score(docs, **k).collect())) for k in ways] == joined
        assert bool(joins) == (most < 1000)


def test_no_two_tokens_share_a_key(spark, scored_docs, monkeypatch):
    docs, key, seeds = spark.read.parquet(f"{scored_docs}/documents.parquet"), scoring._key, set()
    near = sorted(scoring.score(docs).collect())
    monkeypatch.setattr(scoring, "PACK_FROM", 40)
    monkeypatch.setattr(scoring, "_key", lambda t, seed: seeds.add(seed) or (F.pmod(key(t, seed), F.lit(400)) if seed < 2 else key(t, seed)))
    assert sorted(scoring.score(docs).collect()) == near and max(seeds) == 2
