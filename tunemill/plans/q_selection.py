"""Scoring and selection queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.functions.ranks import nth_values
from tunemill.operators import scoring, selection
from tunemill.session import spread, written

BUDGET, FLAGSHIP_BUDGET = 300, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows  # its texts are most of the work


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(scoring.score(table(spark, sf_dir, "documents")), "scores")  # most queries read it more than once


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(selection.classify_difficulty(_scored(spark, sf_dir)), "scored")


# The shared head of the SQL twins: the scored documents, their buckets, and what the filter keeps.
TOKENS = r"""
    tok AS (SELECT doc_id AS sample, regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]') AS ts, source FROM documents),
    len AS (SELECT sample, source, cast(len(ts) AS bigint) AS length FROM tok),
    ex AS (SELECT sample, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM tok),
    cnt AS (SELECT token, count(*) AS c, sum(count(*)) OVER () AS total FROM ex GROUP BY token),
    agg AS (SELECT sample, avg(-ln(c / total)) AS a, avg(-ln(c / total)) FILTER (pos >= floor(length * (1 - 0.6::double))) AS r,
                   count(*) FILTER (pos >= floor(length * (1 - 0.6::double))) AS rc
            FROM ex JOIN cnt USING (token) JOIN len USING (sample) GROUP BY sample),
    scored AS (SELECT sample, source, CASE WHEN length >= 2 THEN length ELSE 0 END AS length, round(a, 4) AS avg_nll, round(coalesce(r, a), 4) AS response_nll,
                      coalesce(rc, 0) AS response_token_count,
                      CASE WHEN length >= 2 THEN round(exp(least(a, 20)), 2) ELSE 'inf'::double END AS ppl,
                      CASE WHEN length >= 2 THEN round(exp(least(coalesce(r, a), 20)), 2) ELSE 'inf'::double END AS response_ppl
               FROM len LEFT JOIN agg USING (sample)),
    fin AS (SELECT response_ppl AS v, row_number() OVER (ORDER BY response_ppl) - 1 AS i, count(*) OVER () AS n FROM scored WHERE response_ppl < 'inf'::double),
    thr AS (SELECT min(v) FILTER (i = floor(n * 0.25)) AS e, min(v) FILTER (i = floor(n * 0.75)) AS h FROM fin),
    bucketed AS (SELECT s.*, CASE WHEN response_ppl <= e THEN 'easy' WHEN response_ppl >= h THEN 'hard' ELSE 'medium' END AS bucket FROM scored s, thr)
"""
REASON = "CASE WHEN response_ppl < 1.5 THEN 'too_easy' WHEN response_ppl > 500 THEN 'too_hard' WHEN length < 10 THEN 'too_short' WHEN length > 32768 THEN 'too_long' END"


def _strategy(name: str, budget: int = BUDGET):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return selection.select_by_budget(_bucketed(spark, sf_dir), budget, name).selectExpr(*_COLUMNS.get(name, ["sample", "bucket", "response_ppl"]))

    query.__name__ = f"select_{name}"
    return query


_COLUMNS = {"optimal": ["sample", "bucket", "response_ppl", "flow_weight"], "curriculum": ["sample", "response_ppl", "cast(score_rank as bigint) AS score_rank"], "flow": ["sample", "round(flow_weight, 6) AS flow_weight"]}


def score_unigram_ppl(spark, sf_dir):
    return _scored(spark, sf_dir)


def classify_difficulty(spark, sf_dir):
    return _bucketed(spark, sf_dir).select("sample", "response_ppl", "bucket")


def filter_reasons(spark, sf_dir):
    found = selection.filter_samples(_scored(spark, sf_dir))
    return found.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def filter_samples(spark, sf_dir):
    return selection.filter_samples(_scored(spark, sf_dir)).filter("reason is null").select("sample", "response_ppl", "length")


def filter_full_score(spark, sf_dir):
    found = selection.filter_samples(_scored(spark, sf_dir), use="full", max_ppl=0, min_length=40, max_length=1500)
    return found.select("sample", F.coalesce("reason", F.lit("kept")).alias("reason"))


def ppl_stats(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter(F.abs("response_ppl") < float("inf"))
    return nth_values(rows, "response_ppl", p_min=0.0, p50=0.5, p95=0.95).crossJoin(rows.agg(F.max("response_ppl").alias("p_max")))


def holdout_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"))
    return selection.holdout(docs, 50)


def max_samples_cap(spark, sf_dir):
    return selection.random_subset(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample")), 200, seed=7)


def source_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), "source")
    weights = docs.select("source").distinct().withColumn("weight", F.length("source").cast("double"))
    return selection.source_manifest(_bucketed(spark, sf_dir).join(docs, "sample"), weights)


def prepared_manifest(spark, sf_dir):
    return selection.prepared_manifest(_bucketed(spark, sf_dir))


def hes_scores(spark, sf_dir):
    values = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scoring.top_entropy_sum(values, 5.0).alias("hes"))
    return scoring.normalized_hes(rows).select("vec_id", F.round("hes", 5).alias("hes"), "hes_normalized")


def prepare_flagship(spark, sf_dir):
    """bucket -> filter -> hold out -> select, in that order."""
    rows = selection.filter_samples(_bucketed(spark, sf_dir), max_ppl=0).filter("reason is null").drop("reason")
    pool = written(selection.holdout(rows, 40), "pool").filter("not held_out").drop("held_out")
    return selection.select_by_budget(pool, FLAGSHIP_BUDGET, "optimal").select("sample", "bucket", "response_ppl", "flow_weight")


QUERIES = {
    **{f"select_{s}": _strategy(s) for s in ("optimal", "balanced", "medium_focus", "curriculum", "hard_focus", "flow", "random")},
    **{f.__name__: f for f in (score_unigram_ppl, classify_difficulty, filter_reasons, filter_samples, filter_full_score, ppl_stats, holdout_split, max_samples_cap, source_manifest, prepared_manifest, hes_scores, prepare_flagship)},
}



def _optimal_sql(b: int) -> str:
    e, m, h = int(b * 0.35), int(b * 0.5), int(b * 0.15)
    return f"""
    hard AS (SELECT *, row_number() OVER (ORDER BY response_ppl DESC, sample) - 1 AS k FROM pool WHERE bucket = 'hard'),
    placed AS (
        SELECT sample, bucket, response_ppl, CASE WHEN row_number() OVER (PARTITION BY bucket ORDER BY sample) <= CASE bucket WHEN 'easy' THEN {e} ELSE {m} END THEN 0
               WHEN bucket = 'medium' THEN 1 ELSE 2 END AS turn FROM pool WHERE bucket <> 'hard'
        UNION ALL SELECT sample, bucket, response_ppl, 0 FROM hard WHERE k < {b} - {e} - {m} - {h}
        UNION ALL SELECT sample, bucket, response_ppl, CASE WHEN row_number() OVER (ORDER BY response_ppl DESC, sample) <= {h} THEN 0 ELSE 3 END FROM hard WHERE k >= {b} - {e} - {m} - {h}),
    chosen AS (SELECT * FROM placed ORDER BY turn, sample LIMIT {b}),
    mid AS (SELECT min(v) AS tau FROM (SELECT response_ppl AS v, row_number() OVER (ORDER BY response_ppl) - 1 AS i, count(*) OVER () AS n FROM chosen) WHERE i >= n // 2)
    SELECT sample, bucket, response_ppl, round(exp(-response_ppl / greatest(tau, 1e-6)), 4) AS flow_weight FROM chosen, mid
"""


_MEDIAN = "(SELECT min(v) AS tau FROM (SELECT response_ppl AS v, row_number() OVER (ORDER BY response_ppl) - 1 AS i, count(*) OVER () AS n FROM bucketed) WHERE i >= n // 2) m"
ORACLE_SQL = {
    "score_unigram_ppl": f"WITH {TOKENS} SELECT sample, length, avg_nll, response_nll, response_token_count, ppl, response_ppl FROM scored",
    "classify_difficulty": f"WITH {TOKENS} SELECT sample, response_ppl, bucket FROM bucketed",
    "filter_reasons": f"WITH {TOKENS} SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM scored GROUP BY 1",
    "filter_samples": f"WITH {TOKENS} SELECT sample, response_ppl, length FROM scored WHERE {REASON} IS NULL",
    "filter_full_score": f"WITH {TOKENS} SELECT sample, CASE WHEN ppl < 1.5 THEN 'too_easy' WHEN length < 40 THEN 'too_short' WHEN length > 1500 THEN 'too_long' ELSE 'kept' END AS reason FROM scored",
    "ppl_stats": f"WITH {TOKENS} SELECT min(v) AS p_min, min(v) FILTER (i = n // 2) AS p50, min(v) FILTER (i = floor(n * 0.95)) AS p95, max(v) AS p_max FROM fin",
    "holdout_split": "SELECT doc_id AS sample, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) <= 50 AS held_out FROM documents",
    "max_samples_cap": "SELECT doc_id AS sample FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 200",
    "source_manifest": f"""WITH {TOKENS},
        v AS (SELECT source, response_ppl, row_number() OVER (PARTITION BY source ORDER BY response_ppl) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM bucketed),
        m AS (SELECT source, min(response_ppl) AS med FROM v WHERE i >= n // 2 GROUP BY source),
        w AS (SELECT source, length(source)::double AS w FROM documents GROUP BY source)
        SELECT source, count(*) AS num_samples, count(*) FILTER (bucket = 'easy') AS n_easy, count(*) FILTER (bucket = 'medium') AS n_medium, count(*) FILTER (bucket = 'hard') AS n_hard,
               round(any_value(med), 2) AS median_ppl, CASE WHEN any_value(med) < 5 THEN 'high' WHEN any_value(med) < 20 THEN 'medium' ELSE 'low' END AS overfit_risk,
               round(any_value(w) / (SELECT sum(w) FROM w), 4) AS normalized_weight,
               CASE WHEN any_value(med) < 5 THEN 0.5 WHEN any_value(med) < 20 THEN 1.0 ELSE 1.5 END::double AS epoch_multiplier
        FROM bucketed JOIN m USING (source) JOIN w USING (source) GROUP BY source""",
    "prepared_manifest": f"""WITH {TOKENS} SELECT count(*) AS num_samples, count(*) FILTER (bucket = 'easy') AS n_easy, count(*) FILTER (bucket = 'medium') AS n_medium,
        count(*) FILTER (bucket = 'hard') AS n_hard, round(min(response_ppl) FILTER (response_ppl < 'inf'::double), 2) AS min_ppl, round(max(response_ppl) FILTER (response_ppl < 'inf'::double), 2) AS max_ppl,
        round(avg(response_ppl) FILTER (response_ppl < 'inf'::double), 2) AS mean_ppl, (SELECT min(v) FROM fin WHERE i = n // 2) AS median_ppl FROM bucketed""",
    "hes_scores": """WITH h AS (SELECT vec_id, list_sum(list_slice(list_reverse_sort(list_transform(embedding, lambda x: abs(x::double))), 1, 3)) AS hes FROM embeddings),
        m AS (SELECT min(hes) FILTER (hes > 0) AS lo, max(hes) FILTER (hes > 0) AS hi FROM h)
        SELECT vec_id, round(hes, 5) AS hes, round(CASE WHEN hes <= 0 THEN 0 WHEN hi = lo THEN 1 ELSE (hes - lo) / (hi - lo) END, 4) AS hes_normalized FROM h, m""",
    "select_optimal": f"WITH {TOKENS}, pool AS (SELECT * FROM bucketed), {_optimal_sql(BUDGET)}",
    "prepare_flagship": f"""WITH {TOKENS}, kept AS (SELECT * FROM bucketed WHERE response_ppl >= 1.5 AND length BETWEEN 10 AND 32768),
        pool AS (SELECT * FROM kept QUALIFY row_number() OVER (ORDER BY md5(sample || ':42'), sample) > 40), {_optimal_sql(FLAGSHIP_BUDGET)}""",
    "select_balanced": f"""WITH {TOKENS}, r AS (SELECT sample, bucket, response_ppl, row_number() OVER (PARTITION BY bucket ORDER BY sample) - 1 AS k FROM bucketed),
        low AS (SELECT count(*) AS c FROM r WHERE bucket <> 'medium' AND k < 100), md AS (SELECT count(*) AS c FROM r WHERE bucket = 'medium')
        SELECT sample, bucket, response_ppl FROM r, low, md WHERE (bucket <> 'medium' AND k < 100) OR (bucket = 'medium' AND k < 100 + {BUDGET} - low.c - least(100, md.c))""",
    "select_medium_focus": f"WITH {TOKENS} SELECT sample, bucket, response_ppl FROM bucketed, {_MEDIAN} ORDER BY abs(response_ppl - tau), sample LIMIT {BUDGET}",
    "select_curriculum": f"WITH {TOKENS} SELECT sample, response_ppl, row_number() OVER (ORDER BY response_ppl, sample) - 1 AS score_rank FROM bucketed ORDER BY response_ppl, sample LIMIT {BUDGET}",
    "select_hard_focus": f"WITH {TOKENS} SELECT sample, bucket, response_ppl FROM bucketed ORDER BY response_ppl DESC, sample LIMIT {BUDGET}",
    "select_flow": f"WITH {TOKENS} SELECT sample, round(exp(-response_ppl / greatest(tau, 1e-6)), 6) AS flow_weight FROM bucketed, {_MEDIAN} ORDER BY exp(-response_ppl / greatest(tau, 1e-6)) DESC, sample LIMIT {BUDGET}",
    "select_random": f"WITH {TOKENS} SELECT sample, bucket, response_ppl FROM bucketed ORDER BY md5(sample || ':42'), sample LIMIT {BUDGET}",
}
