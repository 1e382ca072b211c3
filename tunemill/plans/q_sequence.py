"""Queries of models and tokenizers that read whole sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunemill.operators import embedding, messages, sequence, subword
from tunemill.plans import q_messages
from tunemill.plans.q_selection import table


def score_sequence_ppl(spark, sf_dir):
    """Every document by a bigram model of the same documents."""
    docs = table(spark, sf_dir, "documents")
    return sequence.score_sequences(docs, sequence.class_bigrams(docs))


def tokenizer(name: str = "byte_bpe_50k.tiktoken", end_of_turn: int = 50256):
    """Gives a loader: the file's place is looked up where the tokenizer is loaded."""

    def load():
        import public_tokenizers

        return subword.RankTokenizer(public_tokenizers.path(name), public_tokenizers.PATTERN, end_of_turn)

    return load


def _labels(turns, how):
    """Numbers of tokens, and sums that any wrong token or label changes."""
    rows = subword.subword_labels(messages.gathered(turns, "conv_id"), tokenizer(), how=how)
    placed = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("conv_id", F.size("input_ids").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != subword.IGNORE)).alias("n_trained"), placed("input_ids").alias("id_sum"), placed("labels").alias("label_sum"))


def subword_mask(spark, sf_dir):
    return _labels(q_messages._turns(spark, sf_dir), subword.Masking())


def subword_last_turn(spark, sf_dir):
    return _labels(q_messages._turns(spark, sf_dir), subword.Masking(last_only=True))


def subword_reasoning(spark, sf_dir):
    """Every second turn thinks before it speaks; its thoughts carry no loss."""
    return _labels(q_messages._thinking(spark, sf_dir), subword.Masking(reasoning=False))


def embed_texts(spark, sf_dir):
    """Sums of the vectors of all documents; rounded to what any order of adding keeps."""
    rows = embedding.embed(table(spark, sf_dir, "documents"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    placed = F.transform("embedding", lambda x, i: x * (i + 1))
    return rows.select("doc_id", F.size(F.filter("embedding", lambda x: F.abs(x) > 1e-9)).alias("places"), F.round(total(F.transform("embedding", lambda x: x * x)), 6).alias("norm"), F.round(total(placed), 5).alias("checksum"))


QUERIES = {f.__name__: f for f in (score_sequence_ppl, embed_texts, subword_mask, subword_last_turn, subword_reasoning)}

ORACLE_SQL = {
    "score_sequence_ppl": r"""
        WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\s]'), lambda t: (31 * unicode(t) + 7 * unicode(right(t, 1)) + length(t)) % 509) AS cs FROM documents),
        x AS (SELECT doc_id, len(cs) AS length, cs, unnest(range(1, len(cs))) AS i FROM t),
        p AS (SELECT doc_id, length, i, cs[i] AS a, cs[i + 1] AS b FROM x),
        n AS (SELECT a, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY a) AS r FROM p GROUP BY a, b),
        s AS (SELECT doc_id, avg(-ln((n + 1) / (r + 509)::double)) AS a, avg(-ln((n + 1) / (r + 509)::double)) FILTER (i >= floor(length * (1 - 0.6::double))) AS r,
                     count(*) FILTER (i >= floor(length * (1 - 0.6::double))) AS rc FROM p JOIN n USING (a, b) GROUP BY doc_id)
        SELECT t.doc_id AS sample, CASE WHEN len(cs) >= 2 THEN len(cs) ELSE 0 END AS length, round(a, 4) AS avg_nll, round(coalesce(r, a), 4) AS response_nll, coalesce(rc, 0) AS response_token_count,
               CASE WHEN len(cs) >= 2 THEN round(exp(least(a, 20)), 2) ELSE 'inf'::double END AS ppl, CASE WHEN len(cs) >= 2 THEN round(exp(least(coalesce(r, a), 20)), 2) ELSE 'inf'::double END AS response_ppl
        FROM t LEFT JOIN s USING (doc_id)
    """,
    "embed_texts": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS token FROM documents),
        c AS (SELECT doc_id, token, sqrt(count(*)) AS n, cast('0x' || substr(md5('features:' || token), 1, 8) AS bigint) AS h FROM t GROUP BY doc_id, token),
        v AS (SELECT doc_id, h // 2 % 64 AS i, sum(CASE WHEN h % 2 = 1 THEN n ELSE -n END) AS x FROM c GROUP BY ALL),
        s AS (SELECT doc_id, count(*) FILTER (abs(x) > 1e-9) AS places, sqrt(sum(x * x)) AS norm, sum(x * (i + 1)) AS checksum FROM v GROUP BY doc_id)
        SELECT doc_id, cast(coalesce(places, 0) AS int) AS places, CASE WHEN coalesce(norm, 0) > 1e-9 THEN 1.0::double ELSE 0 END AS norm, coalesce(round(checksum / greatest(norm, 1e-12), 5), 0) AS checksum
        FROM documents LEFT JOIN s USING (doc_id)
    """,
}
