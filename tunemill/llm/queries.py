"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunemill.llm import ann, bpe, centroids, chat, exact_dedup, jaccard, lm, mixing, quality, ranked, secrets, substrings, surrogates
from tunemill.session import spread


#: The registered query's key; a user passes a secret one to replace_private.
SURROGATE_KEY = "registered-query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def tokenizer_ranks(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))["taken"].select("doc_id", "size", "source_size", "target", "taken")


def op4_bwt_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), lambda doc_id: F.crc32(doc_id) % 7 == 2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op9_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_ranks(), with_ids=False).drop("ids")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    return chat.formatting_report(rows.union(more))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_ann": op1_hilbert_ann,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_low_discrepancy_mix": op3_low_discrepancy_mix,
    "op4_bwt_substrings": op4_bwt_substrings,
    "op5_backoff_lm": op5_backoff_lm,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pu_quality": op7_pu_quality,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe_chunks": op9_bpe_chunks,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_chat_format": op11_chat_format,
    "op12_centroids": op12_centroids,
    "op13_maxscore": op13_maxscore,
}

def _centroid_sql(rounds: int) -> str:
    """The rounds one after another, in integers."""
    away = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    ctes = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) AS bigint)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (SELECT n - 1 AS k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) AS n FROM k) WHERE n <= 16)""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := {away}, k := k)) AS near FROM k, c{i} GROUP BY row)")
        ctes.append(
            f"""m{i} AS (SELECT k, list(cast(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS bigint) ORDER BY i) AS c FROM (
                SELECT near.k AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY ALL) GROUP BY k)"""
        )
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    last = f"""SELECT vec_id, cast(near.k AS integer) AS cluster, cast(near.d AS bigint) AS distance, cast(sum(near.d) OVER (PARTITION BY near.k) AS bigint) AS cluster_inertia,
        cast(sum(near.d) OVER () AS bigint) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = near.k"""
    return "WITH " + ",\n".join(ctes) + "\n" + last


ORACLE_SQL: dict[str, str] = {
    "op3_low_discrepancy_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   cast('0x' || substr(md5('7:' || doc_id), 1, 15) AS bigint) AS point
            FROM documents),
        s0 AS (SELECT source, sum(size)::double AS n FROM d GROUP BY source),
        s1 AS (SELECT source, n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::double AS w,
                      2 * n AS cap, 1.5 * sum(n) OVER () AS total FROM s0),
        s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                      sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM s1),
        level AS (SELECT max((total - below) / above) AS level FROM s2),
        s3 AS (SELECT source, n, least(cap, w * level) AS target FROM s1, level),
        s4 AS (SELECT *, sum(target) OVER (ORDER BY source IS NULL, source ROWS UNBOUNDED PRECEDING) AS hi,
                      greatest(1, least(4096, cast(floor(sum(target) OVER ()) AS bigint) // (4096 * count(*) OVER ()))) AS block,
                      sum(target) OVER () AS words FROM s3),
        slots AS (SELECT i, (i % 2147483648) * 1327217885 % 2147483648 / 2147483648.0::double * words AS pos
                  FROM (SELECT DISTINCT words, block FROM s4), range(cast(ceil(words / block) AS bigint)) r(i)),
        ranked AS (SELECT source, block, n, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank
                   FROM slots JOIN s4 ON pos >= hi - target AND pos < hi),
        uses AS (SELECT source, rank % cast(ceil(n / block) AS bigint) AS b, count(*) AS uses FROM ranked
                 WHERE rank < 2 * cast(ceil(n / block) AS bigint) GROUP BY ALL),
        placed AS (SELECT doc_id, d.source, size, block,
                          coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY point, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
                   FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
        cut AS (SELECT doc_id, source, block, pos, size, unnest(range(cast(pos // block AS bigint), cast((pos + size - 1) // block + 1 AS bigint))) AS b
                FROM placed WHERE size > 0),
        got AS (SELECT doc_id, sum((least(pos + size, (cut.b + 1) * block) - greatest(pos, cut.b * block)) * uses) AS taken
                FROM cut JOIN uses ON cut.source IS NOT DISTINCT FROM uses.source AND cut.b = uses.b GROUP BY doc_id)
        SELECT d.doc_id, d.size, cast(s3.n AS bigint) AS source_size, s3.target, cast(coalesce(got.taken, 0) AS bigint) AS taken
        FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source LEFT JOIN got ON got.doc_id = d.doc_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(regexp_replace(regexp_replace(text, '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g'), '<(\\*/?s>)', '<\\\1', 'g'))
                        + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 13
                          ELSE 17 + length(regexp_replace(regexp_replace(role, '\[(\\*/?(INST|SYS|ROLE)\])', '[\\\1', 'g'), '<(\\*/?s>)', '<\\\1', 'g')) END AS n FROM c),
        g AS (SELECT conv_id, count(*) AS n_turns,
                     string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                     coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                     cast(sum(n) AS bigint) AS formatted_chars FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
    """,
    "op12_centroids": _centroid_sql(3),
    "op13_maxscore": r"""
        WITH t AS (
            SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        tf AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        len AS (SELECT row, sum(tf) AS n FROM tf GROUP BY row),
        whole AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS total FROM len),
        q AS (SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
        df AS (SELECT term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) AS bigint) AS w FROM tf, whole GROUP BY term),
        m AS (SELECT row, 50 + cast((50 * n * docs) // total AS bigint) AS m FROM len, whole),
        s AS (SELECT item, item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score
              FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, cast(rank AS integer) AS rank, doc_id, score FROM r WHERE rank <= 50
    """,
}
