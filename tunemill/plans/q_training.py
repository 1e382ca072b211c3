"""Packing, mixing, ordering and loss queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunemill.operators import interleave, losses, ordering, packing
from tunemill.operators.scoring import tokenize
from tunemill.plans.q_selection import table

L = 512


def _seqs(spark, sf_dir):
    """Word counts as sequence lengths."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("length"))


def _stats(pieces):
    return pieces.groupBy("block").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.min("seq_id").alias("first_seq"), F.sum(F.col("seq_id") * F.col("n")).alias("checksum"))


def pack_sequential(spark, sf_dir):
    return _stats(packing.pack_sequential(_seqs(spark, sf_dir), L))


def pack_sorted(spark, sf_dir):
    return _stats(packing.pack_sorted(_seqs(spark, sf_dir), L))


def pack_positions(spark, sf_dir):
    """Blocks of word lengths with position ids that restart per document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    seqs = docs.select("seq_id", F.size("w").cast("bigint").alias("length"), F.transform("w", lambda x: F.length(x).cast("bigint")).alias("input_ids"))
    out = packing.blocks(packing.pack_sequential(seqs, L), "input_ids")
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("block", F.size("input_ids").alias("n"), add("input_ids").alias("id_sum"), add(F.transform("position_ids", lambda x: x.cast("bigint"))).alias("position_sum"))


def shift_labels(spark, sf_dir):
    labels = F.transform(tokenize(F.col("text")), lambda t: F.length(t).cast("bigint"))
    positions = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: ((i - 1) % 50).cast("bigint"))
    rows = table(spark, sf_dir, "documents").select("doc_id", labels.alias("labels")).filter("size(labels) > 0").withColumn("positions", positions)
    weighted = F.transform(packing.shift_labels(F.col("labels"), F.col("positions")), lambda x, i: x * (i + 1))
    return rows.select("doc_id", F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


def length_groups(spark, sf_dir):
    rows = packing.length_groups(_seqs(spark, sf_dir), 4, 64)
    return rows.groupBy("buffer", "batch_no", "turn").agg(F.count(F.lit(1)).alias("rows"), F.min("length").alias("shortest"), F.max("length").alias("longest")).withColumn("turn", F.col("turn").cast("bigint"))


def pad_efficiency(spark, sf_dir):
    rows = packing.length_groups(_seqs(spark, sf_dir), 4, 64).groupBy("buffer", "batch_no").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("rows"), packing.padded(F.max("length"), 64).alias("width"))
    return rows.agg(F.sum("tokens").alias("tokens"), F.sum(F.col("rows") * F.col("width")).alias("padded"), F.round(F.sum("tokens") / F.sum(F.col("rows") * F.col("width")), 4).alias("efficiency"))


def drop_last(spark, sf_dir):
    rows = packing.length_groups(_seqs(spark, sf_dir), 7, 64).filter("rows = 7")
    return rows.groupBy("buffer").agg(F.count_distinct("batch_no").alias("batches"), F.count(F.lit(1)).alias("rows"))


def greedy_batches(spark, sf_dir):
    return packing.greedy_batches(_seqs(spark, sf_dir), 16, 4096).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max("length").alias("longest"))


def collate_padding(spark, sf_dir):
    ids = F.transform(tokenize(F.col("text")), lambda t: F.length(t).cast("bigint"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 4").alias("batch"), ids.alias("input_ids"))
    rows = rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("bigint"))).withColumn("labels", F.col("input_ids"))
    out = packing.collate(rows, ["batch"], 16)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("doc_id", F.size("input_ids").alias("width"), add("attention_mask").alias("valid"), add("labels").alias("label_sum"))


def cp_shards(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at("embedding", i + 1).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(packing.sequence_shards(ids, 8)).alias("rank", "part"))
    return rows.select("vec_id", "rank", F.size("part").alias("n"), F.round(losses.total(F.col("part")), 6).alias("part_sum"))


def exact_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("rank", F.col("doc_id") % 3)
    return packing.total_steps(rows, 8, 3)


def sample_chunks(spark, sf_dir):
    return packing.sample_chunks(_seqs(spark, sf_dir), 128, 3).select("seq_id", "chunk", F.round("scale", 6).alias("scale"))


def shuffle_rows(spark, sf_dir):
    return packing.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5)


def pretrain_rows(spark, sf_dir):
    """Labels equal the ids; empty texts go."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(tokenize(F.col("text")), lambda t: F.length(t)).alias("ids")).filter("size(ids) > 0")
    return rows.select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0), lambda a, x: a + x).cast("bigint").alias("label_sum"))


_WEIGHTS = {"src0": 0.4, "src1": 0.3, "src2": 0.2, "src3": 0.1, "absent": 0.5}


def mix_weighted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return interleave.interleave(docs, _WEIGHTS).select("doc_id", "source", F.round("key", 6).alias("key"), "place")


def mix_replay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = interleave.replay(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), 0.1)
    return out.select("doc_id", "source", "place")


def band_neighbors(spark, sf_dir):
    """Every vector is a query and meets all."""
    found = ordering.band_neighbours(table(spark, sf_dir, "embeddings"), 0.3, 0.5)
    return found.select("vec_id", "in_band", "nearest", F.round("similarity", 6).alias("similarity"))


def tfp_order(spark, sf_dir):
    return ordering.similarity_order(table(spark, sf_dir, "embeddings"))


def tfp_chunked(spark, sf_dir):
    return ordering.similarity_order(table(spark, sf_dir, "embeddings"), chunk=100, seed=1)


def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return rows.select("vec_id", F.round(losses.total(losses.unit(F.col("v"))), 5).alias("unit_sum"))


def _logits(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 50").alias("batch"), F.expr("vec_id div 5").alias("seq"), "label", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))
    return losses.with_softmax(rows)


def _per_batch(name, loss):
    def query(spark, sf_dir):
        return _logits(spark, sf_dir).groupBy("batch").agg(F.round(F.sum(loss()), 5).alias("loss"), F.count(F.lit(1)).alias("valid"))

    query.__name__ = name
    return query


def token_entropy(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(losses.entropy(F.col("p")), 6).alias("entropy"))


def infosft_loss(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("w", losses.infosft_weight(F.col("p_label")))
    return rows.groupBy("batch").agg(F.round(F.sum(F.col("w") * F.col("ce")) / F.greatest(F.sum("w") / F.count(F.lit(1)), F.lit(1e-8)), 5).alias("loss"))


def cadft_loss(spark, sf_dir):
    return losses.cadft(_logits(spark, sf_dir), "seq", "batch").groupBy("batch").agg(F.round(F.sum("loss"), 5).alias("loss"))


def kl_anchor(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("flat", F.transform("logits", lambda x: x / 2)).withColumnRenamed("p", "base").drop("lse", "ce", "p_label")
    rows = losses.with_softmax(rows, "flat", p="current")
    return rows.select("vec_id", F.round(losses.kl(F.col("base"), F.col("current")), 6).alias("kl"))


def pre_rl_loss(spark, sf_dir):
    """Loss on tokens of low entropy; entropy of the others."""
    rows = _logits(spark, sf_dir).withColumn("h", losses.entropy(F.col("p"))).withColumn("masked", F.col("h") > 3.5)
    safe, masked = F.count(F.when(~F.col("masked"), 1)), F.count(F.when(F.col("masked"), 1))
    return rows.groupBy("batch").agg(
        F.round(F.coalesce(F.sum(F.when(~F.col("masked"), F.col("ce"))), F.lit(0.0)) / F.greatest(safe, F.lit(1)), 5).alias("loss"),
        F.round(F.coalesce(F.sum(F.when(F.col("masked"), F.col("h"))), F.lit(0.0)) / F.greatest(masked, F.lit(1)), 5).alias("entropy_bonus"), masked.alias("n_masked"),
    )


def top1_accuracy(spark, sf_dir):
    hit = F.array_position("logits", F.array_max("logits")) - 1 == F.col("label")
    rows = _logits(spark, sf_dir)
    return rows.agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.lit(1)).alias("tokens"), F.round(F.sum("ce") / F.count(F.lit(1)), 6).alias("loss"), F.round(losses.perplexity(F.sum("ce") / F.count(F.lit(1))), 4).alias("ppl"))


def slerp_merge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pairs = e.filter("vec_id % 2 = 0").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    return pairs.select("vec_id", F.round(losses.total(losses.slerp(F.col("v"), F.col("u"), 0.3)), 5).alias("merged_sum"), F.round(losses.dot(F.col("v"), F.col("u")) / (losses.norm(F.col("v")) * losses.norm(F.col("u"))), 6).alias("cosine"))


_LOSSES = {
    "ce_loss": lambda: F.col("ce"),
    "dft_loss": lambda: losses.dft(F.col("p_label"), F.col("ce")),
    "deft_loss": lambda: losses.deft_gate(F.col("p"), F.col("p_label")) * F.col("ce"),
}
QUERIES = {f.__name__: f for f in (
    pack_sequential, pack_sorted, pack_positions, shift_labels, length_groups, pad_efficiency, drop_last, greedy_batches, collate_padding, cp_shards, exact_steps, sample_chunks, shuffle_rows, pretrain_rows,
    mix_weighted, mix_replay, band_neighbors, tfp_order, tfp_chunked, l2_normalize, token_entropy, infosft_loss, cadft_loss, kl_anchor, pre_rl_loss, top1_accuracy, slerp_merge,
)} | {k: _per_batch(k, v) for k, v in _LOSSES.items()}

_SEQ = r"s AS (SELECT doc_id AS seq_id, cast(len(regexp_extract_all(text, '\S+')) AS bigint) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)"
_CUT = f"""c AS (SELECT *, unnest(range(cast(st // {L} AS bigint), cast((st + n - 1) // {L} + 1 AS bigint))) AS block FROM p WHERE n > 0),
    q AS (SELECT *, least(st + n, (block + 1) * {L}) - greatest(st, block * {L}) AS k FROM c)"""
_BLOCK = "SELECT block, cast(sum(k) AS bigint) AS tokens, count(*) AS pieces, min(seq_id) AS first_seq, cast(sum(seq_id * k) AS bigint) AS checksum FROM q GROUP BY block"
_GRP = "g AS (SELECT *, r // {1} AS buffer FROM s), h AS (SELECT *, (row_number() OVER (PARTITION BY buffer ORDER BY n, r) - 1) // {0} AS batch_no FROM g), b AS (SELECT buffer, batch_no, count(*) AS rows, min(n) AS shortest, max(n) AS longest, sum(n) AS tokens FROM h GROUP BY ALL)"
_SOFT = """e AS (SELECT vec_id, vec_id // 50 AS batch, vec_id // 5 AS seq, label, list_transform(embedding, lambda x: x::double * 10) AS z FROM embeddings),
    m AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) AS lse FROM e),
    t AS (SELECT *, lse - z[label + 1] AS ce, exp(z[label + 1] - lse) AS q, list_transform(z, lambda x: exp(x - lse)) AS p FROM m),
    u AS (SELECT *, -list_sum(list_transform(p, lambda x: x * ln(x))) AS h FROM t)"""
_PB = "WITH {0} SELECT batch, round(sum({1}), 5) AS loss, count(*) AS valid FROM u GROUP BY batch"
_TOKS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'), lambda t: length(t))"
ORACLE_SQL = {
    "pack_sequential": f"WITH {_SEQ}, p AS (SELECT seq_id, n, coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s), {_CUT} {_BLOCK}",
    "pack_sorted": f"WITH {_SEQ}, p AS (SELECT seq_id, least(n, {L}) AS n, coalesce(sum(least(n, {L})) OVER (ORDER BY r // 256, n, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM s), {_CUT} {_BLOCK}",
    "pack_positions": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS tok, unnest(range(len(regexp_extract_all(text, '\\S+')))) AS pos FROM documents),
        g AS (SELECT length(tok) AS v, pos, (row_number() OVER (ORDER BY doc_id, pos) - 1) // {L} AS block FROM w)
        SELECT block, cast(count(*) AS int) AS n, cast(sum(v) AS bigint) AS id_sum, cast(sum(pos) AS bigint) AS position_sum FROM g GROUP BY block""",
    "shift_labels": f"""WITH t AS (SELECT doc_id, {_TOKS} AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM t),
        y AS (SELECT doc_id, i, CASE WHEN lead(i) OVER w IS NULL OR (i + 1) % 50 = 0 THEN -100 ELSE lead(l) OVER w END AS l FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i))
        SELECT doc_id, cast(sum(l * (i + 1)) AS bigint) AS checksum FROM y GROUP BY doc_id""",
    "length_groups": f"WITH {_SEQ}, {_GRP.format(4, 64)} SELECT buffer, batch_no, row_number() OVER (PARTITION BY buffer ORDER BY rows < 4, md5('0:' || buffer || ':' || batch_no), batch_no) - 1 AS turn, rows, shortest, longest FROM b",
    "pad_efficiency": f"WITH {_SEQ}, {_GRP.format(4, 64)} SELECT cast(sum(tokens) AS bigint) AS tokens, cast(sum(rows * ceil(longest / 64) * 64) AS bigint) AS padded, round(sum(tokens) / sum(rows * ceil(longest / 64) * 64), 4) AS efficiency FROM b",
    "drop_last": f"WITH {_SEQ}, {_GRP.format(7, 63)} SELECT buffer, count(*) AS batches, cast(sum(rows) AS bigint) AS rows FROM b WHERE rows = 7 GROUP BY buffer",
    "greedy_batches": f"""WITH RECURSIVE {_SEQ}, o AS (SELECT n, row_number() OVER (ORDER BY n, seq_id) - 1 AS i FROM s),
        f AS (SELECT i, n, 0::bigint AS batch, 1 AS size FROM o WHERE i = 0 UNION ALL
              SELECT o.i, o.n, CASE WHEN size >= 16 OR (size + 1) * o.n > 4096 THEN batch + 1 ELSE batch END,
                     CASE WHEN size >= 16 OR (size + 1) * o.n > 4096 THEN 1 ELSE size + 1 END FROM f JOIN o ON o.i = f.i + 1)
        SELECT batch, count(*) AS rows, max(n) AS longest FROM f GROUP BY batch""",
    "collate_padding": f"""WITH t AS (SELECT doc_id, doc_id // 4 AS b, {_TOKS} AS ls FROM documents), w AS (SELECT *, cast(ceil(max(len(ls)) OVER (PARTITION BY b) / 16) * 16 AS int) AS width FROM t)
        SELECT doc_id, width, cast(len(ls) AS bigint) AS valid, cast(list_sum(ls) - 100 * (width - len(ls)) AS bigint) AS label_sum FROM w""",
    "cp_shards": "WITH x AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, cast(i // 8 AS int) AS rank, cast(count(*) AS int) AS n, round(sum(v), 6) AS part_sum FROM x GROUP BY vec_id, i // 8",
    "exact_steps": "SELECT cast(min(c // 8) * 3 AS bigint) AS total_steps FROM (SELECT count(*) AS c FROM documents GROUP BY doc_id % 3)",
    "sample_chunks": f"""WITH {_SEQ}, c AS (SELECT seq_id, cast(ceil(n / 128) AS bigint) AS chunks, unnest(range(cast(ceil(n / 128) AS bigint))) AS chunk FROM s WHERE n > 0)
        SELECT seq_id, chunk, round(chunks / least(chunks, 3), 6) AS scale FROM c QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY md5(seq_id || ':' || chunk || ':0'), chunk) <= 3""",
    "shuffle_rows": "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':5'), doc_id) - 1 AS place FROM documents",
    "pretrain_rows": f"WITH t AS (SELECT doc_id, {_TOKS} AS ls FROM documents) SELECT doc_id, cast(len(ls) AS int) AS n, cast(list_sum(ls) AS bigint) AS label_sum FROM t WHERE len(ls) > 0",
    "mix_weighted": """WITH w(source, w) AS (VALUES ('src0', 0.4::double), ('src1', 0.3), ('src2', 0.2), ('src3', 0.1)),
        k AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5) / w AS key FROM documents JOIN w USING (source)),
        c AS (SELECT min(m) AS stop FROM (SELECT max(key) AS m FROM k GROUP BY source))
        SELECT doc_id, source, round(key, 6) AS key, row_number() OVER (ORDER BY key, source, doc_id) - 1 AS place FROM k, c WHERE key <= stop""",
    "mix_replay": """WITH k AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'main' ELSE 'replay' END AS source, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 0.5) / CASE lang WHEN 'en' THEN 0.9::double ELSE 0.1::double END AS key FROM documents WHERE lang IN ('en', 'de')),
        c AS (SELECT min(m) AS stop FROM (SELECT max(key) AS m FROM k GROUP BY source))
        SELECT doc_id, source, row_number() OVER (ORDER BY key, source, doc_id) - 1 AS place FROM k, c WHERE key <= stop""",
    "band_neighbors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
        p AS (SELECT a.vec_id, b.vec_id AS o, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id)
        SELECT vec_id, count(*) FILTER (s BETWEEN 0.3 AND 0.5) AS in_band, (array_agg(o ORDER BY s DESC, o))[1] AS nearest, round(max(s), 6) AS similarity FROM p GROUP BY vec_id""",
    "l2_normalize": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double * 3) AS v FROM embeddings) SELECT vec_id, round(list_sum(v) / sqrt(list_dot_product(v, v)), 5) AS unit_sum FROM v",
    "token_entropy": f"WITH {_SOFT} SELECT vec_id, round(h, 6) AS entropy FROM u",
    "ce_loss": _PB.format(_SOFT, "ce"),
    "dft_loss": _PB.format(_SOFT, "q * ce"),
    "deft_loss": _PB.format(_SOFT, "pow(q, list_dot_product(p, p)) * ce"),
    "infosft_loss": f"""WITH {_SOFT}, w AS (SELECT *, least(greatest(q, 1e-6), 1 - 1e-6) AS c FROM u), x AS (SELECT *, c * greatest(0 - (ln(c) - ln(1 - c)), 0) AS w FROM w)
        SELECT batch, round(sum(w * ce) / greatest(sum(w) / count(*), 1e-8), 5) AS loss FROM x GROUP BY batch""",
    "cadft_loss": f"""WITH {_SOFT}, s AS (SELECT batch, seq, avg(ce) AS nll, sum(q * ce) AS d FROM u GROUP BY ALL),
        z AS (SELECT *, (nll - avg(nll) OVER w) / greatest(coalesce(stddev_samp(nll) OVER w, 0), 1e-6) AS z FROM s WINDOW w AS (PARTITION BY batch))
        SELECT batch, round(sum(exp(-greatest(z, 0)) * d), 5) AS loss FROM z GROUP BY batch""",
    "kl_anchor": f"""WITH {_SOFT}, b AS (SELECT vec_id, z, lse, p, ln(list_sum(list_transform(z, lambda x: exp(x / 2)))) AS l2 FROM u)
        SELECT vec_id, round(list_sum(list_transform(z, lambda x: exp(x - lse) * ((x - lse) - (x / 2 - l2)))), 6) AS kl FROM b""",
    "pre_rl_loss": f"WITH {_SOFT} SELECT batch, round(coalesce(sum(ce) FILTER (h <= 3.5), 0) / greatest(count(*) FILTER (h <= 3.5), 1), 5) AS loss, round(coalesce(sum(h) FILTER (h > 3.5), 0) / greatest(count(*) FILTER (h > 3.5), 1), 5) AS entropy_bonus, count(*) FILTER (h > 3.5) AS n_masked FROM u GROUP BY batch",
    "top1_accuracy": f"WITH {_SOFT} SELECT count(*) FILTER (list_position(z, list_max(z)) - 1 = label) AS hits, count(*) AS tokens, round(sum(ce) / count(*), 6) AS loss, round(exp(least(sum(ce) / count(*), 20)), 4) AS ppl FROM u",
    "slerp_merge": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings),
        p AS (SELECT a.vec_id, a.v, b.v AS u, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)
        SELECT vec_id, round(CASE WHEN abs(c) > 0.9999 THEN 0.7 * list_sum(v) + 0.3 * list_sum(u) ELSE sin(0.7 * acos(c)) / sin(acos(c)) * list_sum(v) + sin(0.3 * acos(c)) / sin(acos(c)) * list_sum(u) END, 5) AS merged_sum, round(c, 6) AS cosine FROM p""",
}
