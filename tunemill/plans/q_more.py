"""Queries over label masks, batches, layers, memory and sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunemill.operators import inspection as I
from tunemill.operators import losses, packing, tools, tuning
from tunemill.operators import messages as G
from tunemill.operators import metrics as M
from tunemill.operators import stateful as S
from tunemill.operators.scoring import tokenize
from tunemill.plans import q_messages, q_metrics, q_training
from tunemill.plans.q_selection import table


def _sum(c):
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").alias("content"))


def _observing(spark, sf_dir):
    """Turns with each of the five kinds of marks, every second one not closed."""
    k = F.pmod("turn", F.lit(5))
    opening = F.element_at(F.array(*[F.lit(a) for a, _ in I.OBSERVED_MARKS]), (k + 1).cast("int"))
    closing = F.when(F.col("turn") % 2 == 0, F.element_at(F.array(*[F.lit(b) for _, b in I.OBSERVED_MARKS]), (k + 1).cast("int"))).otherwise("")
    return _turns(spark, sf_dir).withColumn("content", F.concat(F.lit("see "), opening, F.col("content"), closing, F.lit(" end")))


def observed_text(spark, sf_dir):
    parts = I.observed_text(F.col("content"))
    return _observing(spark, sf_dir).select("conv_id", "turn", F.size(parts).alias("parts"), F.md5(F.array_join(parts, "|")).alias("observed"))


def echo_markers(spark, sf_dir):
    """Labels of turns that are masked but for their observed parts."""
    labels = I.observed_labels(F.col("content"))
    return _observing(spark, sf_dir).select("conv_id", "turn", F.size(labels).alias("n"), _sum(labels).alias("label_sum"))


def strip_reasoning_labels(spark, sf_dir):
    labels = I.strip_reasoning_labels(F.col("content"))
    return q_messages._thinking(spark, sf_dir).select("conv_id", "turn", F.size(labels).alias("n"), _sum(labels).alias("label_sum"))


def cursor_spans(spark, sf_dir):
    """Spans of the turns' texts in another template's render, found by searching forward."""
    turns = G.gathered(_turns(spark, sf_dir), "conv_id")
    full = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("[["), m["role"], F.lit("]] "), m["content"], F.lit(" ;;\n"))), "")
    rows = turns.withColumn("full", full).withColumn("spans", I.cursor_spans(F.col("full"), F.transform("messages", lambda m: m["content"])))
    return rows.select("conv_id", F.posexplode("spans").alias("turn", "span")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def response_mask(spark, sf_dir):
    """Response tokens from prefix and inclusive lengths; a conversation without any reply has none."""
    spans = G.turn_spans(_turns(spark, sf_dir), "conv_id")
    reply = F.when(F.col("role") == "assistant", F.struct("start", "end"))
    rows = spans.groupBy("conv_id").agg(F.max("total").alias("n"), F.collect_list(reply).alias("spans"))
    mask = I.response_mask(F.col("n"), F.when(F.col("conv_id") % 7 != 0, F.col("spans")))
    return rows.select("conv_id", F.size(mask).alias("n"), F.size(F.filter(mask, lambda x: x)).alias("n_response"))


def _labelled(spark, sf_dir):
    label = F.when(F.col("event_id") % 5 < 2, F.lit(I.IGNORE)).otherwise(F.col("event_id"))
    return q_metrics._series(spark, sf_dir).select("run", F.col("step").alias("pos"), label.alias("label"))


def label_transitions(spark, sf_dir):
    return I.transitions(_labelled(spark, sf_dir), "run")


def label_shares(spark, sf_dir):
    return I.label_shares(_labelled(spark, sf_dir), "run")


def collate_by_budget(spark, sf_dir):
    ids = F.transform(tokenize(F.col("text")), lambda t: F.length(t).cast("bigint"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 4").alias("batch"), ids.alias("input_ids")).withColumn("labels", F.col("input_ids"))
    return packing.collate_by_budget(rows, ["batch"], "doc_id").select("doc_id", "place", F.size("input_ids").alias("width"), _sum(F.col("labels")).alias("label_sum"))


def row_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    parts = [packing.row_shard(docs, "doc_id", 1, 4).withColumn("kind", F.lit("strided")), packing.row_shard(docs, "doc_id", 2, 3, contiguous=True).withColumn("kind", F.lit("contiguous"))]
    return parts[0].unionByName(parts[1]).select("kind", "doc_id", "place")


def resume_skip(spark, sf_dir):
    rows = q_metrics._series(spark, sf_dir).select("run", F.expr("step div 8").alias("epoch"), (F.col("step") % 8).alias("batch"))
    return packing.resume_from(rows, 3, start_epoch=1).groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("first"))


def eval_batches(spark, sf_dir):
    rows = packing.eval_batches(q_training._seqs(spark, sf_dir), 200, "seq_id")
    return rows.select("seq_id", "length", "place", "batch")


def position_sample(spark, sf_dir):
    rows = q_metrics._series(spark, sf_dir).select(F.col("event_type").alias("batch"), "run", "step", "value")
    return packing.position_sample(rows, "batch", ["run", "step"]).select("batch", "run", "step")


def called_counts(spark, sf_dir):
    return tools.called_counts(q_messages._tools(spark, sf_dir)[1])


def first_errors(spark, sf_dir):
    _, calls, declared = q_messages._tools(spark, sf_dir)
    return tools.first_errors(tools.call_errors(calls, declared), 50).select("place", "sample", "turn", "error", "truncated")


def noise_scale_losses(spark, sf_dir):
    """Gradient norms of some runs only; the others fall back to their last losses."""
    rows = q_metrics._series(spark, sf_dir)
    norms = rows.withColumn("value", F.when((F.col("run") % 3 == 0) | (F.col("step") == 1), F.col("value")))
    return M.noise_scale(norms, losses=rows).select("run", "n", F.round("noise_scale", 5).alias("noise_scale"))


def timing_averages(spark, sf_dir):
    rows = q_metrics._series(spark, sf_dir).withColumns({"forward": F.col("value"), "backward": F.col("value") * 2})
    out = M.timing_averages(rows, ["forward", "backward"], 10)
    return out.select("run", "n", F.round("forward", 5).alias("forward"), F.round("backward", 5).alias("backward"))


def tiered_metrics(spark, sf_dir):
    rows = q_metrics._series(spark, sf_dir).withColumn("step", F.col("step") - 1)
    due = rows.select("run", F.explode(M.tiers(F.col("step"), 5, 20)).alias("tier"), M.evaluation_due(F.col("step"), 7).cast("int").alias("due"))
    return due.groupBy("run", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("due").alias("evaluations"))


def gradient_weight_ratio(spark, sf_dir):
    series = q_metrics._series(spark, sf_dir)
    name = F.when(F.col("run") % 13 == 12, "lm_head.weight").otherwise(F.concat(F.lit("model.layers."), F.col("run") % 13, F.lit(".w"), F.col("run")))
    per = series.groupBy("run").agg(F.max_by("value", "step").alias("g"), F.min_by("value", "step").alias("w")).withColumn("name", F.concat(name, F.lit("."), F.col("run")))
    out = M.gradient_weight_ratio(per.select("name", F.col("w").alias("norm")), per.select("name", F.when(F.col("run") % 13 != 5, F.col("g")).alias("norm")))
    return out.select("layer", F.round("ratio", 6).alias("ratio"))


def stable_ranks(spark, sf_dir):
    """The vectors of a label are the rows of its matrix."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return M.stable_ranks(rows, "label", "vec_id", "embedding").withColumn("stable_rank", F.round("stable_rank", 5))


def evaluation_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("batch"), (F.abs("value") / 100).alias("loss"), (F.col("event_id") % 50 + 1).alias("tokens"), (F.col("event_id") % 7).alias("hits"))
    name = lambda df, n: df.select(F.lit(n).alias("part"), F.round("loss", 6).alias("loss"), F.round("ppl", 5).alias("ppl"), "tokens", F.round("accuracy", 6).alias("accuracy"))
    whole, head, none = (M.evaluation(e), M.evaluation(e, "batch", 5), M.evaluation(e.filter("batch < 0")))
    return name(whole, "all").unionByName(name(head, "first")).unionByName(name(none, "none").withColumn("loss", F.lit(-1.0)))


def source_summary(spark, sf_dir):
    return S.source_summary(q_metrics.source_weight_fold(spark, sf_dir), "run")


def behaviour_signals(spark, sf_dir):
    return S.behaviour_signals(q_metrics._holed(spark, sf_dir), factor=1.5)


def memory_estimate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.selectExpr(*[f"{v} AS {k}" for k, v in _RUN.items()])
    out = tuning.memory_estimate(runs)
    return out.select("event_id", "params", *[F.round(c, 4).alias(c) for c in ("optimizer_gb", "gradient_gb", "activation_gb", "loss_gb", "total_gb")], "fits")


_RUN = {
    "event_id": "event_id", "hidden": "(event_id % 8 + 1) * 512", "layers": "event_id % 40 + 1", "heads": "event_id % 32 + 1", "intermediate": "(event_id % 8 + 1) * 1376", "vocab": "32000 + event_id % 5 * 24000",
    "seq_len": "1024 * (event_id % 16 + 1)", "batch": "event_id % 4 + 1", "optimizer": "CASE event_id % 4 WHEN 0 THEN 'adamw' WHEN 1 THEN 'muon' WHEN 2 THEN 'lion8bit' ELSE 'other' END", "freeze": "event_id % 3 = 0",
    "release": "event_id % 5 = 0", "accumulation": "event_id % 2 + 1", "checkpointing": "CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'selective' ELSE 'full' END", "selective_diff": "event_id % 7 = 0",
    "loss_chunks": "event_id % 3 * 4", "device_gb": "80.0D",
}


def ablation_order(spark, sf_dir):
    rows = q_metrics._holed(spark, sf_dir).groupBy("run").agg(F.max_by("value", "step").alias("val_loss"))
    out = tuning.ablation_order(rows, name="run").filter(~F.isnan("val_loss") & (F.abs("val_loss") < float("inf")))
    return out.select("run", "place", F.round("val_loss", 4).alias("val_loss"))


def objective_names(spark, sf_dir):
    flags = {n: F.col("event_id") % (i + 3) == 0 for i, n in enumerate(losses.OBJECTIVES)}
    rows = table(spark, sf_dir, "events").select(losses.objective(flags).alias("objective"), losses.generalization_gap(F.col("value"), F.col("value") * 2).alias("gap"))
    return rows.groupBy("objective").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 5).alias("gap"))


def flat_cosine(spark, sf_dir):
    """Cosine of the flattened pairs of neighbouring vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    w = Window.partitionBy(F.expr("vec_id div 4")).orderBy("vec_id")
    four = v.withColumns({f"v{i}": F.lead("v", i).over(w) for i in (1, 2, 3)}).filter("v3 is not null")
    return four.select("vec_id", F.round(losses.flat_cosine(F.array("v", "v1"), F.array("v2", "v3")), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    observed_text, echo_markers, strip_reasoning_labels, cursor_spans, response_mask, label_transitions, label_shares, collate_by_budget, row_shards, resume_skip, eval_batches, position_sample, called_counts,
    first_errors, noise_scale_losses, timing_averages, tiered_metrics, gradient_weight_ratio, stable_ranks, evaluation_report, source_summary, behaviour_signals, memory_estimate, ablation_order, objective_names,
    flat_cosine,
)}

_S, _H = q_metrics._S, q_metrics._H
_MARKS = "[" + ", ".join("{'a': '" + a.replace("\n", "' || chr(10) || '") + f"', 'b': '{b}'" + "}" for a, b in I.OBSERVED_MARKS) + "]"
_OBS = f"""o AS (SELECT conv_id, turn, text, {_MARKS}[turn % 5 + 1] AS m, 'see ' || m['a'] || text || CASE WHEN turn % 2 = 0 THEN m['b'] ELSE '' END || ' end' AS content,
        CASE WHEN turn % 2 = 0 THEN text ELSE text || ' end' END AS seen FROM conversations)"""
_TOKENS = r"regexp_extract_all({0}, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')"
_LEN = "coalesce(list_sum(list_transform({0}, lambda t: length(t))), 0)"
ORACLE_SQL = {
    "observed_text": f"WITH {_OBS} SELECT conv_id, turn, 1 AS parts, md5(seen) AS observed FROM o",
    "echo_markers": f"""WITH {_OBS}, t AS (SELECT conv_id, turn, {_TOKENS.format('content')} AS a, {_TOKENS.format('seen')} AS i FROM o)
        SELECT conv_id, turn, cast(len(a) AS int) AS n, cast({_LEN.format('i')} - 100 * (len(a) - len(i)) AS bigint) AS label_sum FROM t""",
    "strip_reasoning_labels": f"""WITH {q_messages._THINK}, k AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS a, CASE WHEN turn % 2 = 1 THEN {_TOKENS.format("'<think>' || substr(text, 1, 20) || '</think>'")} ELSE [] END AS i FROM th)
        SELECT conv_id, turn, cast(len(a) + len(i) AS int) AS n, cast({_LEN.format('a')} - 100 * len(i) AS bigint) AS label_sum FROM k""",
    "cursor_spans": """WITH RECURSIVE f AS (SELECT conv_id, string_agg('[[' || role || ']] ' || text || ' ;;' || chr(10), '' ORDER BY turn) AS full_ FROM conversations GROUP BY conv_id),
        p AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
        w AS (SELECT f.conv_id, -1::bigint AS i, 0::bigint AS pos, -1::bigint AS s, -1::bigint AS e FROM f UNION ALL
              SELECT conv_id, i, CASE WHEN k > 0 AND n > 0 THEN pos + k - 1 + n ELSE pos END, CASE WHEN k > 0 AND n > 0 THEN pos + k - 1 ELSE -1 END, CASE WHEN k > 0 AND n > 0 THEN pos + k - 1 + n ELSE -1 END
              FROM (SELECT w.conv_id, p.i, w.pos, instr(substr(f.full_, w.pos + 1), p.text) AS k, length(p.text) AS n FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1 JOIN f ON f.conv_id = w.conv_id) q)
        SELECT conv_id, i AS turn, cast(s AS int) AS start, cast(e AS int) AS "end" FROM w WHERE i >= 0""",
    "response_mask": f"""WITH {q_messages._spans_sql()}, c AS (SELECT conv_id, max(total) AS n, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS r FROM s GROUP BY conv_id)
        SELECT conv_id, cast(n AS int) AS n, cast(CASE WHEN conv_id % 7 = 0 THEN n - greatest(1, floor(n * 0.4::double)) ELSE r END AS int) AS n_response FROM c""",
    "label_transitions": f"""WITH {_S}, t AS (SELECT run, step AS pos, event_id % 5 >= 2 AS t FROM s), b AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY run ORDER BY pos), false) AS b FROM t)
        SELECT run, pos, CASE WHEN t THEN 'train' ELSE 'mask' END AS "to" FROM b WHERE t <> b QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos) <= 20""",
    "label_shares": f"WITH {_S} SELECT run, count(*) AS n_tokens, count(*) FILTER (event_id % 5 >= 2) AS n_trained, round(count(*) FILTER (event_id % 5 >= 2) * 100 / count(*), 1) AS percent FROM s GROUP BY run",
    "collate_by_budget": f"""WITH t AS (SELECT doc_id, doc_id // 4 AS b, {q_training._TOKS} AS ls FROM documents), w AS (SELECT *, max(len(ls)) OVER (PARTITION BY b) AS width FROM t)
        SELECT doc_id, row_number() OVER (PARTITION BY b ORDER BY len(ls) DESC, doc_id) - 1 AS place, cast(width AS int) AS width, cast(coalesce(list_sum(ls), 0) - 100 * (width - len(ls)) AS bigint) AS label_sum FROM w""",
    "row_shards": """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
        SELECT 'strided' AS kind, doc_id, place FROM p WHERE place % 4 = 1 UNION ALL SELECT 'contiguous', doc_id, place FROM p WHERE place >= 2 * n // 3 AND place < n""",
    "resume_skip": f"WITH {_S}, e AS (SELECT run, step // 8 AS epoch, step % 8 AS batch FROM s) SELECT run, epoch, count(*) AS n, min(batch) AS first FROM e WHERE epoch > 1 OR (epoch = 1 AND batch >= 3) GROUP BY run, epoch",
    "eval_batches": f"WITH {q_training._SEQ}, h AS (SELECT seq_id, n FROM s WHERE r < 200), p AS (SELECT seq_id, n AS length, row_number() OVER (ORDER BY n, seq_id) - 1 AS place FROM h) SELECT *, place // 4 AS batch FROM p",
    "position_sample": f"WITH {_S} SELECT event_type AS batch, run, step FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('0:' || run || ':' || step), run, step) <= 64",
    "called_counts": "SELECT event_type AS tool, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS place FROM events GROUP BY 1",
    "first_errors": f"""WITH {q_messages._TOOLS}, e AS (SELECT *, row_number() OVER (ORDER BY sample, turn, call, error, detail) - 1 AS place, count(*) OVER () > 50 AS truncated FROM err WHERE error IS NOT NULL)
        SELECT place, sample, turn, error, truncated FROM e WHERE place < 50""",
    "noise_scale_losses": f"""WITH {_S}, g AS (SELECT run, CASE WHEN run % 3 = 0 OR step = 1 THEN v END AS v FROM s), a AS (SELECT run, count(v) AS n, avg(v) AS m, var_samp(v) AS d FROM g GROUP BY run),
        l AS (SELECT run, count(*) AS n, avg(v) AS m, var_samp(v) AS d FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 8) GROUP BY run),
        u AS (SELECT a.run, CASE WHEN a.n < 2 AND l.n >= 4 THEN l.n ELSE a.n END AS n, CASE WHEN a.n < 2 AND l.n >= 4 THEN l.m ELSE a.m END AS m, CASE WHEN a.n < 2 AND l.n >= 4 THEN l.d ELSE a.d END AS d FROM a JOIN l ON a.run = l.run)
        SELECT run, n, CASE WHEN n >= 2 AND m >= 1e-12 THEN round(n * d / (m * m), 5) END AS noise_scale FROM u""",
    "timing_averages": f"WITH {_S}, k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 10) SELECT run, count(*) AS n, round(avg(v), 5) AS forward, round(avg(v * 2), 5) AS backward FROM k GROUP BY run",
    "tiered_metrics": f"""WITH {_S}, x AS (SELECT run, step - 1 AS q FROM s), d AS (SELECT run, 1 AS tier, q FROM x UNION ALL SELECT run, 2, q FROM x WHERE q % 5 = 0 UNION ALL SELECT run, 3, q FROM x WHERE q % 20 = 0 AND q > 0)
        SELECT run, cast(tier AS int) AS tier, count(*) AS n, count(*) FILTER (q > 0 AND q % 7 = 0) AS evaluations FROM d GROUP BY run, tier""",
    "gradient_weight_ratio": f"""WITH {_S}, p AS (SELECT run, arg_max(v, step) AS g, arg_min(v, step) AS w FROM s GROUP BY run)
        SELECT CASE WHEN run % 13 = 12 THEN 'lm_head' ELSE 'layer_' || (run % 13) END AS layer, round(sqrt(sum(CASE WHEN run % 13 <> 5 THEN g * g END)) / sqrt(sum(w * w)), 6) AS ratio FROM p GROUP BY 1 HAVING count(CASE WHEN run % 13 <> 5 THEN g END) > 0""",
    "evaluation_report": """WITH e AS (SELECT event_id % 20 AS b, abs(value) / 100 AS l, event_id % 50 + 1 AS t, event_id % 7 AS h FROM events),
        a AS (SELECT 'all' AS part, sum(l) / sum(t) AS l, sum(t) AS t, sum(h) AS h FROM e UNION ALL SELECT 'first', sum(l) / sum(t), sum(t), sum(h) FROM e WHERE b < 5)
        SELECT part, round(l, 6) AS loss, round(least(exp(l), 1e6), 5) AS ppl, cast(t AS bigint) AS tokens, round(h / t, 6) AS accuracy FROM a UNION ALL SELECT 'none', -1.0, 1e6, 0, 0.0""",
    "source_summary": f"""WITH w AS ({q_metrics.ORACLE_SQL["source_weight_fold"]}), p AS (SELECT *, cast(round_even(weight * 100, 0) AS int) || '%' AS ratio FROM w)
        SELECT run, run || '=' || ratio || CASE WHEN rises = 0 THEN '↑' ELSE '↓' || rises END AS short,
            rpad(run::varchar, 20, ' ') || printf(': weight=%.4f (', weight) || ratio || ' of original), ' || CASE WHEN rises = 0 THEN 'improving' ELSE 'overfitting×' || rises END
            || printf(', best=%.4f', best) || ', decays=' || decays AS detail FROM p""",
    "behaviour_signals": f"""WITH RECURSIVE {_H}, f AS (SELECT *, NOT isfinite(v) AS bad FROM h), k AS (SELECT run, step, v, bad, row_number() OVER w AS i, avg(v) OVER (PARTITION BY run, bad ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM f WINDOW w AS (PARTITION BY run, bad ORDER BY step)),
        c AS (SELECT run, step, CASE WHEN bad THEN 2 WHEN i > 20 AND v > 1.5 * m THEN 1 WHEN i > 20 THEN 0 ELSE -1 END AS k FROM k),
        w AS (SELECT run, 0::bigint AS step, 0::bigint AS t, 0::bigint AS a, 0::bigint AS b FROM c WHERE step = 1 UNION ALL
              SELECT run, step, u, a + (k = 2 AND u >= 3)::int, b + ((k = 2 AND u < 3) OR (k = 1 AND u >= 5))::int
              FROM (SELECT w.run, c.step, c.k, CASE WHEN c.k < 0 THEN greatest(0, w.t - 1) WHEN c.k > 0 THEN w.t + 1 ELSE w.t END AS u, a, b FROM w JOIN c ON c.run = w.run AND c.step = w.step + 1) q)
        SELECT run, t AS troubles, a AS n_collapse, b AS n_reduce FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS z FROM w) WHERE z = 1""",
    "memory_estimate": "WITH r AS (SELECT " + ", ".join(f"{v.replace('80.0D', '80.0::double')} AS \"{k}\"" for k, v in _RUN.items()) + """ FROM events),
        p AS (SELECT *, layers * (4 * hidden * hidden + 3 * hidden * intermediate + 2 * hidden) + 2 * vocab * hidden AS params FROM r),
        q AS (SELECT *, CASE WHEN "freeze" THEN floor(params * 0.3::double) ELSE params END AS tr, CASE optimizer WHEN 'muon' THEN 4 WHEN 'lion8bit' THEN 2 ELSE 12 END AS ob FROM p),
        g AS (SELECT *, tr * ob / 1e9 AS o, CASE WHEN release AND accumulation <= 1 THEN 0 ELSE tr * 2 / 1e9 END AS gr, batch * seq_len * (hidden * 20 + heads * 128) / 1e9
                * CASE checkpointing WHEN 'none' THEN layers WHEN 'selective' THEN layers * 0.4::double ELSE 2 END * CASE WHEN selective_diff AND "freeze" THEN 0.3::double ELSE 1 END AS ac,
                batch * CASE WHEN loss_chunks > 0 THEN seq_len // loss_chunks ELSE seq_len END * vocab * 4 / 1e9 AS ls FROM q)
        SELECT event_id, cast(params AS bigint) AS params, round(o, 4) AS optimizer_gb, round(gr, 4) AS gradient_gb, round(ac, 4) AS activation_gb, round(ls, 4) AS loss_gb,
            round((params * 2 / 1e9 + o + gr + ac + ls) * 1.1::double, 4) AS total_gb, (params * 2 / 1e9 + o + gr + ac + ls) * 1.1::double <= 80 AS fits FROM g""",
    "ablation_order": f"""WITH {_H}, p AS (SELECT run, list(v ORDER BY step DESC)[1] AS l FROM h GROUP BY run), o AS (SELECT run, l, row_number() OVER (ORDER BY CASE WHEN isnan(l) THEN NULL ELSE l END NULLS LAST, run) - 1 AS place FROM p)
        SELECT run, place, round(l, 4) AS val_loss FROM o WHERE isfinite(l)""",
    "objective_names": """SELECT CASE WHEN event_id % 3 = 0 THEN 'pre_rl' WHEN event_id % 4 = 0 THEN 'deft' WHEN event_id % 5 = 0 THEN 'cadft' WHEN event_id % 6 = 0 THEN 'dft' WHEN event_id % 7 = 0 THEN 'info_sft' ELSE 'ce' END AS objective,
        count(*) AS n, round(avg(value * 2 - value), 5) AS gap FROM events GROUP BY 1""",
    "flat_cosine": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), f AS (SELECT vec_id, v || lead(v) OVER w AS a, lead(v, 2) OVER w || lead(v, 3) OVER w AS b FROM e WINDOW w AS (PARTITION BY vec_id // 4 ORDER BY vec_id))
        SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM f WHERE vec_id % 4 = 0 AND b IS NOT NULL""",
}
