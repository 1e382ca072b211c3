"""Settings, model arithmetic and generic relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunemill import config
from tunemill.plans.q_selection import table

_FLAGS = ("gradient_release", "packing", "context_parallel", "mona", "schedule_free", "hyperball", "dft", "cadft", "deft", "info_sft", "preprocess_enabled", "pretokenize", "adaptive_sources", "curriculum", "adagc", "ema", "base_merge", "spike_detection", "pre_rl", "chunked_loss")
_VALUES = {
    "accumulation": "event_id % 3 + 1", "ga_ramp_start": "event_id % 2", "optimizer": "CASE WHEN event_id % 4 = 0 THEN 'muon' ELSE 'adamw' END", "n_sources": "event_id % 3", "max_grad_norm": "event_id % 2",
    "learning_rate": "value / 50000", "batch": "event_id % 300", "max_seq_length": "(event_id % 50) * 1024", "gradient_checkpointing": "CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'full' END", "warmup_ratio": "event_id % 5",
}


def _grid(flag) -> list[str]:
    return [f"{flag(k, n)} AS {n}" for k, n in enumerate(_FLAGS)] + [f"{e} AS {n}" for n, e in _VALUES.items()]


def config_rules(spark, sf_dir):
    """A grid of settings from the bits of each event's id, held against every rule."""
    runs = table(spark, sf_dir, "events").selectExpr("event_id", *_grid(lambda k, _: f"(event_id * 2654435761) % {k + 5} < 2"))
    out = config.check(runs)
    return out.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("errors", "warnings", "sanity")])


def config_compare(spark, sf_dir):
    """How often each rule breaks."""
    runs = table(spark, sf_dir, "events").selectExpr("event_id", *_grid(lambda k, _: f"(event_id * 2654435761) % {k + 5} < 2"))
    rules = F.concat("errors", "warnings", "sanity")
    return config.check(runs).select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def output_names(spark, sf_dir):
    """Source names as folder names, and the model family that a name holds."""
    name = F.concat(F.col("source"), F.lit("/a b "), F.expr("CASE doc_id % 4 WHEN 0 THEN 'Llama-3' WHEN 1 THEN 'qwen2' WHEN 2 THEN 'gemma' ELSE 'other' END"))
    low = F.lower(name)
    family = F.when(F.contains(low, F.lit("llama")), "llama").when(F.contains(low, F.lit("qwen")), "qwen").when(F.contains(low, F.lit("gemma")), "gemma").otherwise("unknown")
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(name, "/ ", "__").alias("folder"), family.alias("family"))


def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.max("k").alias("k_max"), F.count("k").alias("n"))


def semi_anti_join(spark, sf_dir):
    """Labelled and unlabelled documents by source."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda how, name: docs.join(labels, "doc_id", how).groupBy("source").agg(F.count(F.lit(1)).alias(name))
    both = count("left_semi", "labelled").join(count("left_anti", "unlabelled"), "source", "full")
    return both.select("source", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("unlabelled", F.lit(0)).alias("unlabelled"))


def lineitem_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


QUERIES = {f.__name__: f for f in (config_rules, config_compare, output_names, json_props, semi_anti_join, lineitem_summary)}

_RUNS = "runs AS (SELECT event_id, " + ", ".join(_grid(lambda k, _: f"(event_id * 2654435761) % {k + 5} < 2")) + " FROM events)"


def _names(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


ORACLE_SQL = {
    "config_rules": f"WITH {_RUNS} SELECT event_id, {_names(config.ERRORS)} AS errors, {_names(config.WARNINGS)} AS warnings, {_names(config.SANITY)} AS sanity FROM runs",
    "config_compare": f"WITH {_RUNS}, r AS (SELECT unnest(string_split(concat_ws(',', nullif({_names(config.ERRORS)}, ''), nullif({_names(config.WARNINGS)}, ''), nullif({_names(config.SANITY)}, '')), ',')) AS rule FROM runs) SELECT rule, count(*) AS n FROM r WHERE rule <> '' GROUP BY rule",
    "output_names": "SELECT doc_id, source || '_a_b_' || ['Llama-3', 'qwen2', 'gemma', 'other'][doc_id % 4 + 1] AS folder, ['llama', 'qwen', 'gemma', 'unknown'][doc_id % 4 + 1] AS family FROM documents",
    "json_props": "SELECT event_type, cast(sum(cast(props->>'k' AS bigint)) AS bigint) AS k_sum, max(cast(props->>'k' AS bigint)) AS k_max, count(props->>'k') AS n FROM events GROUP BY 1",
    "semi_anti_join": "SELECT source, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "lineitem_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
}
