"""Message, mask and tool-call queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunemill.operators import messages as M
from tunemill.operators import tools as T
from tunemill.plans.q_selection import table


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def _raw(spark, sf_dir):
    """Dialects by conversation: upper-case roles, share-style names, tool and function roles."""
    alias = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    name = F.when(F.col("conv_id") % 3 == 0, F.concat(F.upper("role"), F.lit(" "))).when(F.col("conv_id") % 3 == 1, alias).otherwise(F.when(F.col("turn") % 4 == 3, "function").otherwise(F.col("role")))
    return _turns(spark, sf_dir).withColumn("raw_role", name)


_RAW = """raw AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN upper(role) || ' ' WHEN conv_id % 3 = 1 THEN CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END
    ELSE CASE WHEN turn % 4 = 3 THEN 'function' ELSE role END END AS raw_role FROM conversations),
    norm AS (SELECT *, CASE lower(trim(raw_role)) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'function' THEN 'tool' ELSE lower(trim(raw_role)) END AS nrole FROM raw)"""


def normalize_roles(spark, sf_dir):
    return _raw(spark, sf_dir).select("conv_id", "turn", M.normal_role(F.col("raw_role")).alias("role"))


def normalize_sharegpt(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("item", F.struct("turn", F.col("raw_role").alias("from"), F.col("content").alias("value")))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("conversations"))
    rows = rows.withColumn("conversations", F.transform("conversations", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value"))))
    out = M.normalize(rows)
    return out.select("conv_id", F.size("messages").alias("n_turns"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(M.joined_contents(F.col("messages"))).alias("contents"))


def message_field_fallback(spark, sf_dir):
    """Even conversations under `messages`, odd ones under `dialogue`; the normaliser finds both."""
    rows = M.gathered(_turns(spark, sf_dir), "conv_id").withColumnRenamed("messages", "m")
    rows = rows.withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    rows = rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("m")).alias("messages"), F.when(F.col("conv_id") % 2 == 1, F.col("m")).alias("dialogue"))
    return M.normalize(rows).select("conv_id", F.size("messages").alias("n_turns"), F.md5(M.render(F.col("messages"))).alias("rendered"))


def normalize_reasoning(spark, sf_dir):
    """reasoning_content, then reasoning, then think; legacy function_call; name of tool turns."""
    part = F.substring("content", 1, 12)
    item = F.struct(
        "turn", F.col("raw_role").alias("role"), "content", F.when(F.col("turn") % 3 == 0, part).alias("reasoning_content"), F.when(F.col("turn") % 3 == 1, part).otherwise("").alias("reasoning"),
        F.when(F.col("turn") % 2 == 0, F.lit("t")).otherwise("").alias("think"), F.lit("n").alias("name"),
        F.when(F.col("turn") % 5 == 1, F.to_json(F.struct(F.lit("f").alias("name")))).alias("function_call"),
    )
    rows = _raw(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    fields = ("role", "content", "reasoning_content", "reasoning", "think", "name", "function_call")
    rows = rows.select("conv_id", F.transform("m", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("messages"))
    return M.turns_of(M.normalize(rows), "conv_id").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "reasoning_content", "name", "tool_calls")


def render_chatml(spark, sf_dir):
    return M.gathered(_turns(spark, sf_dir), "conv_id").select("conv_id", F.md5(M.render(F.col("messages"))).alias("rendered"), F.md5(M.joined_contents(F.col("messages"))).alias("joined"))


def _spans(spark, sf_dir):
    return M.turn_spans(_turns(spark, sf_dir), "conv_id")


def turn_token_spans(spark, sf_dir):
    return _spans(spark, sf_dir).select("conv_id", "turn", "start", "end", "total")


def assistant_mask_stats(spark, sf_dir):
    rows = M.labels(M.trained_turns(_spans(spark, sf_dir), "conv_id"), "conv_id")
    return rows.select("conv_id", "n_tokens", "n_trained", F.round(F.col("n_trained") / F.col("n_tokens"), 4).alias("ratio"))


def masking_report(spark, sf_dir):
    """Whole-dataset health of the masks: shares, and how many conversations have all or nothing masked."""
    rows = M.trained_turns(_spans(spark, sf_dir), "conv_id").groupBy("conv_id").agg(F.sum("n_tokens").alias("n"), F.coalesce(F.sum(F.when(F.col("trained"), F.col("n_tokens"))), F.lit(0)).alias("t"))
    return rows.agg(
        F.count(F.lit(1)).alias("samples"), F.sum("n").alias("tokens"), F.sum("t").alias("trained"), F.count(F.when(F.col("t") == 0, 1)).alias("all_masked"), F.count(F.when(F.col("t") == F.col("n"), 1)).alias("all_trained"),
        F.round(F.min(F.col("t") / F.col("n")), 4).alias("min_ratio"), F.round(F.max(F.col("t") / F.col("n")), 4).alias("max_ratio"), F.min("n").alias("shortest"), F.max("n").alias("longest"),
    ).withColumn("verdict", F.when(F.col("all_masked") > 0.1 * F.col("samples"), "many_masked").when(F.col("trained") / F.col("tokens") < 0.03, "low_ratio").otherwise("ok"))


def mask_labels(spark, sf_dir):
    """Token labels: hashes of tokens where trained, -100 elsewhere."""
    turns = M.trained_turns(_spans(spark, sf_dir), "conv_id")
    masks = M.labels(turns, "conv_id")
    text = M.gathered(_turns(spark, sf_dir), "conv_id").select("conv_id", F.regexp_extract_all(M.render(F.col("messages")), F.lit(M.TOKEN), F.lit(0)).alias("tokens"))
    lab = M.mask_array(F.col("runs"), F.transform("tokens", lambda t: F.length(t)))
    return masks.join(text, "conv_id").select("conv_id", F.aggregate(lab, F.lit(0), lambda a, x: a + x).cast("bigint").alias("label_sum"), F.size(lab).alias("n"))


def last_turn_only(spark, sf_dir):
    rows = M.trained_turns(_spans(spark, sf_dir), "conv_id", last_only=True)
    return M.labels(rows, "conv_id").select("conv_id", "n_trained")


def echo_roles(spark, sf_dir):
    spans = M.turn_spans(_raw(spark, sf_dir).withColumn("role", M.normal_role(F.col("raw_role"))), "conv_id")
    return M.labels(M.trained_turns(spans, "conv_id", observe=True), "conv_id").select("conv_id", "n_tokens", "n_trained")


def _weights(scaling):
    def query(spark, sf_dir):
        rows = M.turn_weights(M.trained_turns(_spans(spark, sf_dir), "conv_id"), "conv_id", scaling)
        return rows.select("conv_id", "turn", F.round("weight", 6).alias("weight"))

    return query


def smart_truncate(spark, sf_dir):
    return M.truncate_turns(_spans(spark, sf_dir), "conv_id", 200).groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept_turns"), F.max("end").alias("kept_tokens"))


def _thinking(spark, sf_dir):
    tag = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<think>"), F.substring("content", 1, 20), F.lit("</think>\n\n"), F.col("content"))).otherwise(F.col("content"))
    return _turns(spark, sf_dir).withColumn("content", tag)


def split_reasoning(spark, sf_dir):
    reasoning, answer = M.split_reasoning(F.col("content"))
    return _thinking(spark, sf_dir).select("conv_id", "turn", F.md5(reasoning).alias("reasoning"), F.md5(answer).alias("answer"))


def strip_reasoning(spark, sf_dir):
    return _thinking(spark, sf_dir).select("conv_id", "turn", F.length(M.strip_reasoning(F.col("content"))).alias("n_chars"))


def truncate_for_embedding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, 2048)).alias("head"))


def _tools(spark, sf_dir):
    """Each user declares the tools of three dialects; calls are events, some with bad arguments or unknown names."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "sample")
    k = F.col("sample") % 3
    spec = '{"properties":{"k":{"type":"integer"},"z":{}},"required":["k"]}'
    dialect = F.when(k == 0, F.concat(F.lit('{"type":"function","function":{"name":"'), F.col("event_type"), F.lit(f'","parameters":{spec}}}}}')))
    dialect = dialect.when(k == 1, F.concat(F.lit('{"name":"'), F.col("event_type"), F.lit(f'","input_schema":{spec}}}'))).otherwise(F.concat(F.lit('{"name":"'), F.col("event_type"), F.lit('","parameters":{}}')))
    some = events.filter("sample % 10 <> 9 AND event_type <> 'error'").select("sample", "event_type").distinct()
    declared = T.registry(some.select("sample", F.lit(0).alias("pos"), dialect.alias("tool")))
    args = F.expr("CASE WHEN event_id % 7 = 0 THEN '{bad' WHEN event_id % 7 = 1 THEN '{}' WHEN event_id % 7 = 2 THEN '{\"k\": 1, \"q\": 2}' ELSE props END")
    calls = events.select("sample", F.col("event_id").alias("turn"), F.lit(0).alias("call"), F.col("event_type").alias("name"), args.alias("arguments"))
    return events.select("sample").distinct(), calls, declared


def tool_registry(spark, sf_dir):
    return _tools(spark, sf_dir)[2]


def tool_call_errors(spark, sf_dir):
    _, calls, declared = _tools(spark, sf_dir)
    return T.call_errors(calls, declared)


def tool_report(spark, sf_dir):
    return T.report(*_tools(spark, sf_dir))


def tools_called(spark, sf_dir):
    return _tools(spark, sf_dir)[1].groupBy(F.col("name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    normalize_roles, normalize_sharegpt, message_field_fallback, normalize_reasoning, render_chatml, turn_token_spans, assistant_mask_stats, masking_report, mask_labels, last_turn_only, echo_roles,
    smart_truncate, split_reasoning, strip_reasoning, truncate_for_embedding, tool_registry, tool_call_errors, tool_report, tools_called,
)} | {f"turn_weights_{s}": _weights(s) for s in ("uniform", "progressive", "last_heavy")}

_R = "'<' || {0} || '>' || chr(10) || text || '</' || {0} || '>' || chr(10)"


def _spans_sql(role: str = "role", frm: str = "conversations") -> str:
    return f"""t AS (SELECT conv_id, turn, {role} AS role, text, cast(len(regexp_extract_all({_R.format(role)}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS bigint) AS n FROM {frm}),
        s AS (SELECT *, cast(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS bigint) AS e, cast(sum(n) OVER (PARTITION BY conv_id) AS bigint) AS total FROM t)"""


_THINK = "th AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '<think>' || substr(text, 1, 20) || '</think>' || chr(10) || chr(10) || text ELSE text END AS c, substr(text, 1, 20) AS r, text FROM conversations)"
_TOOLS = """ev AS (SELECT user_id AS sample, * FROM events), decl AS (SELECT DISTINCT sample, event_type AS tool, sample % 3 < 2 AS spec FROM ev WHERE sample % 10 <> 9 AND event_type <> 'error'),
    reg AS (SELECT sample, tool, 'k' AS param, true AS required, 'integer' AS type FROM decl WHERE spec UNION ALL SELECT sample, tool, 'z', false, 'any' FROM decl WHERE spec
            UNION ALL SELECT sample, tool, NULL, false, NULL FROM decl WHERE NOT spec),
    err AS (SELECT ev.sample, event_id AS turn, 0 AS call,
                CASE WHEN event_id % 7 = 0 THEN 'bad_json' WHEN decl.tool IS NULL THEN 'unknown_tool' WHEN spec AND event_id % 7 = 1 THEN 'missing_param' WHEN spec AND event_id % 7 = 2 THEN 'unknown_param' END AS error,
                CASE WHEN event_id % 7 = 0 THEN '{bad' WHEN decl.tool IS NULL THEN event_type WHEN event_id % 7 = 1 THEN 'k' ELSE 'q' END AS detail
            FROM ev LEFT JOIN decl ON decl.sample = ev.sample AND decl.tool = ev.event_type WHERE ev.sample IN (SELECT sample FROM decl))"""


def _weights_sql(raw: str) -> str:
    return f"""WITH {_spans_sql()}, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM s WHERE role = 'assistant'),
        w AS (SELECT *, {raw} AS w FROM a)
        SELECT conv_id, turn, round(w / (sum(w * n) OVER (PARTITION BY conv_id) / sum(n) OVER (PARTITION BY conv_id)), 6) AS weight FROM w"""


ORACLE_SQL = {
    "normalize_roles": f"WITH {_RAW} SELECT conv_id, turn, nrole AS role FROM norm",
    "normalize_sharegpt": f"WITH {_RAW} SELECT conv_id, cast(count(*) AS int) AS n_turns, string_agg(nrole, ',' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS contents FROM norm GROUP BY conv_id",
    "message_field_fallback": f"SELECT conv_id, cast(count(*) AS int) AS n_turns, md5(string_agg({_R.format('role')}, '' ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id",
    "normalize_reasoning": f"""WITH {_RAW}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM norm)
        SELECT conv_id, i AS turn, nrole AS role,
            CASE WHEN turn % 3 = 0 THEN substr(text, 1, 12) WHEN turn % 3 = 1 THEN substr(text, 1, 12) WHEN turn % 2 = 0 THEN 't' END AS reasoning_content,
            CASE WHEN nrole = 'tool' THEN 'n' END AS name, CASE WHEN turn % 5 = 1 THEN '[{{"function":{{"name":"f"}}}}]' END AS tool_calls FROM k""",
    "render_chatml": f"SELECT conv_id, md5(string_agg({_R.format('role')}, '' ORDER BY turn)) AS rendered, md5(string_agg(text, chr(10) ORDER BY turn)) AS joined FROM conversations GROUP BY conv_id",
    "turn_token_spans": f"WITH {_spans_sql()} SELECT conv_id, turn, e - n AS start, e AS \"end\", total FROM s",
    "assistant_mask_stats": f"WITH {_spans_sql()} SELECT conv_id, cast(sum(n) AS bigint) AS n_tokens, cast(sum(n) FILTER (role = 'assistant') AS bigint) AS n_trained, round(sum(n) FILTER (role = 'assistant') / sum(n), 4) AS ratio FROM s GROUP BY conv_id HAVING sum(n) FILTER (role = 'assistant') > 0",
    "masking_report": f"""WITH {_spans_sql()}, c AS (SELECT sum(n) AS n, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS t FROM s GROUP BY conv_id)
        SELECT count(*) AS samples, cast(sum(n) AS bigint) AS tokens, cast(sum(t) AS bigint) AS trained, count(*) FILTER (t = 0) AS all_masked, count(*) FILTER (t = n) AS all_trained,
            round(min(t / n), 4) AS min_ratio, round(max(t / n), 4) AS max_ratio, cast(min(n) AS bigint) AS shortest, cast(max(n) AS bigint) AS longest,
            CASE WHEN count(*) FILTER (t = 0) > 0.1 * count(*) THEN 'many_masked' WHEN sum(t) / sum(n) < 0.03 THEN 'low_ratio' ELSE 'ok' END AS verdict FROM c""",
    "mask_labels": f"""WITH {_spans_sql()}, x AS (SELECT conv_id, role, unnest(regexp_extract_all({_R.format('role')}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS tok FROM t)
        SELECT conv_id, cast(sum(CASE WHEN role = 'assistant' THEN length(tok) ELSE -100 END) AS bigint) AS label_sum, cast(count(*) AS int) AS n FROM x GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0""",
    "last_turn_only": f"""WITH {_spans_sql()}, r AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM s WHERE role = 'assistant')
        SELECT conv_id, cast(sum(n) AS bigint) AS n_trained FROM (SELECT *, max(g) OVER (PARTITION BY conv_id) AS mg FROM r) WHERE g = mg GROUP BY conv_id""",
    "echo_roles": f"WITH {_RAW}, {_spans_sql('nrole', 'norm')} SELECT conv_id, cast(sum(n) AS bigint) AS n_tokens, cast(sum(n) FILTER (role IN ('assistant', 'tool')) AS bigint) AS n_trained FROM s GROUP BY conv_id HAVING sum(n) FILTER (role IN ('assistant', 'tool')) > 0",
    "turn_weights_uniform": _weights_sql("1.0::double"),
    "turn_weights_progressive": _weights_sql("sqrt(k::double / m)"),
    "turn_weights_last_heavy": _weights_sql("CASE WHEN k = m THEN 2.0::double ELSE 1.0::double END"),
    "smart_truncate": f"""WITH {_spans_sql()}, f AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) < 600 AS fast FROM s)
        SELECT conv_id, count(*) AS kept_turns, max(e) AS kept_tokens FROM f WHERE fast OR e <= 200 GROUP BY conv_id, fast HAVING fast OR (count(*) >= 2 AND count(*) FILTER (role = 'assistant') >= 1)""",
    "split_reasoning": f"WITH {_THINK} SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 1 THEN trim(r, ' ' || chr(10) || chr(9) || chr(13)) ELSE '' END) AS reasoning, md5(CASE WHEN turn % 2 = 1 THEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE text END) AS answer FROM th",
    "strip_reasoning": f"WITH {_THINK} SELECT conv_id, turn, cast(length(CASE WHEN turn % 2 = 1 THEN ltrim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE text END) AS int) AS n_chars FROM th",
    "truncate_for_embedding": "SELECT doc_id, md5(substr(text, 1, 2048)) AS head FROM documents",
    "tool_registry": f"WITH {_TOOLS} SELECT * FROM reg",
    "tool_call_errors": f"WITH {_TOOLS} SELECT * FROM err WHERE error IS NOT NULL",
    "tool_report": f"""WITH {_TOOLS} SELECT (SELECT count(DISTINCT sample) FROM ev) AS total, (SELECT count(DISTINCT sample) FROM ev) - count(DISTINCT sample) AS valid,
        (SELECT count(DISTINCT sample) FROM decl) AS samples_with_tools, count(*) AS n_errors, (SELECT string_agg(DISTINCT tool, ',' ORDER BY tool) FROM decl) AS declared,
        (SELECT coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool), '') FROM decl WHERE tool NOT IN (SELECT event_type FROM ev)) AS never_called FROM err WHERE error IS NOT NULL""",
    "tools_called": "SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1",
}
