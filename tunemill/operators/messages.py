"""Chat messages: normalising, rendering, token spans, training masks, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.operators.scoring import TOKEN

# What role names stand for, the roles of observations, and the markers of observed text.
ROLE_MAP = {
    "system": "system", "user": "user", "assistant": "assistant", "tool": "tool", "human": "user", "gpt": "assistant", "bot": "assistant", "function": "tool", "ai": "assistant",
    "model": "assistant", "chatbot": "assistant", "instruction": "user", "input": "user", "output": "assistant", "response": "assistant",
}
ROLE_FIELDS = ("role", "from", "sender", "author", "type")
CONTENT_FIELDS = ("content", "value", "text", "message", "response")
MESSAGE_FIELDS = ("messages", "conversations", "conversation", "chat", "dialogue", "turns")
OBSERVED_ROLES = ("assistant", "tool", "observation", "ipython", "function")

MESSAGE = "array<struct<role:string,content:string,reasoning_content:string,name:string,tool_calls:string>>"


def normal_role(role: Column, role_map: dict[str, str] | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (role_map or ROLE_MAP).items() for x in pair])
    name = F.lower(F.trim(role))
    return F.coalesce(F.try_element_at(known, name), name)


def messages_field(df: DataFrame, primary: str = "messages") -> Column:
    """The first of the primary field and its aliases that the schema has and that holds a turn."""
    names = [c for c in dict.fromkeys((primary, *MESSAGE_FIELDS)) if c in df.columns]
    return F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in names]) if names else F.lit(None)


def normalize(df: DataFrame, primary: str = "messages", role_map: dict[str, str] | None = None, out: str = "messages") -> DataFrame:
    """Any dialect's turns as an array of (role, content, reasoning_content, name, tool_calls).

    Field aliases resolve against the turn's struct; a field that is null counts as absent. Turns without a
    role go; an array that is left empty becomes null. A turn that has one field beside its role, of an unknown name,
    gives its value as content; which one that is, each turn tells for itself."""
    source = messages_field(df, primary)
    raw = df.withColumn("_raw", source)
    kind = raw.schema["_raw"].dataType.elementType
    fields = kind.fieldNames()
    known = {*ROLE_FIELDS, *CONTENT_FIELDS, "reasoning_content", "reasoning", "think", "name", "tool_calls", "function_call"}
    other, unknown = [f for f in fields if f not in ROLE_FIELDS], [f for f in fields if f not in known]

    def first(m: Column, names: tuple[str, ...]) -> Column:
        found = [m[n].cast("string") for n in names if n in fields]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def text_of(m: Column, n: str) -> Column:
        return (m[n] if n in fields and kind[n].dataType.typeName() == "string" else F.to_json(m[n])) if n in fields else F.lit(None).cast("string")

    def turn(m: Column) -> Column:
        role = normal_role(first(m, ROLE_FIELDS), role_map)
        there = sum((F.when(m[f].isNotNull(), 1).otherwise(0) for f in other), F.lit(0))
        content = F.coalesce(first(m, CONTENT_FIELDS), F.when(there == 1, F.coalesce(F.lit(None).cast("string"), *[text_of(m, f) for f in unknown])))
        nonempty = [F.nullif(m[n].cast("string"), F.lit("")) for n in ("reasoning", "think") if n in fields]
        reasoning = F.coalesce(*([m["reasoning_content"].cast("string")] if "reasoning_content" in fields else []), *nonempty, F.lit(None).cast("string"))
        legacy = text_of(m, "function_call")
        calls = F.coalesce(F.when(legacy.isNotNull(), F.concat(F.lit('[{"function":'), legacy, F.lit("}]"))), text_of(m, "tool_calls"))
        name = F.when(role == "tool", m["name"].cast("string")) if "name" in fields else F.lit(None).cast("string")
        return F.struct(role.alias("role"), F.coalesce(content, F.lit("")).alias("content"), reasoning.alias("reasoning_content"), name.alias("name"), calls.alias("tool_calls"))

    turns = F.transform(F.filter("_raw", lambda m: first(m, ROLE_FIELDS).isNotNull()), turn)
    return raw.withColumn(out, F.when(F.size(turns) > 0, turns)).drop("_raw")


def turns_of(df: DataFrame, id_col: str, messages: str = "messages") -> DataFrame:
    """One row per turn: id, turn, role, content and the rest."""
    return df.select(id_col, F.posexplode(messages).alias("turn", "m")).select(id_col, "turn", "m.*")


def gathered(turns: DataFrame, id_col: str, *extra: str) -> DataFrame:
    """One row per conversation with its turns in order; a conversation is one sample, so this stays small."""
    cols = ["turn", "role", "content", *extra]
    return turns.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("messages"))


def rendered_turn(role: Column, content: Column) -> Column:
    """Our own template: role tags around the content. Any prefix of turns renders to a prefix."""
    return F.concat(F.lit("<"), role, F.lit(">\n"), content, F.lit("</"), role, F.lit(">\n"))


def render(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: rendered_turn(m["role"], m["content"])), "")


def joined_contents(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def turn_spans(turns: DataFrame, id_col: str) -> DataFrame:
    """start and end of each rendered turn in tokens, and the conversation's total."""
    n = token_count(rendered_turn(F.col("role"), F.col("content")))
    w = Window.partitionBy(id_col).orderBy("turn")
    rows = turns.withColumn("n_tokens", n).withColumn("end", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("start", F.col("end") - F.col("n_tokens")).withColumn("total", F.sum("n_tokens").over(Window.partitionBy(id_col)))


def trained_turns(spans: DataFrame, id_col: str, observe: bool = False, last_only: bool = False) -> DataFrame:
    """trained: whether a turn's tokens carry loss. last_only keeps the last run of trained turns."""
    rows = spans.withColumn("trained", F.col("role").isin(*(OBSERVED_ROLES if observe else ("assistant",))))
    if last_only:
        w = Window.partitionBy(id_col).orderBy("turn")
        rows = rows.withColumn("_run", F.col("turn") - F.sum(F.col("trained").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        last = F.max(F.when(F.col("trained"), F.col("_run"))).over(Window.partitionBy(id_col))
        rows = rows.withColumn("trained", F.col("trained") & (F.col("_run") == last)).drop("_run")
    return rows


def labels(spans: DataFrame, id_col: str) -> DataFrame:
    """Per conversation, the mask over all tokens as runs (start, end, trained) and its counts; none trained: dropped."""
    run = F.struct("start", "end", "trained")
    out = spans.groupBy(id_col).agg(
        F.sum("n_tokens").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("trained"), F.col("n_tokens"))), F.lit(0)).alias("n_trained"), F.array_sort(F.collect_list(run)).alias("runs")
    )
    return out.filter("n_trained > 0")


def mask_array(runs: Column, tokens: Column) -> Column:
    """Labels for a token array from the runs: the token where trained, else -100."""
    flags = F.flatten(F.transform(runs, lambda r: F.array_repeat(r["trained"], (r["end"] - r["start"]).cast("int"))))
    return F.zip_with(tokens, flags, lambda t, f: F.when(f, t).otherwise(F.lit(-100)))


def turn_weights(spans: DataFrame, id_col: str, scaling: str) -> DataFrame:
    """weight of each trained turn's tokens, with mean 1 over the trained tokens of the conversation."""
    trained = spans.filter("trained")
    w = Window.partitionBy(id_col)
    k, n = F.row_number().over(w.orderBy("turn")), F.count(F.lit(1)).over(w)
    raw = {"uniform": F.lit(1.0), "progressive": F.sqrt(k / n), "last_heavy": F.when(k == n, 2.0).otherwise(1.0)}[scaling]
    rows = trained.withColumn("_w", raw)
    mean = F.sum(F.col("_w") * F.col("n_tokens")).over(w) / F.sum("n_tokens").over(w)
    return rows.withColumn("weight", F.col("_w") / mean).drop("_w")


def truncate_turns(spans: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The longest prefix of turns within the limit, if it has two turns and one of the assistant; short conversations pass."""
    w = Window.partitionBy(id_col)
    rows = spans.withColumn("_fast", F.sum(F.length("content")).over(w) < 3 * limit)
    rows = rows.filter(F.col("_fast") | (F.col("end") <= limit))
    enough = (F.count(F.lit(1)).over(w) >= 2) & (F.count(F.when(F.col("role") == "assistant", 1)).over(w) >= 1)
    return rows.withColumn("_ok", F.col("_fast") | enough).filter("_ok").drop("_ok", "_fast")


def split_reasoning(content: Column, reasoning: Column | None = None) -> tuple[Column, Column]:
    """(reasoning, answer): the explicit field, else the text around the first closing think tag."""
    end = F.instr(content, F.lit("</think>"))
    head = F.substring_index(content, "</think>", 1)
    inside = F.trim(F.substring_index(head, "<think>", -1), F.lit(" \n\t\r"))
    after = F.trim(F.substr(content, end + F.lit(8)), F.lit(" \n\t\r"))
    given = reasoning if reasoning is not None else F.lit(None).cast("string")
    found = F.when(end > 0, inside).otherwise("")
    return F.coalesce(F.nullif(given, F.lit("")), found), F.when(F.coalesce(given, F.lit("")) != "", content).when(end > 0, after).otherwise(content)


def strip_reasoning(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)<think>.*?</think>\s*", "")
