"""Tool declarations and the validation of tool calls against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunemill.functions.ranks import first_rows, global_rank


def registry(tools: DataFrame, id_col: str = "sample") -> DataFrame:
    """tools (id, pos, tool as JSON) in any of three dialects -> id, tool, param, required, type.

    The dialects are {function: {name, parameters}}, {name, input_schema} and {name, parameters}. A later
    declaration of a name replaces an earlier one. A tool without parameters has one row with null param."""
    get = lambda path: F.get_json_object("tool", path)
    rows = tools.select(
        id_col, "pos", F.coalesce(get("$.function.name"), get("$.name")).alias("name"),
        F.coalesce(get("$.function.parameters"), get("$.input_schema"), get("$.parameters"), F.lit("{}")).alias("params"),
    )
    last = Window.partitionBy(id_col, "name").orderBy(F.desc("pos"))
    rows = rows.filter("name is not null").withColumn("_k", F.row_number().over(last)).filter("_k = 1")
    required = F.from_json(F.get_json_object("params", "$.required"), "array<string>")
    props = F.from_json(F.get_json_object("params", "$.properties"), "map<string,string>")
    rows = rows.select(id_col, F.col("name").alias("tool"), required.alias("_req"), F.explode_outer(props).alias("param", "_spec"))
    return rows.select(
        id_col, "tool", "param", F.coalesce(F.array_contains("_req", F.col("param")), F.lit(False)).alias("required"),
        F.when(F.col("param").isNotNull(), F.coalesce(F.get_json_object("_spec", "$.type"), F.lit("any"))).alias("type"),
    )


def call_errors(calls: DataFrame, declared: DataFrame, id_col: str = "sample") -> DataFrame:
    """calls (id, turn, call, name, arguments) against a registry -> id, turn, call, error, detail.

    Arguments that are no JSON object, or an unknown tool, end the checks of a call; then come unknown
    parameters and missing required ones. Samples without declared tools have no errors."""
    with_tools = declared.select(id_col).distinct()
    spec = declared.groupBy(id_col, F.col("tool").alias("name")).agg(
        F.collect_set("param").alias("params"), F.collect_set(F.when(F.col("required"), F.col("param"))).alias("required")
    )
    keys = F.json_object_keys("arguments")
    rows = calls.join(with_tools, id_col, "left_semi").join(spec, [id_col, "name"], "left").withColumn("_keys", keys)
    checked = F.size("params") > 0
    unknown = F.transform(F.array_sort(F.array_except("_keys", "params")), lambda p: F.struct(F.lit("unknown_param").alias("error"), p.alias("detail")))
    missing = F.transform(F.array_sort(F.array_except("required", "_keys")), lambda p: F.struct(F.lit("missing_param").alias("error"), p.alias("detail")))
    one = lambda e, d: F.array(F.struct(F.lit(e).alias("error"), d.alias("detail")))
    found = (
        F.when(F.col("_keys").isNull(), one("bad_json", F.substring("arguments", 1, 100)))
        .when(F.col("params").isNull(), one("unknown_tool", F.col("name")))
        .when(checked, F.concat(unknown, missing))
    )
    return rows.select(id_col, "turn", "call", F.explode(found).alias("e")).select(id_col, "turn", "call", "e.error", "e.detail")


def called_counts(calls: DataFrame) -> DataFrame:
    """tool, n, place: the called tools, the most frequent first."""
    counts = calls.filter("name is not null AND name <> ''").groupBy(F.col("name").alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    return global_rank(counts, [F.desc("n"), F.asc("tool")], "place")


def first_errors(errors: DataFrame, most: int = 50, id_col: str = "sample") -> DataFrame:
    """The first errors by sample, turn and call, and whether there are more."""
    head = first_rows(errors, [id_col, "turn", "call", "error", "detail"], most + 1, "place")
    return head.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > most).filter(F.col("place") < most)


def report(samples: DataFrame, calls: DataFrame, declared: DataFrame, id_col: str = "sample") -> DataFrame:
    """One row: total, valid, samples_with_tools, n_errors, declared and never-called tools; called_counts has the called ones."""
    errors = call_errors(calls, declared, id_col)
    bad = errors.agg(F.count(F.lit(1)).alias("n_errors"), F.count_distinct(id_col).alias("_bad"))
    tools = declared.select("tool").distinct()
    never = tools.join(calls.select(F.col("name").alias("tool")).distinct(), "tool", "left_anti")
    return (
        samples.agg(F.count(F.lit(1)).alias("total")).crossJoin(bad)
        .crossJoin(declared.agg(F.count_distinct(id_col).alias("samples_with_tools")))
        .crossJoin(tools.agg(F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("declared")))
        .crossJoin(never.agg(F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("never_called")))
        .select("total", (F.col("total") - F.col("_bad")).alias("valid"), "samples_with_tools", "n_errors", "declared", "never_called")
    )
