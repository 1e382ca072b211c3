"""Label masks found in rendered text, and the inspection of a batch's labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunemill.operators.scoring import tokenize

IGNORE = -100
# What opens and closes observed text within a turn.
OBSERVED_MARKS = (
    ("<tool_response>", "</tool_response>"),
    ("<|tool▁output|>", "<|tool▁output▁end|>"),
    ("<observation>", "</observation>"),
    ("[Tool Output]", "[/Tool Output]"),
    ("```output\n", "```"),
)
#: A block of reasoning with the white space after it.
REASONING = r"(?s)<think>.*?</think>[ \t\r\n]*"


def observed_text(text: Column) -> Column:
    """All observed parts of a text, mark by mark; one that is not closed reaches to the end."""
    parts = [F.regexp_extract_all(text, F.lit(rf"(?s){re.escape(a)}(.*?)(?:{re.escape(b)}|\z)"), 1) for a, b in OBSERVED_MARKS]
    return F.flatten(F.array(*parts))


def observed_labels(text: Column) -> Column:
    """Labels of a masked text's tokens in which the observed parts are trained; a part ends before the first closing
    mark of its own kind. Where the marks of two kinds cross, the one that opens first counts."""
    parts = "|".join(rf"(?<={re.escape(a)})(?!{re.escape(b)}).+?(?={re.escape(b)}|\z)" for a, b in OBSERVED_MARKS)
    return piecewise_labels(text, f"(?s)(?:{parts})", inside=True)


def piecewise_labels(text: Column, pattern: str, inside: bool, label=F.length) -> Column:
    """Labels of a text's tokens, by whether a token lies in a match of the pattern: those trained get label(token),
    the others IGNORE. The pattern must begin and end between tokens."""
    gaps, spans = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    labelled = lambda part, keep: F.transform(tokenize(part), lambda t: (label(t) if keep else F.lit(IGNORE)).cast("bigint"))
    return F.flatten(F.zip_with(gaps, spans, lambda g, s: F.concat(labelled(F.coalesce(g, F.lit("")), not inside), labelled(F.coalesce(s, F.lit("")), inside))))


def strip_reasoning_labels(text: Column) -> Column:
    """Labels of a trained text without its reasoning blocks."""
    return piecewise_labels(text, REASONING, inside=False)


def cursor_spans(full: Column, parts: Column) -> Column:
    """array of (start, end), in characters from 0, of each part in a render: the first place at or after the end of
    the part before; (-1, -1) for one that is not found, which moves nothing. For templates that are not our own."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, part: Column) -> Column:
        place = F.position(part, full, acc["at"] + 1) - 1
        fine = (place >= 0) & (F.length(part) > 0)
        span = F.when(fine, F.struct(place.alias("start"), (place + F.length(part)).alias("end"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))
        return F.struct(F.when(fine, place + F.length(part)).otherwise(acc["at"]).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def response_mask(length: Column, spans: Column) -> Column:
    """Whether each of `length` tokens lies in one of the spans (start, end): [tokens of the prompt, tokens with the
    response). Spans that are null stand for a template that failed: then all but the first 40 % is the response."""
    fallback = F.array(F.struct(F.greatest(F.lit(1), F.floor(length * F.lit(0.4))).cast("bigint").alias("start"), length.cast("bigint").alias("end")))
    used = F.coalesce(spans, fallback)
    places = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), length.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(places, lambda i: F.exists(used, lambda s: (i >= s["start"]) & (i < s["end"])))


def transitions(rows: DataFrame, id_col: str, pos: str = "pos", label: str = "label", most: int = 20) -> DataFrame:
    """The first `most` places of each sample where its labels change between trained and ignored; masked before the first."""
    w = Window.partitionBy(id_col).orderBy(pos)
    trained = F.col(label) != IGNORE
    marked = rows.withColumn("_t", trained).withColumn("_b", F.coalesce(F.lag("_t").over(w), F.lit(False))).filter("_t <> _b")
    return marked.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= most).select(id_col, pos, F.when(F.col("_t"), "train").otherwise("mask").alias("to"))


def label_shares(rows: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Per sample: tokens, trained ones and their share in percent."""
    out = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(F.col(label) != IGNORE, 1)).alias("n_trained"))
    return out.withColumn("percent", F.round(F.col("n_trained") * 100 / F.col("n_tokens"), 1))
