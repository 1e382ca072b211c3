"""Tokenising, unigram scoring and high-entropy sums."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill import session
from tunemill.functions.skew import HOT, hot_safe_join
from tunemill.session import small, written

#: A run of letters and digits, or one other visible character.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
#: Part of a text without turns that counts as the response, from its end.
RESPONSE_SHARE = 0.6
#: Distinct tokens from which their scores are looked up in arrays, and how many such an array has at most (10 to 16 bytes each).
PACK_FROM, PACKED = 500_000, 6_000_000
#: Tokens that a Python task looks up at once, more only for one long text.
LOOKUP_TOKENS = 1 << 19


class Tokenizer(Protocol):
    """Gives the array of tokens of a text."""

    def __call__(self, text: Column) -> Column: ...


class Scorer(Protocol):
    """Adds `nll` to each row of a table of distinct tokens: token, c (its count in the corpus)."""

    def __call__(self, counts: DataFrame) -> DataFrame: ...


def tokenize(text: Column, limit: int | None = None) -> Column:
    """The tokens of a text, all of them unless a limit is set."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.slice(found, 1, limit) if limit else found


def unigram_scorer(counts: DataFrame) -> DataFrame:
    """-ln of each token's share of the corpus."""
    total = counts.agg(F.sum("c").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("nll", -F.log(F.col("c") / F.col("total")))


def response_start(length: Column, prefix: Column | None = None, inclusive: Column | None = None) -> Column:
    """Tokens before the response: what the rendered prompt has (its generation prompt included, if that is known and
    shorter than the whole), else all but the last RESPONSE_SHARE of the text."""
    fallback = F.floor(length * F.lit(1 - RESPONSE_SHARE))
    known = F.coalesce(*(c for c in (inclusive, prefix) if c is not None)) if prefix is not None or inclusive is not None else None
    return fallback if known is None else F.when(known.isNotNull() & (known >= 0) & (known < length), known).otherwise(fallback)


def _frequent(scores: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Of token, c, nll, a written table, the most frequent tokens within these limits, and the others, if any.

    The cut is at a count: there are four steps to each doubling, so few rows tell where."""
    step = F.floor(F.log2("c") * 4)
    sizes = scores.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token") + 16).alias("size")).orderBy(F.desc("step")).collect()
    rows = size = 0
    for s in sizes:
        rows, size = rows + s.n, size + s["size"]
        if rows > most_rows or size > most_bytes:
            return scores.filter(step > s.step), scores.filter(step <= s.step)
    return scores, None


_SUMS = ("nll", "nll_response", "n", "n_response")


def _by_join(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The sums of each of rows (sample, length, _from, _t) over the tokens whose scores can be sent, with a null token;
    if there are others, also one row for each of them that a sample has, and their scores."""
    frequent, rare = _frequent(known, session.BROADCAST_ROWS, session.BROADCAST_BYTES)
    rows = rows.select("sample", "length", "_from", F.posexplode_outer("_t").alias("pos", "token"))
    rows = rows.join(F.broadcast(frequent.select("token", "nll", F.lit(True).alias("_near"))), "token", "left")
    in_response = F.col("token").isNotNull() & (F.col("pos") >= F.col("_from"))
    sums = [F.sum("nll").alias("nll"), F.sum(F.when(in_response, F.col("nll"))).alias("nll_response"), F.count("token").alias("n"), F.count(F.when(in_response, 1)).alias("n_response")]
    if rare is None:
        return rows.groupBy("sample", "length").agg(*sums), None
    return rows.groupBy("sample", "length", F.when(F.col("_near").isNull(), F.col("token")).alias("token")).agg(*sums), rare


def _key(token: Column, seed: int) -> Column:
    """64 bits of a token."""
    return F.xxhash64(token, F.lit(seed))


def _by_lookup(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """As _by_join, for many tokens, which have keys in place of their text.

    The score that most tokens share (that of those seen once, by the default scorer) is sent once, and of the tokens with
    another score only keys and scores, in two sorted arrays. If all of these fit, a token that they miss has the shared
    score, and none is shuffled, however many there are; else those they miss are left to the caller. Keys are seeded
    anew until no two tokens share one, so a key stands for its token."""
    usual = known.groupBy("nll").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "nll").first().nll
    seed = next(s for s in count() if known.groupBy(_key(F.col("token"), s).alias("key")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty())
    sent, rest = _frequent(known.filter(~F.col("nll").eqNullSafe(F.lit(usual))), PACKED, 1 << 62)
    if rest is not None:  # a token that is missed may be one of these or have the shared score
        rest = rest.unionByName(known.filter(F.col("nll").eqNullSafe(F.lit(usual)))).select(_key(F.col("token"), seed).alias("token"), "c", "nll")
    table = sent.select(_key(F.col("token"), seed).alias("key"), "nll").toArrow()
    keys, nll = table.column("key").to_numpy(), table.column("nll").to_numpy()
    order = np.argsort(keys)
    values, codes = np.unique(nll[order], return_inverse=True)
    arrays = rows.sparkSession.sparkContext.broadcast((keys[order], codes.astype(np.min_scalar_type(len(values))), values))
    all_sent, most = rest is None, LOOKUP_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, values = arrays.value
        for whole in batches:
            ends = np.cumsum(whole.column(3).value_lengths().fill_null(0).to_numpy())
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), whole.num_rows])
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(begin, end - begin)
                lengths = batch.column(3).value_lengths().fill_null(0).to_numpy().astype(np.int64)
                tokens = batch.column(3).flatten()
                valid, asked = tokens.is_valid().to_numpy(zero_copy_only=False), tokens.fill_null(0).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), lengths)
                place = np.arange(len(asked)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                response = place >= batch.column(2).to_numpy()[row]
                at = np.searchsorted(keys, asked)
                at[at == len(keys)] = 0
                found = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
                scores = np.full(len(asked), usual)
                scores[found] = values[codes[at[found]]]
                far = valid & ~found & (not all_sent)
                here = [valid & ~far, valid & ~far & response]
                sums = [np.bincount(row[m], scores[m], batch.num_rows) for m in here] + [np.bincount(row[m], minlength=batch.num_rows) for m in here]
                yield _records(batch, np.arange(batch.num_rows), None, sums)
                if far.any():
                    r, k, n_response = row[far], asked[far], response[far].astype(np.int64)
                    by = np.lexsort((k, r))
                    r, k, n_response = r[by], k[by], n_response[by]
                    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
                    none = np.zeros(len(first))
                    yield _records(batch, r[first], k[first], [none, none, np.diff(np.r_[first, len(r)]), np.add.reduceat(n_response, first)])

    kinds = dict(rows.dtypes)
    asked = rows.select("sample", "length", F.col("_from").cast("double"), F.transform("_t", lambda t: F.when(t.isNotNull(), _key(t, seed))).alias("_t"))
    return asked.mapInArrow(run, f"sample {kinds['sample']}, length {kinds['length']}, token bigint, nll double, nll_response double, n bigint, n_response bigint"), rest


def _records(batch: pa.RecordBatch, rows: np.ndarray, token: np.ndarray | None, sums: list[np.ndarray]) -> pa.RecordBatch:
    at = pa.array(rows)
    token = pa.nulls(len(rows), pa.int64()) if token is None else pa.array(token, pa.int64())
    values = [pa.array(x, kind) for x, kind in zip(sums, (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), token, *values], names=["sample", "length", "token", *_SUMS])


def score(docs: DataFrame, scorer: Scorer = unigram_scorer, id_col: str = "doc_id", text_col: str = "text", limit: int | None = None, tokenizer: Tokenizer | None = None, prefix_col: str | None = None) -> DataFrame:
    """sample, length, avg_nll, response_nll, response_token_count, ppl, response_ppl; inf where under two tokens.

    The corpus's counts are aggregated map-side. The scores of the most frequent tokens, as many as can be sent to all
    executors, score each sample where its text is read. What a sample has of other tokens is counted there, one row for
    each of them, and only these rows meet their scores by a shuffle. Of many distinct tokens far more can be sent, as
    keys, so that usually none is shuffled. Whole texts are read unless a limit is set.
    `prefix_col` may hold the number of tokens before the response."""
    tokens = tokenizer(F.col(text_col)) if tokenizer else tokenize(F.col(text_col), limit)
    texts = docs.select(F.col(id_col).alias("sample"), tokens.alias("_t"), *([F.col(prefix_col).alias("_p")] if prefix_col else []))
    # an outer explode, as from an inner one Spark infers a filter that tokenises every text once more
    counts = texts.select(F.explode_outer("_t").alias("token")).filter("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    known = written(scorer(written(counts, "token-counts")).select("token", "c", "nll"), "token-scores")
    rows = texts.withColumn("length", F.coalesce(F.when(F.size("_t") >= 0, F.size("_t")), F.lit(0)))
    rows = rows.select("sample", "length", response_start(F.col("length"), F.col("_p") if prefix_col else None).alias("_from"), "_t")
    per, rare = (_by_lookup if known.count() > PACK_FROM else _by_join)(rows, known)
    if rare is None:
        joined = per.select("sample", "length", *_SUMS)
    else:
        per = written(per, "sample-tokens")
        # no more samples have a token than the corpus has of it, so its count tells which are hot
        hot = small(rare.filter(F.col("c") > HOT).select("token"))
        others = hot_safe_join(per.filter("token is not null").drop("nll", "nll_response"), rare.select("token", "nll"), ["token"], "left", many=hot)
        others = others.select("sample", "length", (F.col("nll") * F.col("n")).alias("nll"), (F.col("nll") * F.col("n_response")).alias("nll_response"), "n", "n_response")
        joined = per.filter("token is null").drop("token").unionByName(others)
    weigh = lambda nll, n: F.sum(nll) / F.expr(f"nullif(sum({n}), 0)")
    out = joined.groupBy("sample", "length").agg(weigh("nll", "n").alias("avg_nll"), weigh("nll_response", "n_response").alias("response_nll"), F.coalesce(F.sum("n_response"), F.lit(0)).cast("bigint").alias("response_token_count"))
    out = out.withColumn("response_nll", F.coalesce("response_nll", "avg_nll"))
    fine = F.col("length") >= 2
    ppl = lambda c: F.when(fine, F.round(F.exp(F.least(F.col(c), F.lit(20.0))), 2)).otherwise(F.lit(float("inf")))
    return out.select(
        "sample",
        F.when(fine, F.col("length")).otherwise(0).cast("bigint").alias("length"),
        F.round("avg_nll", 4).alias("avg_nll"),
        F.round("response_nll", 4).alias("response_nll"),
        "response_token_count",
        ppl("avg_nll").alias("ppl"),
        ppl("response_nll").alias("response_ppl"),
    )


def top_entropy_sum(values: Column, percent: float) -> Column:
    """Sum of the top max(1, int(n * percent / 100)) values; 0 with under five values."""
    k = F.greatest(F.lit(1), F.floor(F.size(values) * F.lit(percent) / 100).cast("int"))
    top = F.slice(F.sort_array(values, asc=False), F.lit(1), k)
    return F.when(F.size(values) < 5, F.lit(0.0)).otherwise(F.aggregate(top, F.lit(0.0), lambda a, x: a + x))


def normalized_hes(scores: DataFrame, col: str = "hes") -> DataFrame:
    """Min-max over the positive values; 0 for others, 1 where all are equal. One pass gives both ends."""
    ends = scores.agg(F.min(F.when(F.col(col) > 0, F.col(col))).alias("_lo"), F.max(F.when(F.col(col) > 0, F.col(col))).alias("_hi"))
    value = F.when(F.col(col) <= 0, 0.0).when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return scores.crossJoin(F.broadcast(ends)).withColumn(f"{col}_normalized", F.round(value, 4)).drop("_lo", "_hi")
