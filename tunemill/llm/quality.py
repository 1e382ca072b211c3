"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train an additive logistic model on binned text features. The risk is
the non-negative unbiased one: pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)), with pi the estimated share of
positives; where the estimate of the negative part turns negative, a step moves against it. Features are
taken from whole texts in one pass; the fit sees a bounded sample of them on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.llm.names import fresh
from tunemill.llm.workers import releasing
from tunemill.session import small, written

#: Most trusted positives, and most unlabelled rows, that the fit sees (documented bound; chosen by a hash of the id).
SAMPLE = 20_000
BINS, ROUNDS, STEP, RIDGE = 24, 600, 0.3, 1e-5
#: The prior is set a little low, since the risk is blind to negatives that an estimate above the truth counts as positives.
PRIOR_MARGIN = 0.97

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*+=<>@^_~\\/",
    "quote": b"\"'()[]{}",
    "dash": b"-",
}
_LETTER = np.zeros(256, bool)
_LETTER[list(_CLASSES["upper"] + _CLASSES["lower"]) + list(range(128, 256))] = True
NAMES = [*_CLASSES, "high", "log_bytes", "entropy", "word_bytes", "word_bytes_sd", "longest_word", "types", "pair_types", "top_word", "same_next", "line_types", "line_words", "ends_stop", "ends_mark", "starts_upper", "all_upper", "top_line"]


def features(text: str) -> list[float]:
    """Shares of byte classes, and how words and lines vary and repeat, over the whole text; zeros for an empty one."""
    data = text.encode(errors="replace")
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n, k = len(data), len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [float(count[list(c)].sum()) / n for c in _CLASSES.values()] + [float(count[128:].sum()) / n]
    p = count[count > 0] / n
    length = np.fromiter(map(len, words), np.int64, k)
    first = np.fromiter((w[0] for w in words), np.uint8, k)
    last = np.fromiter((w[-1] for w in words), np.uint8, k)
    lines = [x for x in data.split(b"\n") if x]
    seen, seen_lines = Counter(words), Counter(lines)
    pairs = len(set(zip(words, words[1:], strict=False)))
    upper = (first >= 65) & (first <= 90)
    return [
        *shares, float(np.log1p(n)), float(-(p * np.log2(p)).sum()), float(length.mean()), float(length.std()), float(np.log1p(length.max())),
        len(seen) / k, pairs / max(1, k - 1), max(seen.values()) / k, sum(map(bytes.__eq__, words, words[1:])) / k,
        len(seen_lines) / max(1, len(lines)), k / max(1, len(lines)), float(np.isin(last, list(b".,;:?")).mean()), float((~_LETTER[last] & ~np.isin(last, list(b".,;:?"))).mean()),
        float(upper.mean()), sum(map(bytes.isupper, words)) / k, max(seen_lines.values(), default=1) / max(1, len(lines)),
    ]


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = [features(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(run), f"doc_id {kind}, x array<float>")


@dataclass
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def logit(self, b: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(b.shape[1]), b].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.binned(x)), -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, step: float = STEP, ridge: float = RIDGE) -> Model:
    """Minimises the non-negative risk with logistic loss. Without positives or unlabelled rows the score is the prior."""
    size = len(NAMES)
    start = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((size, BINS - 1), np.float32), np.zeros((size, BINS)), start, prior)
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    model = Model(edges, np.zeros((size, BINS)), start, prior)
    bp, bu = model.binned(positive), model.binned(unlabelled)
    flat = np.arange(size) * BINS
    gather = lambda b, g: np.bincount((b + flat).ravel(), np.repeat(g, size), size * BINS).reshape(size, BINS)
    m, v, mb, vb = np.zeros((size, BINS)), np.zeros((size, BINS)), 0.0, 0.0
    for t in range(1, rounds + 1):
        zp, zu = model.logit(bp), model.logit(bu)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # derivatives by the logit: of loss(+) at positives, of loss(-) at both
        up, plus, minus = su / len(zu), prior * (sp - 1) / len(zp), prior * sp / len(zp)
        gp, gu = (plus - minus, up) if negative >= 0 else (minus, -up)
        grad, gb = gather(bp, gp) + gather(bu, gu) + ridge * model.weights, gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = step * (1 - t / (rounds + 1)) / (1 - 0.9**t)
        model.weights -= rate * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        model.bias -= rate * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    return model


#: Bits of the hash that sampling compares: enough for a bound above zero at any number of rows.
_POINT_BITS = 60


def _share(n: int) -> int:
    """The bound of the hash under which SAMPLE of n rows lie."""
    return (SAMPLE << _POINT_BITS) // max(n, SAMPLE)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE of the n rows, by a hash of id and features; never over twice as many, however often rows repeat."""
    point = F.xxhash64("doc_id", "x", F.lit(11))
    got = rows.filter(F.shiftrightunsigned(point, 64 - _POINT_BITS) < F.lit(_share(n))).orderBy(point).limit(2 * SAMPLE).select("x").toPandas()["x"]
    if n and not len(got) and n > 100 * SAMPLE:
        raise ValueError(f"no row of {n} was sampled")
    return np.stack(got.to_list()).astype(np.float32) if len(got) else np.zeros((0, len(NAMES)), np.float32)


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels of held-out rows (fold 0) are not read. Null text counts as empty and gets the score of empty texts.
    Labels that are null, or whose id is null or has no document, are not used, also not for the prior, which is the
    share of good ones among the labels of training documents; several labels of an id count by the largest. Texts of
    any length are read whole; equal texts get equal scores. Other columns are not read, whatever their names. Rows with equal or null ids are scored one by one. With no usable label the score is 0.5; an
    empty table gives an empty result. Scores read the text alone.
    """
    table = written(feature_table(docs, id_col, text_col), "quality-features")
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    train = table.filter(fold(F.col("doc_id"), folds) != 0)
    known = known.groupBy("doc_id").agg(F.max(label_col).alias("label")).join(train.select("doc_id").distinct(), "doc_id", "left_semi")
    known = written(known, "quality-labels")
    got = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("good")).first()
    prior = PRIOR_MARGIN * (got.good + 1) / (got.n + 2)
    positive = written(train.join(small(known.filter("label = 1").select("doc_id")), "doc_id", "left_semi"), "quality-positives")
    model = fit_nnpu(_sample(positive, positive.count()), _sample(train, table.count()), prior) if got.good else Model(np.zeros((len(NAMES), BINS - 1), np.float32), np.zeros((len(NAMES), BINS)), 0.0, 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    scored = table.mapInArrow(releasing(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without those that score below the threshold; columns stay. Of rows with one id, all stay if one does."""
    scored = written(score_quality(docs, labels, id_col, text_col, threshold=threshold), "quality-scores")
    (key,) = fresh(docs, "_id")
    worst = scored.groupBy("doc_id").agg(F.max("predicted").alias("predicted")).filter("predicted = 0").select(F.col("doc_id").alias(key))
    gone = small(written(worst, "quality-rejected"))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_anti")
