"""Scoring by models that see a token's context.

A scorer is a function that gives a model, called once in each Python worker, which Spark keeps for many tasks. In a task
texts are read into a buffer of bounded tokens, sorted by length and grouped into padded batches of at most `batch_size`
texts and `batch_tokens` tokens with padding; a longer text is a batch of its own. Each text's scores are summed over its own tokens
only and put back at its place in the buffer, so neither padding nor the bounds of batches, buffers or tasks change a
result. Texts are read whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import count
from types import ModuleType
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.operators.scoring import RESPONSE_SHARE, TOKEN

#: Tokens of a buffer that are sorted together.
BUFFER_TOKENS = 1 << 20
_RESULT = "length bigint, avg_nll double, response_nll double, response_token_count bigint"


class SequenceModel(Protocol):
    """Predicts each token from those before it."""

    def encode(self, text: str) -> np.ndarray:
        """The token numbers of a text."""

    def nll(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of a padded batch of so many texts and tokens: -ln p of each token from the second on. Values of padding are not read."""


Loader = Callable[[], SequenceModel]

_serial = count()


def kept_in_worker(what: str, key: object, load: Callable[[], object]) -> object:
    """What load() gave in this Python worker for the key; another key's takes its place.

    The package goes to workers by value, so its own globals are new in each task; a module by name lasts."""
    kept = sys.modules.setdefault("_tunemill_kept", ModuleType("_tunemill_kept")).__dict__
    if what not in kept or kept[what][0] != key:
        kept.pop(what, None)
        kept[what] = (key, load())
    return kept[what][1]


def batches_by_length(lengths: np.ndarray, batch_size: int, batch_tokens: int) -> Iterator[np.ndarray]:
    """Places of the texts in ascending length, cut before a batch gets too many texts or, padded to its longest, tokens."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or end - begin >= batch_size or (end - begin + 1) * int(lengths[order[end]]) > batch_tokens:
            yield order[begin:end]
            begin = end


def _scored(model: SequenceModel, texts: list[np.ndarray], masks: list[np.ndarray], batch_size: int, batch_tokens: int) -> list[tuple]:
    """length, mean over all predicted tokens, mean over those of the response (of all where it has none), and how many these are."""
    lengths = np.array([len(x) for x in texts], np.int64)
    out: list[tuple] = [(0, None, None, 0)] * len(texts)
    able = np.flatnonzero(lengths >= 2)
    for part in batches_by_length(lengths[able], batch_size, batch_tokens):
        part = able[part]
        ids = np.zeros((len(part), int(lengths[part].max())), np.int64)
        for row, at in enumerate(part):
            ids[row, : lengths[at]] = texts[at]
        nll = model.nll(ids, lengths[part])
        for row, at in enumerate(part):
            own, mask = nll[row, : lengths[at] - 1], masks[at][1:]
            n = int(mask.sum())
            mean = float(own.sum()) / len(own)
            out[at] = (int(lengths[at]), mean, float(own[mask].sum()) / n if n else mean, n)
    return out


def _response(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which tokens are the response: those of the spans, else the last RESPONSE_SHARE."""
    mask = np.zeros(n, bool)
    if spans is None:
        mask[int(n * (1 - RESPONSE_SHARE)) :] = True
    else:
        for s in spans:
            if s is not None:
                mask[max(0, s["start"]) : max(0, s["stop"])] = True
    return mask


def score_sequences(docs: DataFrame, load: Loader, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, batch_size: int = 64, batch_tokens: int = 65_536, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """sample, length, avg_nll, response_nll, response_token_count, ppl, response_ppl; inf where under two tokens.

    `spans_col` may hold an array of structs start, stop: the tokens of the response. Null, empty and one-token texts keep
    their row; repeated ids are rows of their own. Nothing is shuffled."""
    key, kind = (next(_serial), id(load)), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept_in_worker("model", key, load)
        ids: list = []
        texts: list[np.ndarray] = []
        masks: list[np.ndarray] = []
        held = 0

        def told() -> pa.RecordBatch:
            columns = zip(*_scored(model, texts, masks, batch_size, batch_tokens), strict=True)
            types = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, of), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["sample", "length", "avg_nll", "response_nll", "response_token_count"])

        for batch in batches:
            of = batch.schema.field(0).type
            for row in range(batch.num_rows):
                tokens = model.encode(batch.column(1)[row].as_py() or "")
                ids.append(batch.column(0)[row].as_py())
                texts.append(tokens)
                masks.append(_response(len(tokens), batch.column(2)[row].as_py() if spans_col else None))
                held += len(tokens) + 16
                if held >= buffer_tokens:
                    yield told()
                    ids, texts, masks, held = [], [], [], 0
        if ids:
            yield told()

    columns = [F.col(id_col).alias("sample"), F.col(text_col).alias("text"), *([F.col(spans_col).alias("spans")] if spans_col else [])]
    return finished(docs.select(*columns).mapInArrow(run, f"sample {kind}, {_RESULT}"))


def finished(rows: DataFrame) -> DataFrame:
    """The scores as they are kept: rounded, with perplexities of at most e**20."""
    fine = F.col("length") >= 2

    def ppl(c: str) -> Column:
        return F.when(fine, F.round(F.exp(F.least(F.col(c), F.lit(20.0))), 2)).otherwise(F.lit(float("inf")))

    return rows.select("sample", "length", F.round("avg_nll", 4).alias("avg_nll"), F.round("response_nll", 4).alias("response_nll"), "response_token_count", ppl("avg_nll").alias("ppl"), ppl("response_nll").alias("response_ppl"))


#: Classes of tokens; a model has the square of this many counts.
CLASSES = 509
_token = re.compile(TOKEN, re.ASCII)


def token_class(token: str) -> int:
    return (31 * ord(token[0]) + 7 * ord(token[-1]) + len(token)) % CLASSES


def token_classes(text: str) -> np.ndarray:
    found = _token.findall(text)
    known = {t: token_class(t) for t in set(found)}
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


class ClassBigrams:
    """p(class of a token | class of the one before), with one added to each count."""

    def __init__(self, counts: np.ndarray):
        n = counts.astype(np.float64) + 1.0
        self._nll = -np.log(n / n.sum(axis=1, keepdims=True))

    def encode(self, text: str) -> np.ndarray:
        return token_classes(text)

    def nll(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self._nll[ids[:, :-1], ids[:, 1:]]


def class_bigrams(docs: DataFrame, text_col: str = "text") -> Loader:
    """A model of the whole corpus. Tasks count pairs of classes in a table of fixed size; the driver gets at most CLASSES**2 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                at = token_classes(text.as_py() or "")
                pairs, n = np.unique(at[:-1] * CLASSES + at[1:], return_counts=True)
                counts[pairs] += n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["pair", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    counts = np.zeros(CLASSES * CLASSES, np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(counts.reshape(CLASSES, CLASSES))
    return lambda: ClassBigrams(sent.value)
