"""Texts to vectors, by any encoder.

An encoder is loaded once in each Python worker and gets texts in batches of like length and bounded size, so that one that pads
wastes little. The default one hashes features under a key: each distinct token adds or takes the square root of its count
at a place that the hash names, and the vector is scaled to length one. It needs no model and no pass over the corpus, and the
same key gives the same vectors anywhere.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.operators.ordering import CHUNK, similarity_order
from tunemill.operators.scoring import TOKEN
from tunemill.operators.sequence import batches_by_length, kept_in_worker

#: Texts, and characters of the longest one times texts, that an encoder gets at once.
BATCH, BATCH_CHARS, BUFFER_CHARS = 256, 1 << 20, 1 << 23
_token = re.compile(TOKEN, re.ASCII)


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """A vector for each text."""


class HashingEncoder:
    def __init__(self, size: int = 64, key: str = "features"):
        self.size, self.key = size, key
        self._known: dict[str, tuple[int, float]] = {}

    def _place(self, token: str) -> tuple[int, float]:
        if token not in self._known:
            if len(self._known) >= 500_000:
                self._known.clear()
            h = int(hashlib.md5(f"{self.key}:{token}".encode()).hexdigest()[:8], 16)
            self._known[token] = (h // 2 % self.size, 1.0 if h % 2 else -1.0)
        return self._known[token]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            for token, n in Counter(_token.findall(text)).items():
                at, sign = self._place(token)
                out[row, at] += sign * n**0.5
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def embed(docs: DataFrame, load: Callable[[], Encoder] = HashingEncoder, id_col: str = "doc_id", text_col: str = "text", most_chars: int | None = None) -> DataFrame:
    """id and embedding (array<double>) of each row; texts without a token get zeros. Nothing is shuffled.

    With `most_chars` an encoder sees no more of a text than so many characters, which are cut before they leave the JVM."""
    kind, key = dict(docs.dtypes)[id_col], uuid.uuid4().hex
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("encoder", key, load)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts: list[str] = []
                held = 0
                while begin + len(texts) < batch.num_rows and held < BUFFER_CHARS:
                    texts.append(batch.column(1)[begin + len(texts)].as_py())
                    held += len(texts[-1]) + 64
                lengths, vectors = np.array([len(t) for t in texts]), [None] * len(texts)
                for part in batches_by_length(lengths, BATCH, BATCH_CHARS):
                    for at, v in zip(part, encoder.encode([texts[i] for i in part]), strict=True):
                        vectors[at] = v
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(vectors, pa.list_(pa.float64()))], names=[id_col, "embedding"])
                begin += len(texts)

    return docs.select(id_col, F.substring(text, 1, most_chars) if most_chars else text).mapInArrow(run, f"{id_col} {kind}, embedding array<double>")


def text_order(docs: DataFrame, load: Callable[[], Encoder] = HashingEncoder, low: float = 0.3, high: float = 0.9, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, seed: int = 0, most_chars: int | None = None) -> DataFrame:
    """chunk, place of each text: similarity_order of the texts' vectors."""
    return similarity_order(embed(docs, load, id_col, text_col, most_chars), low, high, id_col, "embedding", chunk, seed)
