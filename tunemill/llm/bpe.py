"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts each text where its low bits are zero, so equal passages fall into equal
chunks wherever they stand. A task encodes each distinct chunk once and keeps its inner part: from the
first to the last position at which every tokenisation has a boundary (a letter or digit, then a space,
then a letter). What lies between two inner parts is the join; it grows over whole chunks until both its
ends are such positions and is then encoded anew, so that the result agrees with encoding the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.workers import releasing

#: A chunk has about this many bytes; a power of two.
CHUNK = 256
#: Chunks and joins that a task keeps; then it starts anew, which costs time but no exactness.
KEEP = 16_384
END_TEXT, END_ID = "<|endoftext|>", 50256

_SYNC = re.compile(rb"[A-Za-z0-9](?= [A-Za-z])")


def cuts(data: bytes, chunk: int = CHUNK) -> list[int]:
    """Ends of the chunks of UTF-8 data. They depend on the 16 bytes before them only, and never split a character."""
    n = len(data)
    if n <= 16:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = raw.astype(np.uint32) * np.uint32(2654435761)
    for k, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (4, 0xC2B2AE35), (8, 0x27D4EB2F)):
        h = h[:-k] * np.uint32(factor) + h[k:]
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h & np.uint32(chunk - 1)) == 0) + 16
    at = at[at < n]
    at = at[(raw[at] & 0xC0) != 0x80]
    return [*at.tolist(), n]


class ChunkEncoder:
    """Encodes whole texts; keeps the ids of chunks and joins that it has seen."""

    def __init__(self, ranks_path: str, chunk: int = CHUNK, keep: int = KEEP):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of: list[bytes] = [b""] * (max([*ranks.values(), END_ID]) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.bytes_of[END_ID] = END_TEXT.encode()
        self.chunk, self.keep = chunk, keep
        self.inner: dict[bytes, tuple[int, int, array]] = {}
        self.joins: dict[bytes, array] = {}
        self.reused = self.made = 0

    def _join(self, data: bytes) -> array:
        ids = self.joins.get(data)
        if ids is None:
            if len(self.joins) >= self.keep:
                self.joins.clear()
            ids = array("I", self._encode(data.decode()))
            if len(data) <= 4 * self.chunk:
                self.joins[data] = ids
        return ids

    def _inner(self, data: bytes) -> tuple[int, int, array]:
        """First and last safe position, and the ids between them; (-1, -1, none) if there is none."""
        found = self.inner.get(data)
        if found is not None:
            self.reused += 1
            return found
        self.made += 1
        first = _SYNC.search(data)
        if first is None:
            found = (-1, -1, array("I"))
        else:
            lo = first.end()
            tail = len(data)
            hi = lo
            step = 64
            while True:  # the last safe position, from the end backwards
                start = max(0, tail - step)
                last = None
                for last in _SYNC.finditer(data, start):
                    pass
                if last is not None:
                    hi = last.end()
                    break
                step *= 4
            found = (lo, hi, array("I", self._encode(data[lo:hi].decode()) if hi > lo else []))
        if len(self.inner) >= self.keep:
            self.inner.clear()
        self.inner[data] = found
        return found

    def encode(self, text: str) -> array:
        ids = array("I")
        parts = text.split(END_TEXT) if END_TEXT in text else [text]
        for k, part in enumerate(parts):
            if k:
                ids.append(END_ID)
            data = part.encode()
            begin, join_from = 0, 0
            for end in cuts(data, self.chunk):
                lo, hi, inner = self._inner(data[begin:end])
                if lo >= 0:
                    if begin + lo > join_from:
                        ids += self._join(data[join_from : begin + lo])
                    ids += inner
                    join_from = begin + hi
                begin = end
            if join_from < len(data):
                ids += self._join(data[join_from:])
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int; null unless with_ids), ids_sha256, decoded_sha256; one row per document.

    Null text counts as empty, which has no token. Ids may be null or repeat; each row is encoded by
    itself. Texts of any length are encoded whole. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(ranks_path, chunk)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, all_ids, ids_sha, text_sha = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = coder.encode(text or "")
                    packed = np.frombuffer(ids, np.uint32).astype("<u4")
                    n.append(len(ids))
                    all_ids.append(packed.astype(np.int32) if with_ids else None)
                    ids_sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(all_ids, pa.list_(pa.int32())), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(releasing(run), f"doc_id {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
