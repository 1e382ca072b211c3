"""Label masks over a real sub-word tokenizer.

A conversation is rendered once, and its pieces are encoded to token numbers; a token's place is the bytes that it stands
for, so offsets are sums of byte lengths and hold inside characters as well. What carries loss is a set of byte spans: the
answers, each with its end-of-turn token and the line end after that. A token is trained if it shares a byte with a trained
span and none with a masked one. Spans and tokens are both in order, so two binary searches give the tokens of each span.
The end-of-turn token is set between the pieces: its string within a text is ordinary text and ends no turn.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.operators.messages import OBSERVED_ROLES
from tunemill.operators.sequence import kept_in_worker

IGNORE = -100
_THINK = re.compile(rb"<think>.*?</think>[ \t\r\n]*", re.S)


class SubwordTokenizer(Protocol):
    end_of_turn: int

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers, and how many bytes of UTF-8 each stands for; these add up to the text's."""


class RankTokenizer:
    """Byte-level BPE from a file of ranks; `end_of_turn` is a number that no rank has."""

    def __init__(self, path: str, pattern: str, end_of_turn: int):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._bytes = np.zeros(max([*ranks.values(), end_of_turn]) + 1, np.int64)
        for b, i in ranks.items():
            self._bytes[i] = len(b)
        self.end_of_turn = end_of_turn

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self._encode(text), np.int64)
        return ids, self._bytes[ids]


@dataclass(frozen=True)
class Masking:
    """Which turns carry loss: those of `roles`; with last_only the last of them only. Turns of observed roles carry it as well
    with observe, whatever last_only says. Without reasoning, <think> parts and the blanks after them do not; a turn of which
    nothing is left is not trained at all."""

    roles: Sequence[str] = ("assistant",)
    observe: bool = False
    last_only: bool = False
    reasoning: bool = True


def tokens_of(starts: np.ndarray, ends: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a byte with one of the spans. Tokens are in order and do not overlap; empty spans have none."""
    flags = np.zeros(len(starts) + 1, np.int64)
    if len(spans):
        begin, end = np.array([s for s in spans if s[0] < s[1]] or np.zeros((0, 2)), np.int64).T
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
        np.add.at(flags, first, 1)
        np.add.at(flags, np.maximum(first, last), -1)
    return np.cumsum(flags[:-1]) > 0


def _trained(turns: list[tuple[str, str]], how: Masking) -> list[bool]:
    own = [i for i, (role, _) in enumerate(turns) if role in how.roles]
    kept = set(own[-1:] if how.last_only else own)
    return [i in kept or how.observe and role in OBSERVED_ROLES and role not in how.roles for i, (role, _) in enumerate(turns)]


def labelled(tokenizer: SubwordTokenizer, turns: list[tuple[str, str]], how: Masking) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of a rendered conversation and whether each is trained."""
    ids, sizes, spans, masked, at = [], [], [], [], 0
    for (role, content), train in zip(turns, _trained(turns, how), strict=True):
        head, body = f"<{role}>\n", content.encode()
        got, size = tokenizer.encode(head + content)
        tail, tail_size = tokenizer.encode("\n")
        begin = at + len(head.encode())
        thinking = [] if how.reasoning else [m.span() for m in _THINK.finditer(body)]
        left = len(body) - sum(b - a for a, b in thinking)
        if train and left:
            spans += [(begin, begin + len(body)), (begin + len(body), begin + len(body) + 1 + int(tail_size.sum()))]
            masked += [(begin + a, begin + b) for a, b in thinking]
        ids += [got, [tokenizer.end_of_turn], tail]
        sizes += [size, [1], tail_size]  # the end of turn stands for one byte, so that it has a place
        at = begin + len(body) + 1 + int(tail_size.sum())
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.cumsum(np.concatenate(sizes).astype(np.int64))
    starts = ends - np.concatenate(sizes).astype(np.int64)
    return np.concatenate(ids).astype(np.int64), tokens_of(starts, ends, spans) & ~tokens_of(starts, ends, masked)


def subword_labels(conversations: DataFrame, load: Callable[[], SubwordTokenizer], id_col: str = "conv_id", messages_col: str = "messages", how: Masking = Masking()) -> DataFrame:
    """id, input_ids, labels (the token where trained, else IGNORE); conversations without a trained token are dropped.

    messages: array of structs with role and content, as `gathered` gives; null ones count as empty. Whole conversations are
    read and none is cut; a tokenizer is loaded once in a worker."""
    kind, key = dict(conversations.dtypes)[id_col], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker("tokenizer", key, load)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, keep, ids, labels = batch.slice(lo, 64), [], [], []
                for row in range(part.num_rows):
                    turns = [(m["role"] or "", m["content"] or "") for m in part.column(1)[row].as_py() or [] if m is not None]
                    own, trained = labelled(tokenizer, turns, how)
                    if trained.any():
                        keep.append(row)
                        ids.append(own)
                        labels.append(np.where(trained, own, IGNORE))
                if keep:
                    arrays = [pa.array(x, pa.list_(pa.int64())) for x in (ids, labels)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *arrays], names=[id_col, "input_ids", "labels"])

    messages = F.transform(messages_col, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return conversations.select(id_col, messages.alias("m")).mapInArrow(run, f"{id_col} {kind}, input_ids array<bigint>, labels array<bigint>")
