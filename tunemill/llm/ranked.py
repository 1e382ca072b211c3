"""Ranked lexical search: the best documents of each query by exact integer scores, found by MaxScore in each shard.

Terms are runs of letters, digits and characters beyond ASCII; A-Z count as a-z. A first pass over the texts counts
documents, terms, and for each term of the queries the documents that hold it. A second pass cuts each task's documents
into shards of bounded text, makes the shard's postings of the queries' terms, and searches these. A posting's impact is
what its count and its document's length are worth; a list's upper bound is the term's weight times its largest impact.
A query's lists are sorted by bound. As long as the bounds of the lowest lists together stay below the score of the worst
document that the query keeps, these are non-essential: no document qualifies by them alone. The essential lists are
added up, and the others are probed, largest bound first, only at documents that can still reach that score. The kept
documents of a query, and so the threshold, go from shard to shard of a task. Of each task at most `keep` documents of a
query are sent; they are merged in two steps, by salt and then by query, so that no task gets those of all tasks of a query.

The queries are read in blocks of at most QUERY_BYTES of text, and each block is one more second pass; a block's terms
and weights are sent to all tasks. Texts are read whole; a shard holds a text of any length.

Defined results: a null or empty text has no term, does not count as a document and is never found; a query without terms
finds nothing. Documents of equal score go by id, null ids last; repeated ids are separate documents. Each query row is
a query of its own, also if its id or text is repeated or null. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunemill.llm.workers import releasing
from tunemill.session import written

KEEP = 50
#: Text of a block of queries and of a shard, in bytes.
QUERY_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
SALTS = 64
#: Everything in ASCII but digits and letters parts terms; A-Z become a-z.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="replace").translate(_TERM_BYTES).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def spread_of(n: int, docs: int, total: int) -> int:
    """What a document of n terms has in place of its length, 100 at the mean length."""
    return 50 + 50 * n * docs // total


@dataclass
class Shard:
    """Postings of the queries' terms in some documents; terms are numbers, documents places."""

    ids: list[int | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    found: list[tuple[list[int], list[int]]] = field(default_factory=list)
    n_bytes: int = 0

    def add(self, doc_id: int | None, text: str | None, known: dict[bytes, int]) -> None:
        words = terms(text)
        self.n_bytes += len(text or "")
        if words:
            counts = [(known[w], c) for w, c in Counter(words).items() if w in known]
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.found.append(tuple(map(list, zip(*counts, strict=True))) if counts else ([], []))

    def lists(self, docs: int, total: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each term, places in ascending order and impacts."""
        held = np.array([len(t) for t, _ in self.found], np.int64)
        if not held.sum():
            return {}
        place = np.repeat(np.arange(len(held)), held)
        term = np.concatenate([np.array(t, np.int64) for t, _ in self.found])
        tf = np.concatenate([np.array(c, np.int64) for _, c in self.found])
        m = np.array([spread_of(n, docs, total) for n in self.lengths], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
        order = np.argsort(term, kind="stable")
        term, place, impact = term[order], place[order], impact[order]
        cut = np.flatnonzero(np.diff(term)) + 1
        return {int(t[0]): (p, i) for t, p, i in zip(np.split(term, cut), np.split(place, cut), np.split(impact, cut), strict=True)}


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents that reach `least`, which is above 0. Lists are places and score parts of a query's terms."""
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    upto = np.cumsum([int(x[1].max()) for x in lists]) if lists else np.zeros(0, np.int64)
    split = int(np.searchsorted(upto, least))  # the lists before it are non-essential: together below `least`
    score = np.zeros(n_docs, np.int64)
    for place, part in lists[split:]:
        score[place] += part
    at = np.flatnonzero(score)
    got = score[at]
    for k in range(split - 1, -1, -1):
        can = got + upto[k] >= least
        at, got = at[can], got[can]
        place, part = lists[k]
        where = np.minimum(np.searchsorted(place, at), len(place) - 1)
        got = got + np.where(place[where] == at, part[where], 0)
    can = got >= least
    return at[can], got[can]


@dataclass
class Best:
    """The documents that a query keeps: scores descending, equal ones by id, null ids last."""

    keep: int
    rows: list[tuple[int, bool, int]] = field(default_factory=list)

    def least(self) -> int:
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.keep else 1

    def merge(self, ids: list[int | None], at: np.ndarray, got: np.ndarray) -> None:
        if len(at) > self.keep:  # of more than it keeps, only those from the score of the last one on are ordered
            edge = np.partition(got, len(got) - self.keep)[len(got) - self.keep]
            at, got = at[got >= edge], got[got >= edge]
        new = [(-int(s), ids[p] is None, ids[p] or 0) for p, s in zip(at, got, strict=True)]
        self.rows = sorted(self.rows + new)[: self.keep]


def _counts(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and of each known term the documents that hold it."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n_docs, n_terms = sent.value, 0, 0
        held = np.zeros(len(at) + 2, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if words := terms(text.as_py()):
                    n_docs, n_terms = n_docs + 1, n_terms + len(words)
                    held[[at[w] for w in set(words) if w in at]] += 1
        held[-2:] = n_docs, n_terms
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    out = np.zeros(len(known) + 2, np.int64)
    for r in docs.select("text").mapInArrow(releasing(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    sent.unpersist()
    return int(out[-2]), int(out[-1]), out[:-2]


def _search(docs: DataFrame, queries: list[tuple[int, list[bytes]]], keep: int, shard_bytes: int) -> DataFrame:
    """For one block of queries (number, terms): number, score, doc_id of what each task keeps."""
    known = {w: k for k, w in enumerate(sorted({w for _, words in queries for w in words}))}
    n_docs, total, held = _counts(docs, known)
    weights = [weight(n_docs, int(n)) for n in held]
    asks = [(q, [known[w] for w in dict.fromkeys(words)]) for q, words in queries]
    sent = docs.sparkSession.sparkContext.broadcast((known, weights, asks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, asks = sent.value
        best, shard = [Best(keep) for _ in asks], Shard()

        def search() -> None:
            lists = {t: (p, i * weights[t]) for t, (p, i) in shard.lists(n_docs, total).items() if weights[t]}
            for kept, (_, wanted) in zip(best, asks, strict=True):
                kept.merge(shard.ids, *max_score([lists[t] for t in wanted if t in lists], len(shard.ids), kept.least()))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), text.as_py(), known)
                if shard.n_bytes >= shard_bytes:
                    search()
                    shard = Shard()
        search()
        rows = [(q, -s, None if without else i) for kept, (q, _) in zip(best, asks, strict=True) for s, without, i in kept.rows]
        for lo in range(0, len(rows), 10_000):
            q, s, i = zip(*rows[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], names=["query", "score", "doc_id"])

    return docs.mapInArrow(releasing(run), "query long, score long, doc_id long")


def _top(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: int = KEEP,
    query_bytes: int = QUERY_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: of each query the `keep` documents of highest score above 0, all if fewer."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "queries")
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).first().n or 0
    blocks = -(-int(size) // query_bytes)
    found = None
    for b in range(blocks):  # by a hash of the number, so that blocks are alike; one query is never split
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "text")
        rows = _search(texts, [(r.query, terms(r.text)) for r in block.collect()], keep, shard_bytes)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query long, score long, doc_id long")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = _top(_top(salted, ["query", "salt"], keep).drop("rank", "salt"), ["query"], keep)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
