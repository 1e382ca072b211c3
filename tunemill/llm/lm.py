"""Language-model scoring by a weighted backoff automaton.

States are the contexts of up to ORDER - 1 tokens that the training text holds; a state's arcs are the n-grams seen
after it. Failure arcs lead to the state of the context without its first token and carry the backoff weight. With
Dirichlet smoothing, p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu), an arc's weight holds the whole sum and a
failure arc's weight is mu / (c(h) + mu), so the probabilities of each state add up to one. One pass from left to right
carries each text's state: it takes the token's arc or, as long as there is none, the failure arc, and adds up the log10
weights. The texts of a block go in step, so that a step is a few array operations for all of them.

No task or driver holds the model. Documents are dealt into blocks of bounded size by a hash of id and text; a block asks,
as sorted arrays of n-gram hashes, for just the states and arcs that its texts can reach, the shares of the counts are
merged by hash range, and the answers come back in the order of the questions. A frequent n-gram is one entry of each
block, however often it occurs. Empty hash ranges ask nothing, so what is shuffled grows with the text, however many
blocks and ranges there are.

Tokens are told apart by 64 bits. Longer n-grams, which only weigh the model, keep SPARE_BITS more bits than it takes to
number all bytes of the text, so that one in 2**SPARE_BITS of them, about, shares another's count. Sorted hashes are sent
as differences, low bytes and the rest in unary.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunemill.llm.shingles import Words, grams, tokens

ORDER = 3
#: Weight of the shorter context's estimate for n-grams of each n; the last one for all longer ones.
MU = (None, None, 1024.0, 256.0, 64.0)
SPARE_BITS = 14
#: Text of a block in bytes, and bytes of text to a hash range.
BLOCK_BYTES, RANGE_BYTES = 6 << 20, 24 << 20
_END, _START = np.uint64(0x1D8AF066), np.uint64(0x5B3C99A1)


def _block_arrays(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each text (its words and one end), and for n = 1.. the hash of the n-gram that ends at each token.

    An n-gram starts at the text's start mark at the earliest; near the start the longest one there is stands in.
    """
    words, lengths, parts = Words(), [], []
    for t in texts:
        h = words.hashes(tokens(t))
        lengths.append(len(h) + 1)
        parts.append(np.concatenate([np.full(order - 1, _START), h, [_END]]).astype(np.uint64))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    pad = order - 1
    n_tokens = np.array(lengths, np.int64)
    begins = np.cumsum(n_tokens + pad) - (n_tokens + pad)
    at = np.repeat(begins + pad - (np.cumsum(n_tokens) - n_tokens), n_tokens) + np.arange(n_tokens.sum())
    out = []
    for n in range(1, order + 1):
        g = grams(flat, n) if len(flat) >= n else np.zeros(0, np.uint64)
        out.append(g[at - n + 1])
    return n_tokens, out


def _bits(total: int, block_bytes: int) -> tuple[int, int]:
    """Bits of an n-gram's hash for so many bytes of text, and how many whole low bytes of a difference are sent."""
    in_block = max(1, block_bytes // 6).bit_length()
    low = max(1, -(-(total.bit_length() + SPARE_BITS - in_block) // 8))
    return min(64, in_block + 8 * low), low


def _encoded(v: np.ndarray, low: int) -> bytes:
    """Sorted distinct numbers: how many, the low bytes of their differences, and the rest as zeros before a one."""
    d = np.diff(v, prepend=np.uint64(0))
    lows = d.view(np.uint8).reshape(-1, 8)[:, :low].tobytes()
    ends = np.cumsum((d >> np.uint64(8 * low)) + np.uint64(1)).astype(np.int64) - 1
    marks = np.zeros(int(ends[-1]) + 1, np.uint8)
    marks[ends] = 1
    return len(v).to_bytes(4, "little") + lows + np.packbits(marks).tobytes()


def _decoded(data: bytes, low: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    d = np.zeros((n, 8), np.uint8)
    d[:, :low] = np.frombuffer(data, np.uint8, n * low, 4).reshape(n, low)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + n * low)))[:n]
    rest = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    return np.cumsum(d.view(np.uint64).ravel() | rest << np.uint64(8 * low), dtype=np.uint64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts of at most 64 bits, all their lowest bytes first, as many bytes of each as the largest one needs; the higher ones are nearly all zero."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zlib.compress(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    low = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1).T
    out = np.zeros((len(low), 8), np.uint8)
    out[:, : data[0]] = low
    return out.view(np.uint64).ravel()


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of hashes, what all lists together count of each; in 64 bits, and refused beyond."""
    _, place = np.unique(np.concatenate(hashes), return_inverse=True)
    each = np.concatenate(counts).astype(np.uint64)
    sums = np.zeros(int(place.max(initial=-1)) + 1, np.uint64)
    np.add.at(sums, place, each)
    if len(each) and float(each.max()) * len(counts) >= 2.0**63:
        raise OverflowError("counts of an n-gram do not fit 63 bits")
    return np.split(sums[place], np.cumsum([len(h) for h in hashes])[:-1])


def _totals(rows: DataFrame) -> tuple[int, int, int]:
    """Training texts, their tokens, and how many of these are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                parts = [words.hashes(tokens(t)) for t in batch.column(0).slice(lo, 1024).to_pylist()]
                found = np.unique(np.concatenate([*parts, [_END]]).astype(np.uint64)).view(np.int64)
                none = np.zeros(len(found) - 1, np.int64)
                sums = [np.append(none, x) for x in (len(parts), sum(map(len, parts)) + len(parts))]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[0]), pa.array(sums[1])], names=["token", "texts", "tokens"])

    found = rows.filter("not held_out").select("text").mapInArrow(run, "token long, texts long, tokens long")
    found = found.groupBy("token").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    got = found.agg(F.count(F.lit(1)).alias("seen"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens")).first()
    return int(got.texts or 0), int(got.tokens or 0), int(got.seen)


def score_texts(
    docs: DataFrame,
    held_out: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    mu: tuple[float | None, ...] = MU,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document.

    The model learns from the rows for which held_out(id as text) is false. Null text counts as empty and has
    the end token alone. A null id is hashed as the empty string. Rows that repeat an id are scored one by one
    and counted each. Long texts are scored whole. With no training text the counts are 0 and every token
    falls back to the unknown token. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    n_blocks, range_bits = 1 + int(total) // block_bytes, (int(total) // RANGE_BYTES).bit_length()
    n_ranges = 1 << range_bits
    gram_bits, low = _bits(int(total), block_bytes)
    range_bits_of = lambda n: (64 if n == 1 else gram_bits) - range_bits
    kind = docs.schema[id_col].dataType.simpleString()
    block = F.pmod(F.xxhash64(name, text), F.lit(n_blocks)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), text.alias("text"), held_out(name).alias("held_out"), block.alias("block"))
    starts, total_tokens, seen = _totals(rows)
    rows = rows.repartition(n_blocks, "block")

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([("name", "ascending"), ("text", "ascending")])

    def kept_bits(g: np.ndarray, n: int) -> np.ndarray:
        return g if n == 1 else g >> np.uint64(64 - gram_bits)

    def ask(table: pa.Table) -> pa.Table:
        table = ordered(table)
        n_tokens, per_order = _block_arrays(table.column("text").to_pylist(), order)
        learn = np.repeat(~table.column("held_out").to_numpy(), n_tokens)
        out: dict[str, list] = {"range": [], "block": [], "n": [], "hashes": [], "counts": []}
        for n, g in enumerate(per_order, 1):
            unique, place = np.unique(kept_bits(g, n), return_inverse=True)
            counts = np.bincount(place, learn, len(unique)).astype(np.uint64)
            number = (unique >> np.uint64(range_bits_of(n))).astype(np.int64) if range_bits else np.zeros(len(unique), np.int64)
            cut = np.flatnonzero(np.diff(number)) + 1  # only ranges that the block has
            for h, c, r in zip(np.split(unique, cut), np.split(counts, cut), number[np.append(0, cut)].tolist() if len(unique) else [0], strict=True):
                if not len(h):
                    continue
                out["range"].append(r)
                out["block"].append(int(table.column("block")[0].as_py()))
                out["n"].append(n)
                out["hashes"].append(h.tobytes() if n == 1 else _encoded(h - (np.uint64(r) << np.uint64(range_bits_of(n))), low))
                out["counts"].append(_packed(c))
        return pa.table(out, schema=pa.schema([("range", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        """Counts over all blocks, in the order of each question."""
        blocks = table.column("block").to_pylist()
        hashes = [np.frombuffer(h, np.uint64) if n == 1 else _decoded(h, low) for h, n in zip(table.column("hashes").to_pylist(), table.column("n").to_pylist(), strict=True)]
        counts = [_unpacked(c) for c in table.column("counts").to_pylist()]
        parts = _summed(hashes, counts)
        out = {"block": blocks, "range": table.column("range"), "n": table.column("n"), "counts": [_packed(p) for p in parts]}
        return pa.table(out, schema=pa.schema([("block", pa.int32()), ("range", pa.int32()), ("n", pa.int32()), ("counts", pa.binary())]))

    def traverse(texts: pa.Table, arcs: pa.Table) -> pa.Table:
        table = ordered(texts)
        n_tokens, per_order = _block_arrays(table.column("text").to_pylist(), order)
        got = arcs.select(["n", "range", "counts"]).sort_by([("n", "ascending"), ("range", "ascending")]).to_pylist()
        counts, places = [], []
        for n, g in enumerate(per_order, 1):
            whole = np.concatenate([_unpacked(x["counts"]) for x in got if x["n"] == n] or [np.zeros(0, np.uint64)]).astype(np.int64)
            counts.append(whole)
            places.append(np.unique(kept_bits(g, n), return_inverse=True)[1])
        begins = np.cumsum(n_tokens) - n_tokens
        base = np.log10((counts[0][places[0]] + 1.0) / (total_tokens + seen + 1.0))
        known = (counts[0] > 0)[places[0]]
        log_p = Automaton(counts, places, begins, mu, starts, unigram(counts[0], total_tokens, seen)).walk(n_tokens)
        add = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(add(known.astype(np.int64))),
            "train_tokens": pa.array(np.full(len(n_tokens), total_tokens, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(log_p)),
        })

    asked = rows.groupBy("block").applyInArrow(ask, "range int, block int, n int, hashes binary, counts binary")
    key = F.col("n") * n_ranges + F.col("range")
    arcs = asked.withColumn("part", key).groupBy("part").applyInArrow(answer, "block int, range int, n int, counts binary")
    out = rows.groupBy("block").cogroup(arcs.groupBy("block")).applyInArrow(traverse, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out


class Automaton:
    """The states and arcs that the texts of a block can reach.

    `counts` has for n = 1.. the training count of each different n-gram of the block, `places` the number of the
    n-gram that ends at each token. Arcs are numbered by n-gram, orders one after the other. State 0 is the empty
    context, then come the contexts of the texts' starts by length, then the n-grams below the order."""

    def __init__(self, counts: list[np.ndarray], places: list[np.ndarray], begins: np.ndarray, mu: tuple[float | None, ...], starts: int, unigrams: np.ndarray):
        order = len(counts)
        first_arc = np.cumsum([0] + [len(c) for c in counts])
        first_state = order + first_arc  # of the n-grams as contexts: after the empty one and order - 1 starts
        self.arcs = [p + first_arc[n] for n, p in enumerate(places)]
        self.begins, self.start = begins, order - 1
        is_first = np.zeros(len(places[0]), bool)
        is_first[begins] = True
        n_states = int(first_state[order - 1]) if order > 1 else 1
        self.depth = np.zeros(n_states, np.int64)
        self.fail, self.fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        seen = np.zeros(n_states, np.int64)  # how often training text passes a state
        self.depth[:order] = np.arange(order)
        self.fail[1:order] = np.arange(order - 1)
        seen[1:order] = starts
        one = []  # a token at which each n-gram ends
        for n in range(order):
            at = np.zeros(len(counts[n]), np.int64)
            at[places[n]] = np.arange(len(places[n]))
            one.append(at)
        for n in range(order - 1):
            own = slice(first_state[n], first_state[n + 1])
            self.depth[own] = n + 1
            self.fail[own] = first_state[n - 1] + places[n - 1][one[n]] if n else 0
            seen[own] = counts[n]
        weight = np.array([0.0] + [mu[min(n + 1, len(mu) - 1)] or 1.0 for n in range(1, order)])[self.depth]
        self.fail_weight[1:] = np.log10(weight[1:] / (seen[1:] + weight[1:]))  # 0 for a context that was never seen
        self.taken = np.concatenate([np.ones(len(counts[0]), bool)] + [c > 0 for c in counts[1:]])
        self.to = np.zeros(len(self.taken), np.int64)
        p = [unigrams]
        for n in range(order):
            own = slice(first_arc[n], first_arc[n + 1])
            if n:
                at = one[n]
                state = np.where(is_first[at], n, first_state[n - 1] + places[n - 1][at - 1])
                p.append((counts[n] + weight[state] * p[n - 1][places[n - 1][at]]) / (seen[state] + weight[state]))
            if order > 1:
                self.to[own] = first_state[n] + np.arange(len(counts[n])) if n < order - 1 else first_state[n - 1] + places[n - 1][one[n]]
        self.weight = np.log10(np.concatenate(p))

    def walk(self, n_tokens: np.ndarray) -> np.ndarray:
        """log10 probability of each token. All texts go one token ahead at a time, the longest ones to the end."""
        out = np.zeros(len(self.arcs[0]))
        longest = np.argsort(-n_tokens, kind="stable")
        going = np.searchsorted(-n_tokens[longest], -np.arange(n_tokens.max(initial=0)), "left")  # texts with a token there
        begins = self.begins[longest]
        arcs = np.stack(self.arcs)
        state = np.full(len(longest), self.start, np.int64)
        for t, n in enumerate(going.tolist()):
            at = begins[:n] + t
            now = state[:n]
            arc = arcs[self.depth[now], at]
            left = np.flatnonzero(~self.taken[arc])
            while len(left):  # no arc for the token: on along the failure arc
                s = now[left]
                out[at[left]] += self.fail_weight[s]
                now[left] = s = self.fail[s]
                arc[left] = a = arcs[self.depth[s], at[left]]
                left = left[~self.taken[a]]
            out[at] += self.weight[arc]
            state[:n] = self.to[arc]
        return out


def unigram(counts: np.ndarray, total: int, seen: int, discount: float = 0.75) -> np.ndarray:
    """Absolute discounting; what it frees goes in equal parts to the seen tokens and one unknown token."""
    if total == 0:
        return np.ones(len(counts))
    free = discount * seen / total
    return np.maximum(counts - discount, 0) / total + free / (seen + 1)
