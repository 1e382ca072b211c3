"""Removal of repeated substrings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Suffixes whose first LENGTH bytes are equal must meet in one task. The window of LENGTH bytes at each start
picks its minimizer, the leftmost smallest hash of GRAM bytes in it; as this depends on the window alone,
equal windows have equal minimizers. Neighbouring windows with one minimizer form a segment, so each start
is in one segment. Blocks of documents first ask which minimizers occur elsewhere; only segments with such
a minimizer are shuffled, by minimizer.

A window of a minimizer that stands in very many segments goes by its own 128-bit hash instead, without its bytes: all
that is asked of it is where it stands first. Each block names a window once. From PART_BLOCKS blocks on (half a terabyte of
text), such places are combined in two steps, by (hash, share of the blocks) and by hash, so that a string which every
block holds reaches no task with more rows than that; the blocks are then searched twice, once for these windows.

A task collapses equal segments, joins the different ones of its minimizers into one text, and builds its
Burrows-Wheeler transform. Breadth-first backward extension of intervals, from the empty string on, sets
each longest common prefix of neighbouring suffixes in increasing order: an interval that ends where nothing
is set yet gets the length of its string and is extended further. It stops at LENGTH, and what is unset then
separates nothing: those runs of suffixes share LENGTH bytes. All but the earliest start of a run cover
repeated bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunemill.llm.shingles import mixed

LENGTH, GRAM = 100, 32
#: Text of a block, text to a hash range of minimizers, and bytes that one transform takes (more only for one minimizer).
BLOCK_BYTES, RANGE_BYTES, CHUNK_BYTES = 2 << 20, 16 << 20, 1 << 19
#: Segments of one minimizer from which each of its windows goes by its own hash instead.
HOT = 16384
#: Blocks whose places of such a window meet in one task; with more blocks they meet share by share first.
PART_BLOCKS = 1 << 18
_BASE = 0x100000001B3
_SLICE = 1 << 18


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, minimizer hash, first window start, last window start) of texts that lie in data at begins..ends.

    Starts count from the begin of data; windows do not cross texts."""
    out: list[tuple[np.ndarray, ...]] = []
    doc = 0
    while doc < len(begins):
        last = max(doc + 1, int(np.searchsorted(ends, begins[doc] + _SLICE, "right")))
        for lo in range(int(begins[doc]), int(ends[last - 1]), _SLICE) if last == doc + 1 else [int(begins[doc])]:
            hi = min(lo + _SLICE + LENGTH - 1, int(ends[last - 1])) if last == doc + 1 else int(ends[last - 1])
            if hi - lo >= LENGTH:
                found = _windows(data[lo:hi])
                start = np.arange(lo, lo + len(found[0]))
                owner = np.searchsorted(begins[doc:last], start, "right") - 1 + doc
                fine = start + LENGTH <= ends[owner]
                start, owner, at, h = start[fine], owner[fine], found[0][fine] + lo, found[1][fine]
                if len(start):
                    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1])])
                    first = np.flatnonzero(new)
                    out.append((owner[first], h[first], start[first], start[np.append(first[1:], len(start)) - 1]))
        doc = last
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _windows(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the minimizer of each window of raw."""
    h, factor = raw.astype(np.uint64) + np.uint64(1), _BASE
    for k in (1, 2, 4, 8, 16):
        h = h[:-k] * np.uint64(factor) + h[k:]
        factor = factor * factor % (1 << 64)
    h = mixed(h)
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    wide, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= wide:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < wide:
        key = np.minimum(key[: len(key) - (wide - reach)], key[wide - reach :])
    at = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    return at, h[at]


def suffix_order(text: np.ndarray, end_of: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order of all suffixes of text (bytes + 1; 0 ends a segment, and the ends are ordered by segment)."""
    n, n_segments = len(text), int(segment[-1]) + 1
    padded = np.concatenate([text.astype(np.int64), np.zeros(8, np.int64)])
    left = end_of - np.arange(n)  # symbols up to the segment's end
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | np.where(left > i, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    start = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    depth = 7
    while True:
        # suffixes whose rank is not settled: their group, and the order within it by what follows
        single = np.concatenate([start[1:], [True]]) & start
        open_at = np.flatnonzero(~single)
        if not len(open_at):
            return order
        own = order[open_at]
        ahead = np.minimum(own + depth, n - 1)
        second = np.where(left[own] < depth, segment[own], n_segments + rank[ahead])
        # an end within depth symbols makes equal suffixes differ by segment; the end itself is a symbol too
        again = np.lexsort((second, rank[own]))
        own, second = own[again], second[again]
        group = rank[own]
        order[open_at] = own
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        start[open_at] = new
        rank[own] = np.maximum.accumulate(np.where(new, open_at, 0))
        depth *= 2


def unset_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place i of the suffix order, whether suffixes i - 1 and i share `length` symbols.

    Works on the transform alone: last[i] is the symbol before suffix i, and step[i] the place of the suffix
    that begins with it. All new intervals of one string length are extended together."""
    n = len(text)
    last = text[order - 1]
    by_symbol = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    places = {int(c): np.flatnonzero(last == c) for c in np.unique(last) if c}
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        sizes = hi - lo
        new_lo, new_hi = [], []
        if sizes.sum() > 4 * len(lo) * len(places):
            for at in places.values():
                i, j = np.searchsorted(at, lo), np.searchsorted(at, hi)
                some = j > i
                new_lo.append(step[at[i[some]]])
                new_hi.append(step[at[j[some] - 1]] + 1)
        else:
            which = np.repeat(np.arange(len(lo)), sizes)
            p = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            c = last[p]
            key = (which << 9) | c
            fine = c > 0
            key, p = key[fine], p[fine]
            by_key = np.argsort(key, kind="stable")
            key, p = key[by_key], p[by_key]
            if len(key):
                first = np.concatenate([[True], key[1:] != key[:-1]])
                final = np.concatenate([first[1:], [True]])
                new_lo.append(step[p[first]])
                new_hi.append(step[p[final]] + 1)
        if not new_lo:
            break
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
        hi, keep = np.unique(hi, return_index=True)
        lo = lo[keep]
        if not len(lo):
            break
    return ~known[:n]


def repeats(parts: list[bytes], doc: np.ndarray, row: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rows (part, start, end): bytes of the different parts, each given with its earliest place, that are repeated."""
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.int16)
    segment = np.repeat(np.arange(len(parts)), size + 1)
    end_of = (begin + size)[segment]
    inside = np.arange(len(text)) < end_of
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    order = suffix_order(text, end_of, segment)
    same = unset_prefixes(text, order, length)
    run = np.cumsum(~same)
    window = end_of[order] - order >= length
    suffix, run = order[window], run[window]
    part = segment[suffix]
    offset = suffix - begin[part]
    by_place = np.lexsort((at[part] + offset, row[part], doc[part], run))
    run, part, offset = run[by_place], part[by_place], offset[by_place]
    later = np.concatenate([[False], run[1:] == run[:-1]])
    part, offset = part[later], offset[later]
    if not len(part):
        return np.zeros((0, 3), np.int64)
    by_part = np.lexsort((offset, part))
    part, offset = part[by_part], offset[by_part]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (offset[1:] != offset[:-1] + 1)])
    first = np.flatnonzero(new)
    return np.stack([part[first], offset[first], offset[np.append(first[1:], len(part)) - 1] + length], 1)


_FLAGS = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; null unless with_text), kept_sha256; one row per row of docs.

    Earlier means a smaller id, or the same row and an earlier start. Ids are integers; a null id comes after
    all others, and rows that repeat an id come in the order of a hash of id and text, then of their texts. Blocks are
    ranges of that hash, so rows of one id, null ids among them, are spread by their texts. Null text counts as empty; texts
    under LENGTH bytes keep all. Texts of any length are taken whole. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n)
    n_blocks, range_bits = 1 + total // BLOCK_BYTES, (total // RANGE_BYTES).bit_length()
    kind = docs.schema[id_col].dataType.simpleString()
    block = F.expr(f"cast(((shiftright(tie, 32) + 2147483648) * {n_blocks}L) div 4294967296 as int)")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("tie")).withColumn("block", block).repartition(n_blocks, "block")

    def opened(table: pa.Table) -> tuple[pa.Table, bytes, np.ndarray, np.ndarray]:
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        texts = table.column("text").to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        return table, b"".join(texts), ends - [len(t) for t in texts], ends

    def ranges(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges that sorted hashes have, and where the next one begins."""
        of = sorted_hashes >> np.uint64(64 - range_bits) if range_bits else np.zeros(len(sorted_hashes), np.uint64)
        cut = np.flatnonzero(of[1:] != of[:-1]) + 1
        return of[np.concatenate([[0], cut]).astype(np.int64)] if len(of) else of, cut

    def ask(table: pa.Table) -> pa.Table:
        table, data, begins, ends = opened(table)
        raw = np.frombuffer(data, np.uint8)
        _, h, first, last = segments(raw, begins, ends)
        unique, count = np.unique(h, return_counts=True)
        out: dict[str, list] = {"range": [], "block": [], "hashes": [], "counts": []}
        numbers, cut = ranges(unique)
        for r, part, c in zip(numbers.tolist(), np.split(unique, cut), np.split(count, cut)):  # no range without hashes
            out["range"].append(r)
            out["block"].append(table.column("block")[0].as_py())
            out["hashes"].append(part.tobytes())
            out["counts"].append(zlib.compress(c.astype(np.uint32).tobytes(), 1))
        return pa.table(out, schema=pa.schema([("range", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(c), np.uint32) for c in table.column("counts").to_pylist()]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts))
        state = ((sums > 1).astype(np.uint8) + (sums > HOT))[place]
        parts = np.split(state, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({"block": table.column("block"), "range": table.column("range"), "state": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Segments that may be repeated, once each; later copies within the block are repeated bytes at once."""
        if not texts.num_rows:
            return pa.table({c: [] for c in sent.names}, schema=sent)
        table, data, begins, ends = opened(texts)
        owner, h, first, last = segments(np.frombuffer(data, np.uint8), begins, ends)
        unique, place = np.unique(h, return_inverse=True)
        got = answers.sort_by("range").column("state").to_pylist()
        state = np.concatenate([np.frombuffer(zlib.decompress(s), np.uint8) for s in got] or [np.zeros(0, np.uint8)])
        state = state[place] if len(unique) else state
        number, ids = table.column("block")[0].as_py(), table.column("doc_id").to_pylist()
        seen: dict[tuple[int, bytes], int] = {}
        copies: list[list[int]] = []  # by document and start, neighbours joined
        out: dict[str, list] = {c: [] for c in sent.names}

        def put(hash_: int | None, o: int, lo: int, hi: int, part: bytes | None) -> None:
            values = (hash_, number, o, ids[o] if ids[o] is not None else (1 << 63) - 1, lo - int(begins[o]), hi - int(begins[o]), part)
            for c, v in zip(sent.names, values, strict=True):
                out[c].append(v)

        signed = h.view(np.int64)
        for i in np.flatnonzero(state > 0).tolist():  # by document and start, so the first copy is the earliest
            o, lo, hi = int(owner[i]), int(first[i]), int(last[i]) + LENGTH
            for s, e in ((lo, hi),) if state[i] == 1 else ((x, x + LENGTH) for x in range(lo, hi - LENGTH + 1)):
                part = data[s:e] if state[i] == 1 else xxhash.xxh3_128_digest(data[s:e])
                key = int(signed[i]) if state[i] == 1 else int.from_bytes(part[:8], "little", signed=True)
                if (key, part) in seen:
                    if copies and copies[-1][0] == o and s <= copies[-1][2]:
                        copies[-1][2] = max(copies[-1][2], e)
                    else:
                        copies.append([o, s, e])
                else:
                    seen[key, part] = 1
                    put(key, o, s, e, part)
        for o, s, e in copies:
            put(None, o, s, e, None)
        return pa.table(out, schema=sent)

    def first_places(last: bool) -> Callable[[pa.Table], pa.Table]:
        """Of the rows of each hot window all but the earliest are repeated; the earliest goes on, but after the last step."""

        def run(table: pa.Table) -> pa.Table:
            rows = table.select(sent.names).sort_by([(c, "ascending") for c in ("hash", "part", "doc", "block", "row", "lo")]).combine_chunks()
            if not rows.num_rows:
                return rows
            key = np.frombuffer(b"".join(rows.column("part").to_pylist()), np.uint64).reshape(-1, 2)
            first = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
            later = pa.array(~first)
            hashes = pc.if_else(later, pa.scalar(None, pa.int64()), rows.column("hash"))
            rows = rows.set_column(0, "hash", hashes).set_column(6, "part", pc.if_else(later, pa.scalar(None, pa.binary()), rows.column("part")))
            return (rows.filter(later) if last else rows).cast(sent)

        return run

    sent = pa.schema([("hash", pa.int64()), ("block", pa.int32()), ("row", pa.int32()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("part", pa.binary())])

    def expand(table: pa.Table) -> pa.Table:
        """Flags of repeated bytes: later copies of a segment whole, of different segments what the expansion finds."""
        done = table.column("hash").is_null().to_numpy()
        block, row, doc, lo, hi = (table.column(c).to_numpy() for c in ("block", "row", "doc", "lo", "hi"))
        place = (block.astype(np.int64) << 32) | row
        flags = [np.stack([block[done], row[done], lo[done], hi[done]], 1)]
        todo = np.flatnonzero(~done)
        hashes = table.column("hash").to_numpy(zero_copy_only=False)[todo].astype(np.int64) if not done.any() else np.array([v for v in table.column("hash").to_pylist() if v is not None], np.int64)
        parts = np.array(table.column("part").take(pa.array(todo)).to_pylist(), dtype=object)
        by_place = np.lexsort((lo[todo], place[todo], doc[todo], hashes))
        todo, hashes, parts = todo[by_place], hashes[by_place], parts[by_place]
        chunk: list[int] = []
        group: dict[bytes, int] = {}
        size = 0

        def flush() -> None:
            nonlocal chunk, size
            if chunk:
                at = todo[chunk]
                found = repeats([parts[i] for i in chunk], doc[at], place[at], lo[at])
                own = at[found[:, 0]]
                flags.append(np.stack([block[own], row[own], lo[own] + found[:, 1], lo[own] + found[:, 2]], 1))
            chunk, size = [], 0

        copies = []
        for i in range(len(todo) + 1):
            if i == len(todo) or (i and hashes[i] != hashes[i - 1]):
                if len(group) > 1:  # one segment by itself shares no window with another
                    size += sum(map(len, group))
                    chunk += group.values()
                    if size >= CHUNK_BYTES:
                        flush()
                group = {}
            if i < len(todo):
                if parts[i] in group:
                    copies.append(todo[i])
                else:
                    group[parts[i]] = i
        flush()
        copies = np.array(copies, np.int64)
        flags.append(np.stack([block[copies], row[copies], lo[copies], hi[copies]], 1))
        flags = np.concatenate(flags).astype(np.int32)
        return pa.table({c: flags[:, k] for k, c in enumerate(_FLAGS.names)}, schema=_FLAGS)

    def remove(texts: pa.Table, flags: pa.Table) -> pa.Table:
        table, data, begins, ends = opened(texts)
        row, lo, hi = (flags.column(c).to_numpy() for c in ("row", "lo", "hi"))
        order = np.lexsort((lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        bound = np.searchsorted(row, np.arange(table.num_rows + 1))
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
        for d in range(table.num_rows):
            own = data[begins[d] : ends[d]]
            kept, pos, removed, spans = [], 0, 0, 0
            for s, e in zip(lo[bound[d] : bound[d + 1]].tolist(), hi[bound[d] : bound[d + 1]].tolist(), strict=True):
                if s > pos or (pos == 0 and spans == 0):
                    kept.append(own[pos:s])
                    spans += 1
                    removed += e - s
                    pos = e
                elif e > pos:
                    removed += e - pos
                    pos = e
            kept.append(own[pos:])
            whole = b"".join(kept)
            out["n_bytes"].append(len(own))
            out["n_removed"].append(removed)
            out["n_spans"].append(spans)
            out["kept"].append(whole if with_text else None)
            out["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
        longs = {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}
        return pa.table({"doc_id": table.column("doc_id"), **longs, "kept": pa.array(out["kept"], pa.binary()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    asked = rows.groupBy("block").applyInArrow(ask, "range int, block int, hashes binary, counts binary")
    wide = 1 << range_bits  # tasks of these shuffles: as many as the input gives, not as the session sets
    answers = asked.repartition(wide, "range").groupBy("range").applyInArrow(answer, "block int, range int, state binary")
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, "hash long, block int, row int, doc long, lo int, hi int, part binary")
    late = None
    if n_blocks > PART_BLOCKS:
        columns = "hash long, block int, row int, doc long, lo int, hi int, part binary"
        spot = F.pmod(F.xxhash64("part"), F.lit(8 << range_bits))
        hot = found.filter(F.octet_length("part") < LENGTH).withColumn("spot", spot).withColumn("share", F.expr(f"block div {PART_BLOCKS}"))
        first = hot.repartition(wide, "spot", "share").groupBy("spot", "share").applyInArrow(first_places(False), columns)
        last = first.filter("hash is not null").withColumn("spot", spot).repartition(wide, "spot").groupBy("spot").applyInArrow(first_places(True), columns)
        late = first.filter("hash is null").unionByName(last).select(*_FLAGS.names)
        found = found.filter((F.octet_length("part") >= LENGTH) | F.col("part").isNull())
    bucket = F.pmod(F.when(F.col("hash").isNotNull(), F.xxhash64("hash")).otherwise(F.xxhash64("block", "row")), F.lit(8 << range_bits))
    flags = found.withColumn("bucket", bucket).repartition(wide, "bucket").groupBy("bucket").applyInArrow(expand, "block int, row int, lo int, hi int")
    flags = flags.unionByName(late) if late is not None else flags
    out = rows.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out
