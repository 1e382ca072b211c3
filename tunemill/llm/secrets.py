"""Secret scan: regular spans, and assignment-aware lexing of source and configuration text.

Three patterns give the base spans. The lexer then reads each line that names something as `name = literal`,
`name: literal`, `"name": "literal"`, `export NAME=literal` or `name := literal`, keeps what names stand for
(a literal, another name, a `+` chain of both, over lines too; triple quotes may span lines), follows names
through such chains within the document, backwards and forwards, and
scores the literal by how sensitive the target name is and how random the literal looks. A literal whose
score reaches the limit is a span of kind `literal` where it was written, even when only a later assignment
(`conf.password = alias`) shows what it is for.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the base spans, and the least length that counts.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "literal")

# How sensitive a part of a name is.
WEIGHTS = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 2, "credentials": 2, "auth": 1, "private": 1, "access": 1, "key": 1, "bearer": 2, "signing": 1, "session": 1, "cookie": 1, "cert": 1, "salt": 1, "pin": 1}
#: Score from which a literal is reported: the weight of its name plus up to 3 for its own look.
LIMIT = 4.0

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
#: A target and its operator. A bare name is read from the start of its run only, so a long run is read once.
_TARGET = re.compile(rf"""(?:["'](?P<quoted>{_NAME})["']|(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<bare>{_NAME}(?:\[["']{_NAME}["']\])?))[ \t]*+(?::=|=>|[:=])(?!=)""", re.A)
_ATOM = re.compile(rf"""(?:"(?P<dq>(?:[^"\\\n]|\\.)*+)"|'(?P<sq>(?:[^'\\\n]|\\.)*+)'|\$\{{(?P<env>{_NAME})\}}|(?P<word>[^\s"',;+(){{}}\[\]<>|&]++))""", re.A)
_BLANK = re.compile(r"[ \t]*+")
#: What may stand between an operator and its value: blanks, and a bracket that may end the line.
_OPEN = re.compile(r"[ \t]*+(?:\([ \t]*+(?:\r?\n[ \t]*+)?)?")
#: Between two parts of a chain: a plus, which may end or begin a line.
_PLUS = re.compile(r"[ \t]*+(?:\\?\r?\n[ \t]*+)?\+(?!=)[ \t]*+(?:\\?\r?\n[ \t]*+)?")
_IS_NAME = re.compile(_NAME, re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> int:
    """How sensitive a target name is: the sum over its camel-case, snake-case or dotted parts, 3 at most."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return min(3, sum(WEIGHTS.get(p, 0) for p in {*parts, *joined}))


def literal_score(text: str) -> float:
    """0 to 3: long, many different characters, several character classes. Words and short values score low."""
    return 0.0 if len(text) < 8 else _counted_score(_counted(text))


#: Characters are counted in 256 classes: ASCII each by itself, white space with the blank, all others by their low bits.
_WIDE = 256
_KINDS_OF = [np.array([bool(re.match(p, chr(c), re.A)) if c < 128 else p.startswith("[^") for c in range(_WIDE)]) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]")]
#: Lengths count up to here, so that chains which double stay in plain numbers.
_MOST = 1e12


def _counted(text: str) -> np.ndarray:
    if text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        out = np.bincount(raw, minlength=_WIDE).astype(np.float64)
        out[32] += out[9:14].sum() + out[28:32].sum()
        out[9:14] = out[28:32] = 0
        return out
    at = [32 if c.isspace() else ord(c) if c < "\x80" else 128 + ord(c) % 128 for c in text]
    return np.bincount(at, minlength=_WIDE).astype(np.float64)


def _counted_score(counts: np.ndarray) -> float:
    """literal_score of a text with these characters, which may be too long to be written out."""
    length = float(counts.sum())
    if length < 8 or counts[32]:
        return 0.0
    share = counts[counts > 0] / length
    classes = sum(bool(counts[k].any()) for k in _KINDS_OF)
    return min(length, 16.0) / 16 + min(1.0, -float((share * np.log2(share)).sum()) / 3.5) + (classes - 1) / 3


#: Part of a value: a literal (text, start, end), or the number of the assignment whose value stands there.
_Part = tuple[str, int, int] | int


def _needed_scores(values: list[list[_Part]], wanted: list[bool]) -> dict[int, float]:
    """Scores of the wanted values, with all that they are built from, repeats included. A value's counts are
    kept until the last value built from it has them. A reference back into its own chain adds nothing."""
    uses = [0] * len(values)
    for parts in values:
        for p in parts:
            if isinstance(p, int):
                uses[p] += 1
    counts: dict[int, np.ndarray] = {}
    scores: dict[int, float] = {}
    state = bytearray(len(values))  # 0 not seen, 1 in work, 2 done

    def counts_of(p: _Part) -> np.ndarray | None:
        if not isinstance(p, int):
            return _counted(p[0])
        uses[p] -= 1
        return counts.get(p) if uses[p] else counts.pop(p, None)

    for i, want in enumerate(wanted):
        todo = [i] if want and not state[i] else []
        while todo:
            v = todo[-1]
            if state[v] == 2:
                todo.pop()
                continue
            state[v] = 1
            ahead = [p for p in values[v] if isinstance(p, int) and not state[p]]
            if ahead:
                todo += ahead
                continue
            todo.pop()
            state[v] = 2
            found = [c for p in values[v] if (c := counts_of(p)) is not None]
            total = np.sum(found, axis=0) if found else np.zeros(_WIDE)
            length = float(total.sum())
            total = total * (_MOST / length) if length > _MOST else total
            if wanted[v]:
                scores[v] = _counted_score(total)
            if uses[v]:
                counts[v] = total
    return scores


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _atoms(text: str, pos: int, unclosed: set[str]) -> tuple[list[tuple[str, str, int, int]], int]:
    """The parts of a value from pos on, and where it ends. Literals and names are joined by + or, literals, stand side by side."""
    atoms: list[tuple[str, str, int, int]] = []
    pos = _OPEN.match(text, pos).end()
    while True:
        mark = text[pos : pos + 3]
        if mark in ('"""', "'''") and mark not in unclosed:
            end = text.find(mark, pos + 3)
            if end >= 0:
                atoms.append(("literal", text[pos + 3 : end], pos + 3, end))
                pos = end + 3
            else:
                unclosed.add(mark)  # none follows, so it is not looked for again
                continue
        elif (a := _ATOM.match(text, pos)) is not None:
            group = a.lastgroup
            value = a[group]
            named = group == "env" or (group == "word" and _IS_NAME.fullmatch(value) is not None)
            atoms.append(("name" if named else "literal", value, a.start(group), a.end(group)))
            pos = a.end()
        else:
            return atoms, pos
        plus = _PLUS.match(text, pos)
        if plus is not None:
            pos = plus.end()
            continue
        after = _BLANK.match(text, pos).end()
        if text[pos - 1] not in "\"'" or text[after : after + 1] not in ('"', "'"):
            return atoms, pos
        pos = after


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """(target name, atoms) of each assignment, in order; an atom is (literal | name, value, start, end).

    Every character is read a fixed number of times, however long the text's words, lines and quotes are."""
    at, unclosed = 0, set()
    while (m := _TARGET.search(text, at)) is not None:
        atoms, at = _atoms(text, m.end(), unclosed)
        yield m["quoted"] or m["bare"], atoms


def literal_spans(text: str, limit: float = LIMIT) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through other names, from left to right.

    A name stands for what it was given last before it is used or, if it was not given anything yet, for what it
    is given first after that."""
    if not ("=" in text or ":" in text):
        return []
    found_pairs = list(pairs(text))
    first: dict[str, int] = {}
    for i, (name, _) in enumerate(found_pairs):
        first.setdefault(name, i)
    last: dict[str, int] = {}
    values: list[list[_Part]] = []
    for i, (name, atoms) in enumerate(found_pairs):
        here: list[_Part] = []
        for kind, value, start, end in atoms:
            to = last.get(value, first.get(value)) if kind == "name" else None
            if kind == "literal":
                here.append((value, start, end))
            elif to is not None and to != i:
                here.append(to)
            elif len(atoms) == 1 and any(c.isdigit() for c in value):
                here.append((value, start, end))  # an unquoted value of a configuration file
        values.append(here)
        last[name] = i
    weights = [name_weight(name) for name, _ in found_pairs]
    scores = _needed_scores(values, [bool(w and v) for w, v in zip(weights, values, strict=True)])
    found: set[tuple[int, int]] = set()
    told = bytearray(len(values))
    for i, whole in scores.items():
        todo = [i] if weights[i] + whole >= limit and whole > 1.5 else []
        while todo:
            v = todo.pop()
            if not told[v]:
                told[v] = 1
                todo += [p for p in values[v] if isinstance(p, int)]
                found |= {p[1:] for p in values[v] if not isinstance(p, int) and p[2] > p[1]}
    return sorted(found)


def outside(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans that no base span covers; both in order of their starts."""
    out, at, reach = [], 0, 0
    for s, e in spans:
        while at < len(base) and base[at][0] <= s:
            reach = max(reach, base[at][1])
            at += 1
        if e > reach:
            out.append((s, e))
    return out


def written_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans.

    Positions are code points, ends exclusive; `spans` has kind:start:end by start, then kind. Null text
    counts as empty: no span, and the digest of the empty string. Ids may be null or repeat; rows are read
    one by one and whole, in time that grows in proportion to their length. A literal that a base span covers
    already is not reported again. Other columns are not read, whatever their names. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n: dict[str, list[int]] = {k: [] for k in KINDS}
                sha, spans = [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    more = [(s, e, "literal") for s, e in outside(literal_spans(text or "", limit), base)]
                    both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
                    count = Counter(x[2] for x in both)
                    for k in KINDS:
                        n[k].append(count[k])
                    sha.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
                    spans.append(written_spans(both))
                columns = [part.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")
