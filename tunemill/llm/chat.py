"""Chat formatting: records of any layout become canonical turns, and turns become one training text with a loss mask.

A record is a struct column that holds the fields of several layouts, as reading a mixed dump gives it; those of other
layouts are null. The paths of the fields that a record has, nested ones and those within lists too, are sorted and
hashed. Mappings say which paths make which turns; each mapping's fingerprints are known beforehand, so a record finds
its mapping by one comparison of hashes, and records of an undeclared layout are told apart and can be reported.

A template marks each turn by control strings. Where a text or a role holds a control string, with any number of
backslashes after its first bracket, one more backslash goes there; reading takes one away. So no text can end or begin
a turn, any text comes back unchanged, and texts without such strings stay as they are. The loss mask is run lengths in
code points along the formatted text, three for each turn: so many without loss, so many with, so many without.

All of it is built from functions on rows; nothing is shuffled, and a record's turns stay together in its row.

Defined results: a null text or role is empty; a null list, an empty list or a record without any field gives no turns
if a mapping has that fingerprint, else null turns and null mapping; repeated records and keys stay separate rows; an
empty table stays empty; other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import chain, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class One:
    """A turn of a fixed role. Its text is that of the fields that are there, a blank line between; none: no turn."""

    role: str
    fields: tuple[str, ...]

    def layouts(self) -> list[set[str]]:
        return [set(compact) for compact in product(*[(x, "") for x in self.fields])]

    def turns(self, record: Column) -> Column:
        found = [_at(record, x).cast("string") for x in self.fields]
        turn = F.array(F.struct(F.lit(self.role).alias("role"), F.concat_ws("\n\n", *found).alias("text")))
        return F.when(F.coalesce(*found).isNotNull(), turn).otherwise(F.array().cast(TURNS))


@dataclass(frozen=True)
class Each:
    """A turn for each entry of a list of structs; `roles` gives canonical names, any other name stays."""

    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)

    def layouts(self) -> list[set[str]]:
        inner = [f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]
        return [set(), *({self.items, f"{self.items}[]", *x} for x in product(*[(y, "") for y in inner])), {self.items}]

    def turns(self, record: Column) -> Column:
        def turn(x: Column) -> Column:
            name = F.coalesce(x[self.role].cast("string"), F.lit(""))
            for known, canonical in self.roles.items():
                name = F.when(x[self.role] == known, canonical).otherwise(name)
            return F.struct(name.alias("role"), F.coalesce(x[self.text].cast("string"), F.lit("")).alias("text"))

        return F.coalesce(F.transform(_at(record, self.items), turn), F.array().cast(TURNS))


@dataclass(frozen=True)
class Mapping:
    """A declared layout: its parts in the order of their turns. It takes every record that has at least one of its fields and no others."""

    name: str
    parts: tuple[One | Each, ...]

    def fingerprints(self) -> set[str]:
        found = {frozenset(chain.from_iterable(x)) - {""} for x in product(*[p.layouts() for p in self.parts])}
        return {_hash(_with_parents(x)) for x in found if x}


PROMPT = Mapping("prompt", (One("system", ("context",)), One("user", ("prompt",)), One("assistant", ("response",))))
INSTRUCTION = Mapping("instruction", (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))))
MESSAGES = Mapping("messages", (Each("messages", "role", "content"),))
SHARED = Mapping("shared", (Each("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),))
MAPPINGS = (PROMPT, INSTRUCTION, MESSAGES, SHARED)


def _at(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record[name]
    return record


def _with_parents(paths: frozenset[str]) -> set[str]:
    return paths | {p[: m.start()] for p in paths for m in re.finditer(r"\[\]|\.", p)}


def _hash(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, ignore: Sequence[str] = ()) -> list[tuple[str, Callable[[Column], Column]]]:
    """The nested paths of a struct type, sorted, each with a test whether a value of the type has anything there.

    `a.b` is a field of a struct, `a[]` says that list a has an entry, `a[].b` that an entry has b. Paths in `ignore`, and all below them, are left out."""

    def below(kind: T.DataType, path: str, has: Callable[[Callable[[Column], Column]], Callable[[Column], Column]]) -> list:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in one(f.dataType, f"{path}.{f.name}" if path else f.name, lambda test, n=f.name: has(lambda c: test(c[n])))]
        if isinstance(kind, T.ArrayType):
            return one(kind.elementType, f"{path}[]", lambda test: has(lambda c: F.coalesce(F.exists(c, test), F.lit(False))))
        return []

    def one(kind: T.DataType, path: str, has: Callable) -> list:
        if path in ignore:
            return []
        return [(path, has(lambda c: c.isNotNull())), *below(kind, path, has)]

    return sorted(below(kind, "", lambda test: test), key=lambda x: x[0])


def fingerprint(record: Column, kind: T.DataType, ignore: Sequence[str] = ()) -> Column:
    """The hash of the sorted paths that the record has."""
    return F.md5(F.concat_ws("\n", *[F.when(has(record), F.lit(path)) for path, has in field_paths(kind, ignore)]))


def canonical_turns(df: DataFrame, key: str, record: str, mappings: Sequence[Mapping] = MAPPINGS, ignore: Sequence[str] = ()) -> DataFrame:
    """One row per record: key, fingerprint, mapping (null: none is declared), turns. The first mapping that has a fingerprint takes it.

    `ignore` lists paths, such as those of metadata, that do not tell layouts apart."""
    if key in ("fingerprint", "mapping", "turns"):
        raise ValueError(f"the key may not be called {key}")
    kind = df.schema[record].dataType
    rows = df.select(F.col(key), F.col(record).alias("record"))
    rows = rows.select(key, "record", fingerprint(F.col("record"), kind, ignore).alias("fingerprint"))
    declared = {path for path, _ in field_paths(kind)}
    chosen, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        parts = [p for p in m.parts if _paths(p) & declared]
        if any(not _paths(p) <= declared for p in parts):
            parts = [_known(p, declared) for p in parts]
        if parts := [p for p in parts if p]:
            ours = F.col("fingerprint").isin(sorted(m.fingerprints()))
            chosen = F.when(ours, m.name).otherwise(chosen)
            turns = F.when(ours, F.concat(*[p.turns(F.col("record")) for p in parts]).cast(TURNS)).otherwise(turns)
    return rows.select(key, "fingerprint", chosen.alias("mapping"), turns.alias("turns"))


def _paths(part: One | Each) -> set[str]:
    return set(part.fields) if isinstance(part, One) else {part.items, f"{part.items}[].{part.role}", f"{part.items}[].{part.text}"}


def _known(part: One | Each, declared: set[str]) -> One | Each | None:
    """part with the fields that the table has: a table of few layouts lacks the others' columns."""
    if isinstance(part, One):
        return One(part.role, tuple(x for x in part.fields if x in declared))
    return part if _paths(part) <= declared else None


def undeclared(turns: DataFrame) -> DataFrame:
    """Of canonical_turns' result, how many records of each fingerprint no mapping takes."""
    return turns.filter("mapping is null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"))


@dataclass(frozen=True)
class Template:
    """How turns are marked. frames: what stands before and after the text of a role; other: before a role without a frame,
    between it and its text, and after that. controls: control strings as first bracket, names, last bracket. Each frame
    begins and ends with a control string, blanks aside, and so do the three strings of `other`."""

    frames: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    controls: tuple[tuple[str, tuple[str, ...], str], ...]

    def _after(self, names: tuple[str, ...], end: str) -> str:
        return rf"(?=\\*(?:{'|'.join(map(re.escape, names))}){re.escape(end)})"

    def escaped(self, text: Column) -> Column:
        pattern = "|".join(re.escape(start) + self._after(names, end) for start, names, end in self.controls)
        return F.regexp_replace(text, pattern, r"$0\\")

    def unescaped(self, text: Column) -> Column:
        pattern = "|".join(rf"({re.escape(start)})\\{self._after(names, end)}" for start, names, end in self.controls)
        return F.regexp_replace(text, pattern, "".join(f"${i + 1}" for i in range(len(self.controls))))

    def before(self, turn: Column) -> Column:
        out = F.concat(F.lit(self.other[0]), self.escaped(turn["role"]), F.lit(self.other[1]))
        for role, (begin, _) in self.frames.items():
            out = F.when(turn["role"] == role, begin).otherwise(out)
        return out

    def after(self, turn: Column) -> Column:
        out = F.lit(self.other[2])
        for role, (_, end) in self.frames.items():
            out = F.when(turn["role"] == role, end).otherwise(out)
        return out

    def pieces(self, formatted: Column) -> Column:
        """The formatted text of each turn."""
        frames = [f"{re.escape(begin)}.*?{re.escape(end)}" for begin, end in self.frames.values()]
        pattern = "(?s)" + "|".join([*frames, ".*?".join(map(re.escape, self.other))])
        return F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0))

    def turn_of(self, piece: Column) -> Column:
        """Role and text of one turn, as they were before formatting."""
        begin, middle, end = self.other
        name = F.substring_index(F.substr(piece, F.lit(len(begin) + 1)), middle, 1)
        skip = F.length(name) + len(begin) + len(middle)
        role, text = self.unescaped(name), F.substr(piece, skip + 1, F.length(piece) - skip - len(end))
        for known, (begin, end) in self.frames.items():
            mine = F.startswith(piece, F.lit(begin))
            role = F.when(mine, known).otherwise(role)
            text = F.when(mine, F.substr(piece, F.lit(len(begin) + 1), F.length(piece) - len(begin) - len(end))).otherwise(text)
        return F.struct(role.alias("role"), self.unescaped(text).alias("text"))


INST = Template(
    {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")},
    ("[ROLE]", "[/ROLE]", "</s>"),
    (("[", ("INST", "/INST", "SYS", "/SYS", "ROLE", "/ROLE"), "]"), ("<", ("s", "/s"), ">")),
)
IM = Template({}, ("<|im_start|>", "<|im_sep|>", "<|im_end|>"), (("<|", ("im_start", "im_sep", "im_end"), "|>"),))


def format_turns(df: DataFrame, key: str, template: Template = INST, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Of rows with turns: key, formatted, mask (array of struct skip, take, rest: code points without, with, without loss). Null turns: both null."""

    def piece(turn: Column) -> Column:
        text, begin, end = template.escaped(turn["text"]), template.before(turn), template.after(turn)
        return F.struct(begin.alias("begin"), text.alias("text"), end.alias("end"), turn["role"].isin(*loss_roles).alias("loss"))

    def run(p: Column) -> Column:
        whole = F.length(p["text"])
        take = F.when(p["loss"], whole).otherwise(0)
        return F.struct(F.length(p["begin"]).alias("skip"), take.alias("take"), (whole - take + F.length(p["end"])).alias("rest"))

    clean = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = df.select(key, F.transform(clean, piece).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["begin"], p["text"], p["end"])), "")
    return rows.select(key, formatted.alias("formatted"), F.transform("pieces", run).alias("mask"))


def read_turns(formatted: Column, template: Template = INST) -> Column:
    """The turns that a formatted text was made of."""
    return F.transform(template.pieces(formatted), template.turn_of)


def read_loss(formatted: Column, mask: Column, template: Template = INST) -> Column:
    """The text under the loss mask, without escapes, nothing between its parts."""
    parts = F.zip_with(template.pieces(formatted), mask, lambda p, m: template.unescaped(F.substr(p, m["skip"] + 1, m["take"])))
    return F.array_join(parts, "")


def conversation_records(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as one record per conversation (conv_id, record), each in a usual layout that can hold it.

    One question and answer become prompt and response; these after a system text become an instruction; longer ones that a
    system text begins become from-value lists; all others role-content lists. Rows of a null conversation are one
    conversation; equal or null turn numbers go by role and text, nulls first. A conversation is one row of a table, so
    it has to fit in one; its rows meet once, on its key."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    usual = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    layout = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), "prompt")
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "instruction")
        .when((F.get(roles, F.lit(0)) == "system") & usual, "shared")
        .otherwise("messages")
    )
    whole = whole.select("conv_id", "t", layout.alias("layout"))

    def text(layout: str, at: int) -> Column:
        return F.when(F.col("layout") == layout, F.get(F.col("t"), F.lit(at))["text"])

    def entry(t: Column) -> Column:
        name = F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
        return F.struct(name.alias("from"), t["text"].alias("value"))

    record = F.struct(
        text("prompt", 0).alias("prompt"),
        text("prompt", 1).alias("response"),
        text("instruction", 0).alias("system"),
        text("instruction", 1).alias("instruction"),
        text("instruction", 2).alias("output"),
        F.when(F.col("layout") == "messages", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(F.col("layout") == "shared", F.transform("t", entry)).alias("conversations"),
    )
    return whole.select("conv_id", record.alias("record"))


def formatting_report(rows: DataFrame, template: Template = INST) -> DataFrame:
    """What is read back from the formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    made = format_turns(canonical_turns(conversation_records(rows), "conv_id", "record"), "conv_id", template)
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted"), template).alias("turns"), read_loss(F.col("formatted"), F.col("mask"), template).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
