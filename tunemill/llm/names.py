"""Column names for joins back to a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until docs has no such column in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
