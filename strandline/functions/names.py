"""Column names: ones that a table doesn't have yet, and all of a table's own, whatever characters they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spare(df: DataFrame, name: str) -> str:
    """The name, or a longer one that df doesn't have yet (names don't differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def every_column(df: DataFrame) -> list[Column]:
    """All columns, by quoted names: a dot in a name isn't a way into a struct."""
    return [F.col(quoted(c)) for c in df.columns]
