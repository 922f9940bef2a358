"""Tables the operators read, and names that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame

from changelens.sources.tables import cut, drop_tables, lookup, read_table as read

__all__ = ["cut", "drop_tables", "fresh", "lookup", "put_back", "read", "set_apart"]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of the table's, for the wanted ones."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def set_apart(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows under column names that no operator adds; undo with ``put_back``."""
    own = fresh(df, *[f"own_{i}_{c}" for i, c in enumerate(df.columns)])
    return df.toDF(*own), own


def put_back(df: DataFrame, own: list[str], names: list[str]) -> DataFrame:
    return df.select(*own).toDF(*names)
