"""Grouped aggregates by the dialect's names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import registry


def grouped(df: DataFrame, keys: list[str], **aggregates: tuple[str, str | None] | tuple[str, str | None, bool]) -> DataFrame:
    """One row per group: `name=(function, column)`, `name=(function, column, True)` for DISTINCT, column None for '*'."""
    built = []
    for name, (function, column, *distinct) in aggregates.items():
        kind = df.schema[column].dataType if column else None
        built.append(registry.aggregate(function.upper(), bool(distinct and distinct[0]), column, kind).alias(name))
    if not built:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*built)
