"""Row sources and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def one_row(spark: SparkSession, *columns: Column) -> DataFrame:
    """A single row of constant columns."""
    return spark.range(1).select(*columns)


def limit_offset(df: DataFrame, *order: str | Column, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows after `offset`, at most `limit`, in the order given."""
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
