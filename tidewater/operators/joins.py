"""Joins on equal column names, and the size of a join by one inequality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import JoinColumnError

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def using_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Shared columns first (coalesced for full joins), then the rest of left and right."""
    if how not in KINDS:
        raise JoinColumnError(f"no join of kind {how}")
    if len(set(names)) < len(names):
        raise JoinColumnError("a name is repeated")
    for side, df in (("left", left), ("right", right)):
        for n in names:
            if df.columns.count(n) != 1:
                raise JoinColumnError(f"{n} is {'ambiguous' if n in df.columns else 'missing'} on the {side} side")
    return left.join(right, names, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all names that both sides have."""
    names = [n for n in left.columns if n in set(right.columns)]
    if not names:
        raise JoinColumnError("no shared column")
    return using_join(left, right, names, how)


def count_pairs(left: DataFrame, right: DataFrame, x: Column, y: Column, equal: bool = False) -> DataFrame:
    """One row, `n`: how many pairs of rows have x > y (x >= y if `equal`), with x of left, y of right and of one type.

    No pair is made: values are counted, dealt by ranges, and those of right that lie below are
    summed, within a range row by row and then over ranges.  Work grows as sorting does.
    """
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    values = left.select(x.alias("v"), F.expr("1 AS a"), F.expr("0 AS b")).unionAll(right.select(y, F.lit(0), F.lit(1)))
    values = values.where("v IS NOT NULL").groupBy("v").agg(F.expr("SUM(a) AS a"), F.expr("SUM(b) AS b"))
    # one row a value, so no range is heavy; a range is one partition, and its number is read but once
    values = values.repartitionByRange("v").selectExpr("*", "SPARK_PARTITION_ID() AS p")
    values = values.selectExpr("*", f"COALESCE(SUM(b) OVER (PARTITION BY p ORDER BY v {rows} {'CURRENT ROW' if equal else '1 PRECEDING'}), 0) AS below")
    ranges = values.groupBy("p").agg(F.expr("SUM(a) AS a"), F.expr("SUM(b) AS b"), F.expr("SUM(a * below) AS n"))
    return ranges.selectExpr(f"n + a * COALESCE(SUM(b) OVER (ORDER BY p {rows} 1 PRECEDING), 0) AS n").agg(F.expr("COALESCE(SUM(n), 0) AS n"))
