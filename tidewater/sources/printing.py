"""Results as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v)


def text_table(header: list[str], rows: list[list]) -> str:
    """Header and rows between dividers, cells right-aligned, NULL spelt out."""
    cells = [[_cell(v) for v in row] for row in rows]
    width = [max(map(len, column)) for column in zip(header, *cells, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda row: "|" + "|".join(f" {v:>{w}} " for v, w in zip(row, width, strict=True)) + "|"
    return "\n".join([rule, line(header), rule, *map(line, cells), *([rule] if cells else [])])


def show(df: DataFrame, rows: int = 1000) -> str:
    """The first rows of a result, and how many more there are; what the driver takes is bounded by `rows`."""
    first = [list(r) for r in df.take(rows + 1)]
    out = text_table(df.columns, first[:rows])
    return f"{out}\n{df.count() - rows} more rows" if len(first) > rows else out
