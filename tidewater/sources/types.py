"""Column types of the dialect."""

from __future__ import annotations

from ..errors import NotSupported

_SIMPLE = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "TEXT": "string", "BLOB": "binary", "DATETIME": "timestamp_ntz", "DATE": "date", "TIMESTAMP": "timestamp"}


def type_name(kind: str, sizes: tuple[int, ...]) -> str:
    """Spark's name of a column type.  CHAR is a VARCHAR, so that no blanks are added."""
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    if kind in ("CHAR", "VARCHAR"):
        return f"varchar({sizes[0]})"
    if kind in ("DECIMAL", "NUMERIC"):
        return f"decimal({', '.join(map(str, sizes or (10, 0)))})"
    raise NotSupported(f"columns of type {kind}")
