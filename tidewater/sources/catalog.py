"""The tables of a session."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArityError, BindError, DuplicateName, NotSupported, TableExists, TypeMismatch, UnknownColumn, UnknownTable
from ..functions.typed import Typed
from .types import type_name

class Catalog:
    """Tables by name, whatever its case.

    Managed tables are Parquet tables of a database in Spark's catalog.  Registered and
    temporary tables are known to this session only and hide managed ones of their name.
    """

    def __init__(self, spark: SparkSession, database: str = "tidewater"):
        self.spark, self.database = spark, database
        self.views: dict[str, tuple[str, DataFrame]] = {}
        self.files: dict[str, tuple[str, str]] = {}
        self.rows: dict[str, tuple[str, T.StructType, list[tuple]]] = {}

    def _full(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def managed(self) -> list[str]:
        if not self.spark.catalog.databaseExists(self.database):
            return []
        return [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary]

    def names(self) -> list[str]:
        own = {n for n, _ in [*self.views.values(), *self.files.values()]} | {n for n, _, _ in self.rows.values()}
        return sorted({*own, *self.managed()}, key=str.lower)

    def register(self, name: str, df: DataFrame) -> None:
        self.views[name.lower()] = (name, df)

    def register_directory(self, path: str, names: Iterable[str]) -> None:
        """Parquet tables `<path>/<name>.parquet`; each is opened when a statement first names it."""
        for name in names:
            self.files[name.lower()] = (name, f"{path}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        key = name.lower()
        if key in self.files and key not in self.views:
            self.register(self.files[key][0], self.spark.read.parquet(self.files[key][1]))
        if key in self.views:
            return self.views[key][1]
        if key in self.rows:
            _, schema, held = self.rows[key]
            return self.spark.createDataFrame(held, _plain(schema))
        if key in map(str.lower, self.managed()):
            return self.spark.table(self._full(name))
        raise UnknownTable(name)

    def exists(self, name: str) -> bool:
        return name.lower() in map(str.lower, self.names())

    def create(self, name: str, columns, temporary: bool, if_not_exists: bool) -> None:
        if len({c.lower() for c, _, _ in columns}) < len(columns):
            raise DuplicateName(f"{name} has columns of the same name")
        ddl = ", ".join(f"`{c}` {type_name(kind, sizes)}" for c, kind, sizes in columns)
        if self.exists(name):
            if if_not_exists:
                return
            raise TableExists(name)
        if temporary:
            self.rows[name.lower()] = (name, T.StructType.fromDDL(ddl), [])
        else:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
            self.spark.sql(f"CREATE TABLE {self._full(name)} ({ddl}) USING parquet")

    def drop(self, name: str) -> None:
        key = name.lower()
        if key in self.views or key in self.files:
            self.views.pop(key, None)
            self.files.pop(key, None)
        elif key in self.rows:
            del self.rows[key]
        elif self.exists(name):
            self.spark.sql(f"DROP TABLE {self._full(name)}")
        else:
            raise UnknownTable(name)

    def insert(self, name: str, columns: tuple[str, ...] | None, rows: list[list[Typed]]) -> None:
        """Append rows of values, which go to the columns named, or to all in order; the others get NULL.

        Values are computed and checked here, in one query for all rows of the statement.
        """
        target = self.table(name)
        if name.lower() in self.views:
            raise NotSupported(f"{name} is registered from elsewhere; it can't be changed here")
        temporary = name.lower() in self.rows
        fields = self.rows[name.lower()][1].fields if temporary else target.schema.fields
        if columns is None:
            columns = tuple(f.name for f in fields)
        known = {f.name.lower(): f.name for f in fields}
        if missing := [c for c in columns if c.lower() not in known]:
            raise UnknownColumn(f"{name}.{missing[0]}")
        if len({c.lower() for c in columns}) < len(columns):
            raise DuplicateName("a column is named twice")
        if wrong := [r for r in rows if len(r) != len(columns)]:
            raise ArityError(f"{len(columns)} columns and {len(wrong[0])} values")
        given = {known[c.lower()]: k for k, c in enumerate(columns)}
        made = F.array(*(F.struct(*(_stored(row[given[f.name]] if f.name in given else None, f).alias(f.name) for f in fields)) for row in rows))
        df = self.spark.range(1).select(F.inline(made))
        if temporary:
            self.rows[name.lower()][2].extend(map(tuple, df.collect()))  # as many as the statement lists
        else:
            df.write.insertInto(self._full(name))


def _stored(value: Typed | None, field: T.StructField):
    """The value as the column's type; a text beyond a VARCHAR's length is an error."""
    to = T.StringType() if isinstance(field.dataType, T.VarcharType) else field.dataType
    if value is None:
        return F.lit(None).cast(to)
    _storable(value.type, field)
    c = value.column.cast(to)
    if isinstance(field.dataType, T.VarcharType):
        error = F.raise_error(F.lit(f"a value is too long for {field.name}"))
        c = F.when(F.length(c) > field.dataType.length, error).otherwise(c)
    return c


def _plain(schema: T.StructType) -> T.StructType:
    """VARCHAR as STRING, which is what DataFrames hold."""
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType) for f in schema.fields])


def _storable(kind: T.DataType, field: T.StructField) -> None:
    to = field.dataType
    number = isinstance(kind, T.NumericType) and isinstance(to, T.NumericType)
    text = isinstance(kind, T.StringType) and isinstance(to, (T.StringType, T.VarcharType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))
    flag = isinstance(kind, T.BooleanType) and isinstance(to, T.ByteType)
    if not (isinstance(kind, T.NullType) or kind == to or number or text or flag):
        raise TypeMismatch(f"{kind.simpleString()} can't be stored in {field.name} {to.simpleString()}")


def values(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """Literal rows of a schema; each must have as many values as there are columns."""
    for row in rows:
        if len(row) != len(schema):
            raise ArityError(f"{len(schema)} columns and {len(row)} values")
    if not schema.fields:
        raise BindError("rows need a column")
    return spark.createDataFrame(rows, schema)
