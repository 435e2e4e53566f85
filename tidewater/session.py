"""The engine's front: statements in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .errors import NotSupported
from .plans import ast
from .plans.binder import Binder
from .plans.parser import parse
from .sources.catalog import Catalog


class Session:
    """Runs statements of the dialect on a Spark session.

    `tables` maps names to DataFrames; `directory` and `names` register Parquet tables.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, directory: str | None = None, names=(), database: str = "tidewater"):
        self.spark = spark
        self.catalog = Catalog(spark, database)
        if directory:
            self.catalog.register_directory(directory, names)
        for name, df in (tables or {}).items():
            self.catalog.register(name, df)

    def execute(self, sql: str) -> DataFrame | None:
        """The result of the last statement of `sql`; None for statements without one."""
        out = None
        for statement in parse(sql):
            out = self.run(statement)
        return out

    def script(self, sql: str) -> list[DataFrame | None]:
        """The results of all statements, in order."""
        return [self.run(s) for s in parse(sql)]

    def sql(self, text: str) -> DataFrame:
        out = self.execute(text)
        if out is None:
            raise NotSupported("the statement has no result")
        return out

    def explain(self, sql: str) -> str:
        """Spark's formatted plan of a SELECT."""
        return self.plan(self.sql(sql))

    def plan(self, df: DataFrame) -> str:
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def run(self, statement) -> DataFrame | None:
        binder = Binder(self.spark, self.catalog.table)
        match statement:
            case ast.Select():
                return binder.select(statement)
            case ast.CreateTable(name, columns, temporary, quiet):
                self.catalog.create(name, columns, temporary, quiet)
            case ast.CreateView(name, select):
                self.catalog.register(name, binder.select(select))
            case ast.DropTable(name):
                self.catalog.drop(name)
            case ast.Insert(table, columns, rows):
                self.catalog.insert(table, columns or None, [[binder.lower(e, (), place="in VALUES") for e in row] for row in rows])
            case ast.Explain(select):
                plan = self.plan(binder.select(select))
                return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "`PLAN` string")
            case ast.Show("TABLES"):
                return self.spark.createDataFrame([(n,) for n in self.catalog.names()], "`TABLE NAME` string")
            case ast.Show(what):
                raise NotSupported(f"SHOW {what}")
        return None
