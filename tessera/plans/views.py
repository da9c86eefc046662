"""The dialect over tables that are already Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.errors import QueryError
from tessera.plans import ast, parser
from tessera.plans.compiler import Compiler, Table
from tessera.types import POINT, Column, Schema

NAMES = {T.ShortType(): "SMALLINT", T.IntegerType(): "INTEGER", T.LongType(): "BIGINT", T.FloatType(): "REAL", T.DoubleType(): "DOUBLE PRECISION", T.StringType(): "TEXT", T.BooleanType(): "BOOLEAN", T.DateType(): "DATE", T.TimestampNTZType(): "TIMESTAMP", T.TimestampType(): "TIMESTAMP", T.BinaryType(): "BYTEA", POINT: "POINT"}


def as_table(name: str, df: DataFrame, key: str | None = None) -> Table:
    """A table of a DataFrame's columns that the dialect has types for."""
    columns = tuple(Column(f.name, NAMES[f.dataType], primary_key=f.name == key) for f in df.schema if f.dataType in NAMES)
    return Table(Schema(name, columns), df.select(*[f"`{c.name}`" for c in columns]), {})


def sql(spark: SparkSession, text: str, tables: dict[str, tuple[DataFrame, str | None]], stop: tuple[str, ...] = ()) -> DataFrame:
    """One SELECT of the dialect over DataFrames, given with their primary keys."""
    s = parser.parse(text)
    if not isinstance(s, ast.Select):
        raise QueryError("only SELECT reads views")

    def find(name: str) -> Table:
        if name not in tables:
            raise QueryError(f"there is no table {name}")
        return as_table(name, *tables[name])

    return Compiler(find, stop).select(s)
