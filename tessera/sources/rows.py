"""Rows from callers as dictionaries, and rows to JSON."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import QueryError
from tessera.types import Schema, point, polygon, rectangle


def from_dicts(spark: SparkSession, schema: Schema, rows: Iterable[Mapping]) -> DataFrame:
    """Rows with the schema's columns; unknown names are refused, missing ones are null. BYTEA takes base64 or a list of numbers."""
    out = []
    for row in rows:
        if unknown := set(row) - {c.name for c in schema.columns}:
            raise QueryError(f"table {schema.table} has no column {', '.join(sorted(unknown))}")
        out.append(tuple(_value(row.get(c.name), c.type) for c in schema.columns))
    return spark.createDataFrame(out, schema.struct)


def _value(v: object, kind: str) -> object:
    if v is None:
        return None
    if kind == "BYTEA":
        if isinstance(v, str):
            try:
                return base64.b64decode(v, validate=True)
            except ValueError:
                raise QueryError("a BYTEA text must be base64") from None
        return bytes(v) if isinstance(v, (bytes, bytearray)) else struct.pack(f"<{len(v)}f", *v)
    if kind == "POINT":
        return point(v["longitude"], v["latitude"]) if isinstance(v, Mapping) else point(*v)
    if kind == "RECTANGLE":
        return rectangle(*(v[x] for x in ("west", "south", "east", "north"))) if isinstance(v, Mapping) else rectangle(*v)
    return polygon(v) if kind == "POLYGON" else v


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object a row: decimals as numbers, points as longitude and latitude, ISO times, bytes as base64."""

    def plain(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.DecimalType):
            return c.cast("double")
        if isinstance(t, T.BinaryType):
            return F.base64(c)
        if isinstance(t, T.StructType) and t.names == ["lon", "lat"]:
            return F.when(c.isNotNull(), F.struct(c["lon"].alias("longitude"), c["lat"].alias("latitude")))
        if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return c

    return df.select(F.to_json(F.struct(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]), {"ignoreNullFields": "false"}).alias("json"))
