"""Type names, columns and schemas of the dialect, and the Spark types that hold them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tessera.errors import QueryError

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
RECTANGLE = T.StructType([T.StructField(x, T.DoubleType()) for x in ("west", "south", "east", "north")])
POLYGON = T.ArrayType(POINT)
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("pt", POINT), T.StructField("rect", RECTANGLE), T.StructField("ring", POLYGON), T.StructField("centroid", POINT)])

SPARK_TYPES: dict[str, T.DataType] = {
    "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "NUMERIC": T.DecimalType(38, 18), "REAL": T.FloatType(), "DOUBLE PRECISION": T.DoubleType(),
    "CHAR": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIME": T.StringType(), "TIMESTAMP": T.TimestampNTZType(), "BYTEA": T.BinaryType(),
    "POINT": POINT, "RECTANGLE": RECTANGLE, "POLYGON": POLYGON, "GEOMETRY": GEOMETRY,
}
SIZED = {"CHAR", "VARCHAR"}
SPATIAL = {"POINT", "RECTANGLE", "POLYGON", "GEOMETRY"}
NUMBERS = {"SMALLINT", "INTEGER", "BIGINT", "NUMERIC", "REAL", "DOUBLE PRECISION"}
STRINGS = {"CHAR", "VARCHAR", "TEXT"}
ORDERED = NUMBERS | STRINGS | {"DATE", "TIME", "TIMESTAMP"}
INTEGER_RANGES = {"SMALLINT": 2**15, "INTEGER": 2**31, "BIGINT": 2**63}


@dataclass(frozen=True)
class Column:
    """A declared column. A primary key is unique and not null."""

    name: str
    type: str
    size: int | None = None
    primary_key: bool = False
    nullable: bool = True
    unique: bool = False

    def __post_init__(self) -> None:
        if self.type not in SPARK_TYPES:
            raise QueryError(f"unknown type {self.type}")
        if self.type in SIZED and not self.size:
            raise QueryError(f"{self.type} column {self.name} needs a size")
        if self.primary_key:
            object.__setattr__(self, "nullable", False)
            object.__setattr__(self, "unique", True)

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, SPARK_TYPES[self.type], True, {"max_len": self.size} if self.size and self.type in SIZED else {})


@dataclass(frozen=True)
class Schema:
    """The columns of a table: at least one, with names of their own, and one primary key at most."""

    table: str
    columns: tuple[Column, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not names:
            raise QueryError(f"table {self.table} has no column")
        if len(set(names)) < len(names):
            raise QueryError(f"table {self.table} repeats a column name")
        if sum(c.primary_key for c in self.columns) > 1:
            raise QueryError(f"table {self.table} has several primary keys")

    @property
    def struct(self) -> T.StructType:
        return T.StructType([c.field for c in self.columns])

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.primary_key), None)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise QueryError(f"table {self.table} has no column {name}")


def _number(x: object, low: float, high: float, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not low <= x <= high:
        raise QueryError(f"{what} must lie between {low:g} and {high:g}, not {x!r}")
    return float(x)


def point(lon: float, lat: float) -> tuple[float, float]:
    return _number(lon, -180, 180, "longitude"), _number(lat, -90, 90, "latitude")


def rectangle(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """West may exceed east: the rectangle then crosses the date line."""
    (west, south), (east, north) = point(west, south), point(east, north)
    if south > north:
        raise QueryError("a rectangle's south lies above its north")
    return west, south, east, north


def polygon(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A closed ring; closed here if it isn't."""
    ring = [point(*p) for p in points]
    if ring and ring[0] != ring[-1]:
        ring.append(ring[0])
    if len(ring) < 4 or len(set(ring)) < 3:
        raise QueryError("a polygon needs three vertices")
    if any(abs(a[0] - b[0]) > 180 for a, b in zip(ring, ring[1:], strict=False)):
        raise QueryError("a polygon can't cross the date line")
    return ring
