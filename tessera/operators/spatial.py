"""Spatial operators: radius, nearest, containment; a grid of cells as the stored index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial as sx

COMPARE = {"<": "__lt__", "<=": "__le__", "=": "__eq__", ">": "__gt__", ">=": "__ge__", "!=": "__ne__"}


def with_distance(df: DataFrame, lon: str, lat: str, center: tuple[float, float], metric: str = "HAVERSINE", alias: str = "distance") -> DataFrame:
    return df.withColumn(alias, sx.METRICS[metric](lon, lat, *center))


def radius(df: DataFrame, lon: str, lat: str, center: tuple[float, float], r: float, metric: str = "HAVERSINE", op: str = "<=") -> DataFrame:
    """Rows whose distance compares with r; for <, <= and = a box predicate goes before, which the scan can push down."""
    if op in ("<", "<=", "="):
        df = df.where(sx.in_any_box(lon, lat, sx.radius_boxes(*center, r, metric)))
    out = with_distance(df, lon, lat, center, metric)
    return out.where(getattr(F.col("distance"), COMPARE[op])(F.lit(float(r))))


def nearest(df: DataFrame, lon: str, lat: str, center: tuple[float, float], k: int, metric: str = "HAVERSINE", ties: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows; null positions come last; each task keeps k rows."""
    return with_distance(df, lon, lat, center, metric).orderBy(F.col("distance").asc_nulls_last(), *ties).limit(k)


def within_polygon(df: DataFrame, lon: str, lat: str, ring: sx.Ring) -> DataFrame:
    return df.where(sx.within_ring(lon, lat, ring))


@dataclass
class GridIndex:
    """A table stored by cells of ``size`` degrees: a box query reads the cells it touches."""

    spark: SparkSession
    path: str
    lon: str
    lat: str
    size: float

    @classmethod
    def build(cls, df: DataFrame, lon: str, lat: str, path: str, size: float = 10.0) -> GridIndex:
        cells = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("_cx", F.floor(F.col(lon) / size).cast("int")).withColumn("_cy", F.floor(F.col(lat) / size).cast("int"))
        cells.repartition("_cx", "_cy").sortWithinPartitions("_cx", "_cy", lon, lat).write.mode("overwrite").partitionBy("_cx", "_cy").parquet(path)
        return cls(df.sparkSession, path, lon, lat, size)

    def in_boxes(self, boxes: Sequence[sx.Box]) -> DataFrame:
        cells = F.lit(False)
        for w, s, e, n in boxes:
            cells = cells | (F.col("_cx").between(int(w // self.size), int(e // self.size)) & F.col("_cy").between(int(s // self.size), int(n // self.size)))
        return self.spark.read.parquet(self.path).where(cells).where(sx.in_any_box(self.lon, self.lat, boxes)).drop("_cx", "_cy")

    def radius(self, center: tuple[float, float], r: float, metric: str = "HAVERSINE", op: str = "<=") -> DataFrame:
        return radius(self.in_boxes(sx.radius_boxes(*center, r, metric)), self.lon, self.lat, center, r, metric, op)

    def extents(self) -> DataFrame:
        """The smallest box round each cell's points."""
        return self.spark.read.parquet(self.path).groupBy("_cx", "_cy").agg(*sx.mbr(self.lon, self.lat), F.count(F.lit(1)).alias("n"))
