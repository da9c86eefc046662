"""CSV with a header: inferred or declared types, and a report of the rows left out.

All cells are read as text, in parallel; the types of all columns come from one aggregation over the file, and casts are
expressions. An empty cell is null. Rows with too many or too few cells are found by counting cells of the raw
line in quotes' sense, through Spark's own CSV parser.
"""

from __future__ import annotations

import csv as stdlib_csv
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import LoadError
from tessera.types import INTEGER_RANGES, SPARK_TYPES

# fixed values: words that read as booleans
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y"), ("false", "f", "no", "n")
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
SPATIAL_KINDS = ("POINT", "POLYGON", "RECTANGLE")


@dataclass
class Loaded:
    """Rows with their types, the types' names, and the rows left out: (line, reason)."""

    rows: DataFrame
    types: dict[str, str]
    skipped: DataFrame


def _numbers(cell: Column) -> Column:
    return F.transform(F.regexp_extract_all(cell, F.lit(f"({NUMBER})")), lambda x: x.cast("double"))


def _ranged(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def _spatial_body(cell: Column, kind: str) -> Column:
    """Nothing but numbers, separators and POINT between the kind's parentheses."""
    body = F.regexp_replace(F.trim(cell), rf"(?i)^\s*{kind}\s*\(", "")
    rest = F.regexp_replace(F.regexp_replace(body, NUMBER, ""), "(?i)POINT", "")
    return F.trim(cell).endswith(")") & ~rest.rlike(r"[^ ,()\t]")


def parse_spatial(cell: Column, kind: str) -> Column:
    """A cell in WKT or the dialect's own syntax to its struct; null if it is none. A polygon is closed if it isn't."""
    n = _numbers(cell)
    named = cell.rlike(rf"(?i)^\s*{kind}\s*\(") & _spatial_body(cell, kind)
    bare = ~cell.rlike(r"[^0-9eE+\-., \t]")
    fits = named | bare
    if kind == "POINT":
        lon, lat = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        return F.when(fits & (F.size(n) == 2) & _ranged(lon, lat), F.struct(lon.alias("lon"), lat.alias("lat")))
    if kind == "RECTANGLE":
        w, s, e, t = (F.get(n, F.lit(i)) for i in range(4))
        return F.when(fits & (F.size(n) == 4) & _ranged(w, s) & _ranged(e, t) & (s <= t), F.struct(w.alias("west"), s.alias("south"), e.alias("east"), t.alias("north")))
    pts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(n) / 2).cast("int") - 1)), lambda i: F.struct(F.get(n, 2 * i).alias("lon"), F.get(n, 2 * i + 1).alias("lat")))
    ring = F.when(F.get(pts, F.lit(0)) == F.element_at(pts, -1), pts).otherwise(F.concat(pts, F.slice(pts, 1, 1)))
    ok = (F.size(n) % 2 == 0) & (F.size(ring) >= 4) & (F.size(F.array_distinct(ring)) >= 3) & F.forall(ring, lambda p: _ranged(p["lon"], p["lat"]))
    wide = F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ring) - 2)), lambda i: F.abs(F.get(ring, i)["lon"] - F.get(ring, i + 1)["lon"]) > 180)
    return F.when(fits & ok & ~wide, ring)


def cast(cell: Column, kind: str, size: int | None = None) -> Column:
    """A text cell to a type; null if it does not fit."""
    word = F.lower(F.trim(cell))
    if kind in INTEGER_RANGES:
        low, high = -INTEGER_RANGES[kind], INTEGER_RANGES[kind] - 1
        wide = F.when(F.trim(cell).rlike(r"^[+-]?\d+$"), F.trim(cell).try_cast("decimal(38,0)"))
        return F.when(wide.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), wide).cast(SPARK_TYPES[kind])
    if kind in ("DOUBLE PRECISION", "NUMERIC"):
        return F.trim(cell).try_cast(SPARK_TYPES[kind])
    if kind == "REAL":
        wide = F.trim(cell).try_cast("double")
        # a value that 32 bits can't hold exactly is refused
        return F.when(wide.cast("float").cast("double") == wide, wide.cast("float"))
    if kind == "BOOLEAN":
        return F.when(word.isin(*TRUE_WORDS, "1"), True).when(word.isin(*FALSE_WORDS, "0"), False)
    if kind == "DATE":
        return F.when(F.trim(cell).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(cell).try_cast("date"))
    if kind == "TIME":
        return F.when(F.trim(cell).rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"), F.trim(cell))
    if kind == "TIMESTAMP":
        return F.trim(cell).try_cast("timestamp_ntz")
    if kind == "BYTEA":
        return F.when(F.trim(cell).rlike("^([0-9a-fA-F]{2})*$"), F.unhex(F.trim(cell)))
    if kind in SPATIAL_KINDS:
        return parse_spatial(cell, kind)
    if size:
        return F.when(F.length(cell) <= size, cell)
    return cell


def infer(cells: DataFrame) -> dict[str, tuple[str, int | None]]:
    """(type, size) of each column: the narrowest of integer, double, boolean word, spatial literal and text that all cells fit."""
    aggs = []
    for i, name in enumerate(cells.columns):
        c = F.col(f"`{name}`")
        tests = {
            "int": F.trim(c).rlike(r"^[+-]?\d+$"),
            "float": F.trim(c).rlike(rf"(?i)^({NUMBER}|[+-]?(inf(inity)?|nan))$"),
            "bool": F.lower(F.trim(c)).isin(*TRUE_WORDS, *FALSE_WORDS),
            **{k: c.rlike(rf"(?i)^\s*{k}\s*\(") & parse_spatial(c, k).isNotNull() for k in SPATIAL_KINDS},
        }
        aggs += [F.count(F.when(t, 1)).alias(f"{i}_{k}") for k, t in tests.items()]
        aggs += [F.count(c).alias(f"{i}_n"), F.max(F.length(c)).alias(f"{i}_len")]
    r = cells.agg(*aggs).first()
    out: dict[str, tuple[str, int | None]] = {}
    for i, name in enumerate(cells.columns):
        n = r[f"{i}_n"]
        every = lambda k, i=i, n=n: n and r[f"{i}_{k}"] == n
        spatial = [k for k in SPATIAL_KINDS if r[f"{i}_{k}"]]
        if every("int"):
            out[name] = ("INTEGER", None)
        elif every("float"):
            out[name] = ("DOUBLE PRECISION", None)
        elif every("bool"):
            out[name] = ("BOOLEAN", None)
        elif n and sum(r[f"{i}_{k}"] for k in spatial) == n:
            out[name] = (spatial[0] if len(spatial) == 1 else "GEOMETRY", None)
        else:
            longest = r[f"{i}_len"] or 0
            out[name] = ("VARCHAR", 32 if longest == 0 else next((s for s in (16, 32, 64, 128, 256, 512) if longest <= s), longest + 32))
    return out


def header(spark: SparkSession, path: str) -> list[str]:
    lines = spark.read.text(path, lineSep="\n").limit(1).collect()
    if not lines or not lines[0][0].lstrip("﻿").strip():
        raise LoadError(f"{path} is empty")
    names = [n.strip() for n in next(stdlib_csv.reader([lines[0][0].lstrip("﻿").rstrip("\r")]))]
    if len(set(names)) < len(names) or not all(names):
        raise LoadError(f"{path} repeats or omits a column name")
    return names


def load(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, on_error: str = "stop") -> Loaded:
    """Reads a CSV file. ``types`` override inferred ones, as ``VARCHAR(20)`` or ``DATE``.

    With on_error 'stop', the first bad row raises; with 'ignore', bad rows are left out and reported.
    """
    if on_error not in ("stop", "ignore"):
        raise LoadError("on_error is 'stop' or 'ignore'")
    names = header(spark, path)
    extra = "_beyond"
    text = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(extra, T.StringType()), T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(text).csv(path, header=True, enforceSchema=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", nullValue="", emptyValue="")
    # a whole row has one cell fewer than this schema, which Spark marks; one that it does not mark has a cell too many
    line = F.coalesce("_corrupt", F.concat_ws(",", *[F.coalesce(F.col(f"_c{i}"), F.lit("")) for i in range(len(names))]))
    short = F.col("_corrupt").isNull() | (F.size(F.split(F.regexp_replace("_corrupt", r'"([^"]|"")*"', "q"), ",", -1)) != len(names))
    marked = raw.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], line.alias("_line"), short.alias("_ragged"))
    good = marked.where(~F.coalesce("_ragged", F.lit(False)))
    chosen: dict[str, tuple[str, int | None]] = {}
    overrides = {k: _declared(v) for k, v in (types or {}).items()}
    if unknown := set(overrides) - set(names):
        raise LoadError(f"{path} has no column {', '.join(sorted(unknown))}")
    inferred = infer(good.select(*[n for n in names if n not in overrides])) if len(overrides) < len(names) else {}
    for n in names:
        chosen[n] = overrides.get(n) or inferred[n]
    cells = {n: _geometry(F.col(f"`{n}`")) if k == "GEOMETRY" else cast(F.col(f"`{n}`"), k, s) for n, (k, s) in chosen.items()}
    bad = F.lit(None).cast("string")
    for n, c in cells.items():
        bad = F.coalesce(bad, F.when(F.col(f"`{n}`").isNotNull() & c.isNull(), F.lit(f"{n} is no {chosen[n][0]}")))
    reason = F.when(F.coalesce("_ragged", F.lit(False)), f"not {len(names)} cells").otherwise(bad)
    judged = marked.withColumn("_reason", reason)
    skipped = judged.where("_reason IS NOT NULL").select(F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    if on_error == "stop" and (first := skipped.take(1)):
        raise LoadError(f"{path}: {first[0].reason}: {first[0].line}")
    rows = judged.where("_reason IS NULL").select(*[c.alias(n) for n, c in cells.items()])
    return Loaded(rows, {n: k + (f"({s})" if s else "") for n, (k, s) in chosen.items()}, skipped)


def _geometry(cell: Column) -> Column:
    pt, rect, ring = (parse_spatial(cell, k) for k in ("POINT", "RECTANGLE", "POLYGON"))
    kind = F.when(cell.rlike(r"(?i)^\s*POLYGON"), "POLYGON").when(cell.rlike(r"(?i)^\s*RECTANGLE"), "RECTANGLE").otherwise("POINT")
    return geometry(F.when(kind == "POINT", pt), F.when(kind == "RECTANGLE", rect), F.when(kind == "POLYGON", ring))


def geometry(pt: Column, rect: Column, ring: Column) -> Column:
    """The tagged struct of whichever is not null, with its centroid."""
    from tessera.functions import spatial as sx

    kind = F.when(pt.isNotNull(), "POINT").when(rect.isNotNull(), "RECTANGLE").when(ring.isNotNull(), "POLYGON")
    centre = F.coalesce(pt, F.when(rect.isNotNull(), sx.rectangle_centroid(rect)), F.when(ring.isNotNull(), sx.ring_centroid(ring)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), pt.alias("pt"), rect.alias("rect"), ring.alias("ring"), centre.alias("centroid")))


def _declared(spec: str) -> tuple[str, int | None]:
    name, _, size = spec.strip().upper().replace("_", " ").partition("(")
    name = name.strip()
    if name not in SPARK_TYPES:
        raise LoadError(f"unknown type {spec}")
    return name, int(size.rstrip(") ")) if size else None
