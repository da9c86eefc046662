"""Folders of images, audio or text as tables: one row for each readable file, in name order; the rest reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import LoadError

GLOBS = {"image": "*.{jpg,jpeg,png,JPG,JPEG,PNG}", "audio": "*.{wav,mp3,WAV,MP3}", "text": "*.{txt,TXT}"}


def _empty(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Names of the folder's empty files, which a scan passes over."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    ends = tuple(f".{x.lower()}" for x in GLOBS[kind][3:-1].split(","))
    return sorted(f.getPath().getName() for f in files if f.isFile() and not f.getLen() and f.getPath().getName().lower().endswith(ends))


def load(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped). Images and audio: id, nombre, ruta; text: id, titulo, contenido. Empty files are skipped.

    Text is UTF-8, with or without a mark, or else Latin-1. Numbers follow the names' order; a folder's listing
    is what the driver holds anyway, but contents stay distributed.
    """
    if kind not in GLOBS:
        raise LoadError(f"unknown kind {kind}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOBS[kind]).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("name"))
    order = listed.select("path", F.row_number().over(Window.orderBy("name", "path")).alias("id"))
    skipped = spark.createDataFrame([(n, "empty") for n in _empty(spark, folder, kind)], "name string, reason string")
    if kind != "text":
        rows = order.select(F.col("id").cast("int").alias("id"), F.element_at(F.split("path", "/"), -1).alias("nombre"), F.col("path").alias("ruta"))
        return rows, skipped
    # UTF-8 that is valid comes back as the same bytes
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    body = F.regexp_replace(F.coalesce(utf8, F.decode("content", "ISO-8859-1")), "^﻿", "")
    texts = files.join(order, "path").select(F.col("id").cast("int").alias("id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("titulo"), body.alias("contenido"))
    blank = F.trim("contenido") == ""
    return texts.where(~blank), skipped.unionByName(texts.where(blank).select(F.col("titulo").alias("name"), F.lit("blank").alias("reason")))
