"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that Python handles at a time, and that cross from the JVM in one Arrow batch.
SLICE_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


_temporary: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one temporary folder where it is unset (tests on one machine)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="tessera-"))
    return _temporary[0]


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive any executor. The folder goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        if self.n == 1:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch", None):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def only(self, df: DataFrame) -> DataFrame:
        """Drops every table written here but ``df``, which must have been written here itself."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in system.listStatus(root):
            if found.getPath().getName() != df._scratch.rsplit("/", 1)[1]:
                system.delete(found.getPath(), True)
        return df


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to SLICE_ROWS: texts are long, and both sides hold whole batches outside the heap."""
    if not 0 < int(spark.conf.get(BATCH_SETTING, "10000")) <= SLICE_ROWS:
        spark.conf.set(BATCH_SETTING, str(SLICE_ROWS))


def per_batch(df: DataFrame, fn: Callable[[list[list]], list[list]], schema: str | T.StructType, own: dict | None = None, order: list[int] | None = None) -> DataFrame:
    """fn gets the columns of at most SLICE_ROWS rows as lists (in ``order``, if given), and returns those of ``schema``.

    ``own`` is what fn keeps between batches; it is let go when a task ends, as a worker goes on to other tasks.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    cols = [c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]
                    got = fn([cols[i] for i in order] if order else cols)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, arrow, strict=True)], schema=arrow)
        finally:
            if own is not None:
                own.clear()
            give_back()

    return df.mapInArrow(run, struct)


def per_text(docs: DataFrame, keep: tuple[str, ...], text: str, fn: Callable[[list[list]], list[list]], more: str, own: dict | None = None) -> DataFrame:
    """Like per_batch: fn gets the columns ``keep`` and the text, and returns ``keep`` and the columns ``more``.

    A kept column whose name one of ``more`` has comes back as ``<name>_kept``; columns that are not kept clash with nothing.
    """
    names = list(dict.fromkeys([*keep, text]))
    df = docs.select(*[F.col(f"`{n}`") if n in keep else F.col(f"`{n}`").cast("string").alias(n) for n in names])
    added = T._parse_datatype_string(more)
    taken = {f.name.lower() for f in added}
    kept = []
    for k in keep:
        name = k
        while name.lower() in taken:
            name += "_kept"
        taken.add(name.lower())
        kept.append(T.StructField(name, docs.schema[k].dataType))
    return per_batch(df, fn, T.StructType([*kept, *added]), own, [names.index(n) for n in (*keep, text)])


def least_hashes(rows: DataFrame, most: int) -> list:
    """The ``most`` distinct rows of each label with the least hash, of ``rows`` (label, hash: long, ...), collected.

    A cut-off from each label's approximate count keeps about twice as many rows before anything is shuffled, so the
    sort that picks them reads no more however large the table is. Labels are few; a null label or hash is no row.
    """
    rows = rows.where("label IS NOT NULL AND hash IS NOT NULL")
    half = F.shiftrightunsigned("hash", 1)
    counts = rows.groupBy("label").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()
    if not counts:
        return []
    cuts = [(r.label, min((1 << 63) - 1, int(2 * (most + 50) / max(1, r.n) * (1 << 63)))) for r in counts]
    table = rows.sparkSession.createDataFrame(cuts, T.StructType([T.StructField("label", rows.schema["label"].dataType), T.StructField("cut", T.LongType())]))
    few = rows.join(F.broadcast(table), "label").where(half <= F.col("cut")).drop("cut").distinct()
    order = Window.partitionBy("label").orderBy(half, *[c for c in rows.columns if c != "label"])
    return few.withColumn("nth_", F.row_number().over(order)).where(F.col("nth_") <= most).drop("nth_").collect()


def give_back() -> None:
    """Returns freed memory to the system; workers outlive their tasks, and several share an executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b: long) names; component is the smallest node reachable.

    Alternates large-star and small-star until no edge changes. Each round's edges are a table in the shared
    folder, so a lost executor costs one round at most. Self-links and repeated links are harmless; an empty
    table of edges gives an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        swapped = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        near = both.unionByName(swapped) if large else both.unionByName(swapped).filter("v < u")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = near.join(least, "u")
        if large:
            return linked.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    was = mark(now)
    for _ in range(max_rounds if was[0] else 0):
        new = scratch.write(star(star(now, True), False))
        scratch.drop(now)
        now, last, was = new, was, mark(new)
        if was == last:
            break
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return pairs.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
