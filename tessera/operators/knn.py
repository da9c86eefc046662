"""Nearest neighbours: exact by expressions, in blocks for many queries, and by cells of a k-means index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.errors import QueryError
from tessera.functions import vector as vx

#: Bytes of one block of a query set, which is broadcast, and distances that a task holds at a time.
BLOCK_BYTES, HELD = 8 << 20, 1 << 20
#: Cells that an index search reads first.
PROBE = 4


def knn(df: DataFrame, vector: str, target: Sequence[float], k: int, metric: str = "cosine", key: str | None = None) -> DataFrame:
    """``df``'s k nearest usable rows with distance and score; ties by key."""
    if k < 1:
        raise QueryError("k must be positive")
    near = with_distance(df, vector, target, metric)
    return near.orderBy("distance", *([key] if key else [])).limit(k)


def with_distance(df: DataFrame, vector: str, target: Sequence[float], metric: str = "cosine") -> DataFrame:
    d = vx.distance(F.col(vector), vx.literal(target), metric)
    return df.where(vx.usable(F.col(vector), len(target))).withColumn("distance", d).withColumn("score", vx.score(F.col("distance"), metric))


def within(df: DataFrame, vector: str, target: Sequence[float], least: float, metric: str = "cosine") -> DataFrame:
    """Rows whose score reaches ``least``."""
    return with_distance(df, vector, target, metric).where(F.col("score") >= least)


def knn_join(queries: DataFrame, base: DataFrame, query_key: str, base_key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(query, neighbour, distance, score): the k nearest base rows of each query row, ties by key.

    Queries go by blocks of about BLOCK_BYTES, each a pass over the base. A block's matrix goes to every task; a task
    multiplies it with its own rows in batches and keeps k for each query, so the shuffle carries k rows for each query and task.
    """
    spark = base.sparkSession
    schema = f"query {queries.schema[query_key].dataType.simpleString()}, neighbour {base.schema[base_key].dataType.simpleString()}, distance double"
    parts = [_of_block(base, base_key, vector, spark.sparkContext.broadcast(block), block[1].shape[1], k, metric, schema) for block in _query_blocks(queries, query_key, vector)]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("score", F.col("distance"))
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    return reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n").withColumn("score", vx.score(F.col("distance"), metric))


def _of_block(base: DataFrame, base_key: str, vector: str, q: Broadcast, dim: int, k: int, metric: str, schema: str) -> DataFrame:
    """The k nearest rows of each query of a block, by task."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = q.value
        held = None
        for batch in batches:
            if batch.num_rows:
                keys = np.array(batch.column(0).to_pylist(), object)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                held = _merge(held, matrix, keys, x, k, metric)
        if held is not None:
            d, ks = held
            cols = ([n for n in names for _ in range(d.shape[1])], ks.ravel().tolist(), d.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return base.select(base_key, vector).where(vx.usable(F.col(vector), dim)).mapInArrow(run, schema)


def _query_blocks(queries: DataFrame, query_key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """(keys, matrix) of the usable query rows, in blocks of about BLOCK_BYTES."""
    rows = queries.select(query_key, vector).where(vx.usable(F.col(vector)))
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = -(-n * (dim or 0) * 8 // BLOCK_BYTES)
    for i in range(blocks):
        block = rows.where(F.pmod(F.xxhash64(query_key, vector), F.lit(blocks)) == i).collect() if blocks > 1 else rows.collect()
        if block:
            yield [r[0] for r in block], np.array([r[1] for r in block], np.float64)


def _merge(held: tuple[np.ndarray, np.ndarray] | None, matrix: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(distances, keys) of the k nearest of each query among those held and the rows ``x``; ties by key."""
    by_key = np.argsort(keys, kind="stable")
    keys, x = keys[by_key], x[by_key]
    step = max(1, HELD // max(1, len(matrix)))
    for at in range(0, len(keys), step):
        d = vx.np_distance(matrix, x[at : at + step], metric)
        top = np.argsort(d, axis=1, kind="stable")[:, :k]
        d, ks = np.take_along_axis(d, top, 1), keys[at : at + step][top]
        if held is not None:
            d, ks = np.concatenate([held[0], d], axis=1), np.concatenate([held[1], ks], axis=1)
            # a stable order by key first makes ties exact
            order = np.argsort(ks, axis=1, kind="stable")
            d, ks = np.take_along_axis(d, order, 1), np.take_along_axis(ks, order, 1)
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            d, ks = np.take_along_axis(d, top, 1), np.take_along_axis(ks, top, 1)
        held = d, ks
    return held


@dataclass
class IvfIndex:
    """Vectors stored by the cell of their nearest k-means centre; a search reads the cells that can hold a result.

    ``bounds`` has each cell's largest distance and angle from its centre. A search reads the PROBE nearest cells, and
    then every cell whose bound does not exceed the k-th distance found there: its results are those of an exact scan.
    Where bounds prune little, as in many dimensions, it reads most cells.
    """

    spark: SparkSession
    path: str
    vector: str

    @classmethod
    def build(cls, df: DataFrame, vector: str, path: str, lists: int = 16, seed: int = 42) -> IvfIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        fine = df.where(vx.usable(F.col(vector)))
        model = KMeans(k=lists, seed=seed, featuresCol="_f", predictionCol="_cell", maxIter=10).fit(fine.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_f")))
        cells = model.transform(fine.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))).drop("_f")
        # rows of a cell lie in few files, so that reading a cell reads those alone
        cells.repartition("_cell").write.mode("overwrite").partitionBy("_cell").parquet(f"{path}/cells")
        df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index = cls(df.sparkSession, path, vector)
        index._bounds_of(df.sparkSession.read.parquet(f"{path}/cells")).write.mode("overwrite").parquet(f"{path}/bounds")
        return index

    def _bounds_of(self, rows: DataFrame) -> DataFrame:
        """(cell, radius, angle) of the cells of ``rows``; any angle where a zero vector has none."""
        v, c = F.col(self.vector), F.col("_centre")
        found = rows.join(F.broadcast(self.spark.read.parquet(f"{self.path}/centres").select("cell", F.col("centre").alias("_centre"))), F.col("_cell") == F.col("cell"))
        angle = F.when((vx.norm(v) < 1e-12) | (vx.norm(c) < 1e-12), F.lit(float(np.pi))).otherwise(F.acos(1 - vx.distance(v, c)))
        return found.groupBy("cell").agg(F.max(vx.distance(v, c, "euclidean")).alias("radius"), F.max(angle).alias("angle")).coalesce(1)

    def _least(self, targets: np.ndarray, metric: str) -> tuple[list[int], np.ndarray]:
        """The cells, and a lower bound of the distance of each target to any row of each cell."""
        rows = sorted((r.cell, r.centre) for r in self.spark.read.parquet(f"{self.path}/centres").collect())
        cells, centres = [i for i, _ in rows], np.array([c for _, c in rows], float)
        try:
            bounds = {r.cell: (r.radius, r.angle) for r in self.spark.read.parquet(f"{self.path}/bounds").groupBy("cell").agg(F.max("radius").alias("radius"), F.max("angle").alias("angle")).collect()}
        except AnalysisException:  # an index stored without bounds: every cell may hold a result
            bounds = {}
        # a cell without a bound is read
        radius, angle = np.array([bounds.get(i, (np.inf, np.pi)) for i in cells]).T
        metric, norms = vx.metric_name(metric), np.linalg.norm(targets, axis=1)[:, None]
        far = np.array([np.linalg.norm(centres - t, axis=1) for t in targets])
        # room for rounding, in the distance's own scale
        room = 1e-6 * (1 + norms + np.linalg.norm(centres, axis=1))
        if metric == "euclidean":
            return cells, far - radius - room
        if metric == "dot_product":
            with np.errstate(invalid="ignore"):
                reach = np.where(norms > 0, norms * radius, 0.0)
            return cells, -(targets @ centres.T + reach) - room * (1 + norms)
        turn = np.arccos(np.clip(1 - vx.np_distance(targets, centres, metric), -1, 1))
        return cells, np.where(norms < 1e-12, 0.0, 1 - np.cos(np.maximum(0, turn - angle))) - 1e-6

    def _nearest_cells(self, target: Sequence[float], probe: int, metric: str) -> list[int]:
        rows = sorted((r.cell, r.centre) for r in self.spark.read.parquet(f"{self.path}/centres").collect())
        d = vx.np_distance(np.array([target], float), np.array([c for _, c in rows]), metric)[0]
        return [rows[i][0] for i in np.argsort(d, kind="stable")[:probe]]

    def search(self, target: Sequence[float], k: int, metric: str = "cosine", probe: int | None = None, key: str | None = None) -> DataFrame:
        """The k nearest rows: exact, or of the ``probe`` nearest cells alone where that is given."""
        rows = self.spark.read.parquet(f"{self.path}/cells")
        cells = self._nearest_cells(target, probe or PROBE, metric)
        if probe is None:
            near = [r.distance for r in knn(rows.where(F.col("_cell").isin(cells)), self.vector, target, k, metric, key).select("distance").collect()]
            every, least = self._least(np.array([target], float), metric)
            cells = [c for c, d in zip(every, least[0], strict=True) if len(near) < k or d <= near[-1]]
        return knn(rows.where(F.col("_cell").isin(cells)).drop("_cell"), self.vector, target, k, metric, key)

    def search_join(self, queries: DataFrame, query_key: str, base_key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
        """(query, neighbour, distance, score): the k nearest rows of each query row, exact, ties by key.

        Queries go by blocks; a task keeps k rows for each of its cells and each query that reads the cell.
        """
        base = self.spark.read.parquet(f"{self.path}/cells")
        schema = f"query {queries.schema[query_key].dataType.simpleString()}, neighbour {base.schema[base_key].dataType.simpleString()}, distance double"
        best = Window.partitionBy("query").orderBy("distance", "neighbour")
        out = self.spark.createDataFrame([], schema)
        for names, matrix in _query_blocks(queries, query_key, vector):
            cells, least = self._least(matrix, metric)
            first = np.argsort(least, axis=1, kind="stable")[:, :PROBE]
            wanted = np.zeros(least.shape, bool)
            np.put_along_axis(wanted, first, True, axis=1)
            near = self._of_cells(base, base_key, list(range(len(names))), matrix, cells, wanted, k, metric, schema.replace(schema.split(",")[0], "query int"))
            found = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query", "distance").collect()
            reach = np.full(len(names), np.inf)
            for r in found:
                reach[r.query] = r.distance
            near = self._of_cells(base, base_key, names, matrix, cells, least <= reach[:, None], k, metric, schema)
            out = out.unionByName(near)
        return out.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n").withColumn("score", vx.score(F.col("distance"), metric))

    def _of_cells(self, base: DataFrame, base_key: str, names: list, matrix: np.ndarray, cells: list[int], wanted: np.ndarray, k: int, metric: str, schema: str) -> DataFrame:
        """The k nearest rows of each query in each wanted cell, by task."""
        arrow = to_arrow_schema(T._parse_datatype_string(schema))
        q = self.spark.sparkContext.broadcast((names, matrix, {c: np.flatnonzero(wanted[:, i]) for i, c in enumerate(cells)}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, readers = q.value
            held = {}
            for batch in batches:
                cell = batch.column(2).to_numpy()
                keys = np.array(batch.column(0).to_pylist(), object)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) if batch.num_rows else None
                for c in np.unique(cell).tolist():
                    if len(readers[c]):
                        held[c] = _merge(held.get(c), matrix[readers[c]], keys[cell == c], x[cell == c], k, metric)
            for c, (d, ks) in held.items():
                cols = ([names[i] for i in readers[c].tolist() for _ in range(d.shape[1])], ks.ravel().tolist(), d.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, arrow, strict=True)], schema=arrow)

        read = [c for i, c in enumerate(cells) if wanted[:, i].any()]
        return base.where(F.col("_cell").isin(read) & vx.usable(F.col(self.vector), matrix.shape[1])).select(base_key, self.vector, "_cell").mapInArrow(run, schema)

    def add(self, df: DataFrame) -> None:
        """Appends rows to the cells of their nearest centres."""
        rows = sorted((r.cell, r.centre) for r in self.spark.read.parquet(f"{self.path}/centres").collect())
        near = F.array_min(F.array(*[F.struct(vx.distance(F.col(self.vector), vx.literal(c), "euclidean").alias("d"), F.lit(i).alias("c")) for i, c in rows]))["c"]
        new = df.where(vx.usable(F.col(self.vector))).withColumn("_cell", near)
        # bounds first: they may be too wide, never too narrow
        self._bounds_of(new).write.mode("append").parquet(f"{self.path}/bounds")
        new.write.mode("append").partitionBy("_cell").parquet(f"{self.path}/cells")


def bow_tfidf(words: DataFrame, key: str, word: str) -> DataFrame:
    """(key, word, weight): L2-normalised histogram of visual or audio words, idf ``ln((n + 1) / (df + 1)) + 1``."""
    counts = words.groupBy(key, word).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(key).agg(F.sum("_c").alias("_t"))
    df = counts.groupBy(word).agg(F.count(F.lit(1)).alias("_df"))
    n = totals.agg(F.count(F.lit(1)).alias("_n"))
    weighted = counts.join(totals, key).join(df, word).crossJoin(F.broadcast(n)).withColumn("_w", F.col("_c") / F.col("_t") * (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighted.join(norms, key).select(key, word, (F.col("_w") / F.col("_norm")).alias("weight"))


def quantize(descriptors: DataFrame, vector: str, words: int, seed: int = 42) -> DataFrame:
    """``descriptors`` with the word (k-means cell) of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = descriptors.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=words, seed=seed, featuresCol="_f", predictionCol="word").fit(rows).transform(rows).drop("_f")
