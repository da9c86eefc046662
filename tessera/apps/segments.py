"""Copy detection from timed segments: window grids, candidates, margins, chains of hits, coverage.

Hits of one query and one reference are chained in a grouped function, since a chain's next hit depends on those before;
a group is one query against one reference, so its size is bounded by the query's length. Everything else is windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a window and between the starts of two, and the shifts at which a query's grid is repeated.
WINDOW_S, HOP_S = 5.0, 2.5
SHIFTS_S = (0.0, 0.625, 1.25, 1.875)


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.70
    min_segments: int = 2
    margin: float = 0.03
    max_gap: int = 1
    offset_tolerance_s: float = HOP_S


def intervals(duration: Column, window: float = WINDOW_S, hop: float = HOP_S) -> Column:
    """Windows (start_s, end_s) that cover a duration; a last one ends at its end if the grid does not reach it."""
    n = F.floor((duration - window + 1e-9) / hop).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.round(i * hop, 3).alias("start_s"), F.round(i * hop + window, 3).alias("end_s")))
    last = F.array(F.struct(F.round(duration - window, 3).alias("start_s"), F.round(duration, 3).alias("end_s")))
    short = F.array(F.struct(F.lit(0.0).alias("start_s"), F.round(duration, 3).alias("end_s")))
    return F.when(duration <= 0, None).when(duration <= window, short).when(n * hop + window < duration - 1e-9, F.concat(grid, last)).otherwise(grid)


def explode_intervals(df: DataFrame, duration: str, window: float = WINDOW_S, hop: float = HOP_S) -> DataFrame:
    """A row for each window: segment_index, start_s, end_s."""
    return df.select("*", F.posexplode(intervals(F.col(duration), window, hop)).alias("segment_index", "_w")).select("*", "_w.start_s", "_w.end_s").drop("_w")


def merge_shifts(candidates: DataFrame, k: int, query: list[str], segment: str = "segment_id") -> DataFrame:
    """Over repeated shifted grids (shift_s), the best score of each reference segment, moved back by its shift; then the k best."""
    best = candidates.groupBy(*query, segment).agg(*[F.max_by(c, "score").alias(c) for c in candidates.columns if c not in (*query, segment, "score")], F.max("score").alias("score"))
    moved = best.withColumn("start_s", F.col("start_s") - F.col("shift_s")).withColumn("end_s", F.col("end_s") - F.col("shift_s")).drop("shift_s")
    w = Window.partitionBy(*query).orderBy(F.col("score").desc(), segment)
    return moved.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def beats_others(df: DataFrame, segment: list[str], song: str, score: str, margin: float) -> DataFrame:
    """Rows whose score is at least ``margin`` above the best of any other song in the segment; alone, a song passes."""
    per_song = Window.partitionBy(*segment, song)
    by_best = Window.partitionBy(*segment).orderBy(F.col("_best").desc(), song)
    bests = df.withColumn("_best", F.max(score).over(per_song))
    # the best score of the songs other than the leading one, and the leading song itself
    ranked = bests.withColumn("_rank", F.dense_rank().over(by_best))
    own = Window.partitionBy(*segment)
    marked = ranked.withColumn("_first", F.max(F.when(F.col("_rank") == 1, F.col("_best"))).over(own)).withColumn("_second", F.max(F.when(F.col("_rank") == 2, F.col("_best"))).over(own))
    other = F.when(F.col("_rank") == 1, F.col("_second")).otherwise(F.col("_first"))
    return marked.where(other.isNull() | (F.col(score) - other >= margin - 1e-9)).drop("_best", "_rank", "_first", "_second")


def _apart(chains: Column) -> Column:
    """Of chains in order of preference, those that share no stretch of the query with one kept before."""

    def clear(kept: Column, c: Column) -> Column:
        return ~F.exists(kept, lambda k: (k["query_start_s"] < c["query_end_s"]) & (c["query_start_s"] < k["query_end_s"]))

    none = F.filter(chains, lambda c: F.lit(False))
    return F.aggregate(chains, none, lambda kept, c: F.when(clear(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def detect(candidates: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Matches of queries with songs.

    ``candidates``: query_id, segment_index, query_start_s, query_end_s, song_id, reference_start_s, reference_end_s, score.

    The hits of a query and a song are cut into diagonals, runs of offsets (reference less query) without a step above the
    tolerance; a diagonal has one hit a segment, the best. Its runs of segments without too wide a gap are the chains. Of
    those that overlap in the query, the one with more segments stays, then the more similar, then the earlier.
    """
    s = settings or Settings()
    pair = ["query_id", "song_id"]
    cols = ["query_id", "segment_index", "query_start_s", "query_end_s", "song_id", "reference_start_s", "reference_end_s", "score"]
    hits = beats_others(candidates.select(*cols), ["query_id", "segment_index"], "song_id", "score", s.margin).where(F.col("score") >= s.threshold)
    by_offset = Window.partitionBy(*pair).orderBy("offset", "segment_index")
    step = F.col("offset") - F.lag("offset").over(by_offset)
    diagonals = hits.withColumn("offset", F.col("reference_start_s") - F.col("query_start_s")).withColumn("step", step).withColumn("diagonal", F.count(F.when(F.col("step") > s.offset_tolerance_s + 1e-9, 1)).over(by_offset))
    best = diagonals.groupBy(*pair, "diagonal", "segment_index").agg(F.max_by(F.struct(*cols[2:4], *cols[5:]), F.struct("score", -F.col("reference_start_s"))).alias("h")).select(*pair, "diagonal", "segment_index", "h.*")
    by_segment = Window.partitionBy(*pair, "diagonal").orderBy("segment_index")
    gap = F.col("segment_index") - F.lag("segment_index").over(by_segment)
    runs = best.withColumn("gap", gap).withColumn("run", F.count(F.when(F.col("gap") > s.max_gap + 1, 1)).over(by_segment))
    chains = runs.groupBy(*pair, "diagonal", "run").agg(
        (-F.count(F.lit(1))).alias("fewer"), (-F.avg("score")).alias("less"), F.min("segment_index").alias("first"),
        F.min("query_start_s").cast("double").alias("query_start_s"), F.max("query_end_s").cast("double").alias("query_end_s"), F.min("reference_start_s").cast("double").alias("reference_start_s"), F.max("reference_end_s").cast("double").alias("reference_end_s"), F.max("score").alias("top"),
    ).where(F.col("fewer") <= -s.min_segments)
    fields = ["fewer", "less", "first", "query_start_s", "query_end_s", "reference_start_s", "reference_end_s", "top"]
    # the chains of one query and song: no more than the query has segments, for each diagonal
    kept = chains.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chains")).select(*pair, F.explode(_apart(F.col("chains"))).alias("c"))
    times = [F.col(f"c.{n}") for n in fields[3:7]]
    return kept.select(*pair, *times, (-F.col("c.fewer")).cast("int").alias("segments"), F.round(-100 * F.col("c.less"), 1).cast("double").alias("similarity_pct"), F.round(100 * F.col("c.top"), 1).cast("double").alias("max_similarity_pct"))


def timeline(candidates: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The best candidate of each segment, and whether it reaches the threshold."""
    s = settings or Settings()
    best = candidates.groupBy("query_id", "segment_index").agg(F.min("query_start_s").alias("start_s"), F.min("query_end_s").alias("end_s"), F.max_by("song_id", F.struct("score", -F.col("song_id"))).alias("best_song_id"), F.max("score").alias("best"))
    return best.select("query_id", "segment_index", "start_s", "end_s", "best_song_id", F.round(100 * F.col("best"), 1).alias("best_similarity_pct"), (F.col("best") >= s.threshold).alias("above_threshold"))


def islands(df: DataFrame, keys: list[str], start: str, end: str, max_gap: float = 0.0) -> DataFrame:
    """(keys, start, end, n) of the runs of intervals with no gap above ``max_gap`` between them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + max_gap), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_run")


def coverage(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, covered): the length of the union of intervals."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))
