"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the majority of the XXH64 hashes (seed 42) of its 4-word shingles, bit by bit. Fingerprints
that differ in at most 4 bits are linked. The 64 bits are cut into three segments with search radii 1, 1 and 0:
if two fingerprints differed in two bits or more of the first and of the second segment and in one or more of the
third, they would differ in at least five, so every link agrees within the radius in some segment. The ball of radius 1
is enumerated upwards only (bits that are 0 are set): of two keys one bit apart, one reaches the other.
Table matches are verified by their complete distance.

Equal fingerprints are collapsed before the search, so a group of copies of any size costs one row. The home of a
fingerprint is its own key; probes are the keys of its ball. A key at which more than HOT homes meet, or at which homes
and probes make more than WORK pairs, is not joined row by row: homes and probes are dealt into blocks, and each pair of
blocks returns the links of a spanning forest, which joins the same components without listing a dense group's pairs.
Joins of tables as long as the input are merges: no such table goes through the driver as a broadcast.

Fingerprints are the nodes, so repeated ids with different texts stay apart, and ties (equal fingerprints) are one node.
Null and blank texts have fingerprint zero and link like any other. Rows with a null id get a fingerprint and the
component of their fingerprint's group (null if no row of the group has an id). Very long texts are read whole, CHUNK
shingles at a time. An empty table gives no rows. Only the id and the text are read: other columns clash with nothing.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, connected_components, per_batch

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits, radius) of the segments, lowest bits first.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
#: Homes, and pairs of a home and a member, that a key may have before blocks replace the row by row join; members of a block.
HOT, WORK, BLOCK = 64, 1 << 16, 1024
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words (fewer words: the whole sequence; none: no hash)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = [len(w) + 1 for w in words]
    starts = list(accumulate(lengths, initial=0))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : b - 1], seed) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash as a signed integer."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fp: long) of every row; ``mark`` is a hash of the text, null as empty."""
    text_ = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return per_batch(docs.select(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(text_), text_), lambda c: [c[0], c[1], [fingerprint(t) for t in c[2]]], "doc_id bigint, mark bigint, fp bigint")


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a spanning forest between the homes and the members of two blocks."""
    fps = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
    homes = np.searchsorted(fps, np.unique(pdf.loc[pdf["home"], "fp"].to_numpy(np.int64).view(np.uint64)))
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for i in homes.tolist():
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= DISTANCE).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
    signed = fps.view(np.int64)
    return pd.DataFrame({"x": signed[np.array(a, int)], "y": signed[np.array(b, int)]})


def links(distinct: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(x, y) fingerprints that connect every two fingerprints of ``distinct`` (fp: long, no repeats) within DISTANCE.

    Spark takes exploded rows to be as few as the rows they come from, and would broadcast them through the driver: the
    join with the homes is told to merge, and the crowded keys are written, so that their size is known.
    """
    scratch = scratch or Scratch(distinct.sparkSession)
    rows = []
    for k, (low, bits, radius) in enumerate(SEGMENTS):
        key = f"(shiftrightunsigned(fp, {low}) & {(1 << bits) - 1}L)"
        keys = f"array(named_struct('k', {key}, 'home', true))"
        if radius:
            keys = f"concat({keys}, transform(filter(sequence(0, {bits - 1}), i -> ({key} & shiftleft(1L, i)) = 0), i -> named_struct('k', {key} | shiftleft(1L, i), 'home', false)))"
        rows.append(distinct.selectExpr("fp", f"explode({keys}) as p").selectExpr("fp", f"p.k * {len(SEGMENTS)} + {k} as bucket", "p.home as home"))
    probes = rows[0].unionByName(rows[1]).unionByName(rows[2])
    homes = probes.filter("home").select("bucket", F.col("fp").alias("other"))
    counts = probes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes")).filter("homes > 0 AND n > 1")
    hot = scratch.write(counts.filter((F.col("homes") > HOT) | (F.col("homes") * F.col("n") > WORK)))
    cold = probes.join(hot, "bucket", "left_anti").join(homes.hint("merge"), "bucket").filter((F.expr("bit_count(fp ^ other)") <= DISTANCE) & ((~F.col("home")) | (F.col("fp") < F.col("other")))).select(F.col("fp").alias("x"), F.col("other").alias("y"))
    # a group of a block of homes and a block of members: each member once for every block of homes, each home for every block of members
    met = probes.join(hot, "bucket").select("bucket", "fp", "home", F.ceil(F.col("homes") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("cols"), F.xxhash64("fp").alias("h"))
    as_home = met.filter("home").select("bucket", F.pmod("h", "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), "fp", F.lit(True).alias("home"))
    as_member = met.select("bucket", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod("h", "cols").cast("int").alias("j"), "fp", F.lit(False).alias("home"))
    return cold.unionByName(as_home.unionByName(as_member).groupBy("bucket", "i", "j").applyInPandas(_forest, "x bigint, y bigint"))


def _components(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, component) of the distinct fingerprints of ``fps``; a component's name is one of its fingerprints."""
    distinct = scratch.write(fps.select("fp").distinct())
    found = scratch.write(links(distinct, scratch))
    parts = connected_components(found.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    return distinct.join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp: long, component_id) of every row; component_id is the smallest id reachable by links."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, doc_id, text).drop("mark"))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(_components(fps, scratch).hint("merge"), "fp")
    groups = scratch.write(groups)
    least = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = scratch.write(groups.join(least.hint("merge"), "component").select("fp", "component_id"))
    return fps.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One whole row of each component, with the columns of ``docs``: the smallest id's (rows without an id come last).

    A row is known by its id and a hash of its text, not by the id alone, so rows that share an id but are no near
    copies all stay. Of rows that are equal in both, the one with the least hash of its other columns stays.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, doc_id, text))
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    groups = fps.groupBy("fp").agg(F.min(key).alias("key"))
    kept = scratch.write(groups.join(_components(fps, scratch).hint("merge"), "fp").groupBy("component").agg(F.min("key").alias("key")).select("key.*"))
    id_ = F.col(f"`{doc_id}`").cast("long")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text and not f.dataType.simpleString().count("map<")]
    # the whole row is one column, so that its names clash with none of these
    rows = docs.select(F.struct("*").alias("row"), id_.isNull().alias("late"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("mark"), F.xxhash64(F.lit(0), *plain).alias("rest"))
    # copies of a row meet in the tasks that read them before they are shuffled; the join keeps that partitioning
    one = rows.groupBy("late", "id", "mark").agg(F.min_by("row", "rest").alias("row"))
    return one.join(kept.hint("merge"), ["late", "id", "mark"], "left_semi").select("row.*")
