"""Document fingerprints by MinHash, and near-duplicate pairs from bands of their signatures.

A text's shingles (five words by default, lower-cased A-Z, split at ASCII white space; fewer words: the whole sequence)
are hashed once; each of SLOTS universal hash functions ``(a * x + b) mod 2**64`` keeps its whole minimum, in
vectorised numpy. The fingerprint holds 16 bits of a mixed hash of each minimum (a minimum's own high bits are 0 in
long texts), and the share of equal slots of two fingerprints estimates the Jaccard likeness of their shingle sets.
Equal texts have equal fingerprints; two texts without words are equal and like each other fully.

``near_components`` joins bands of signatures in Spark, among classes of equal shingle sets, and links the classes whose true
Jaccard likeness of shingle hashes reaches the threshold. Classes that share bands, directly or through others, form a
cluster; a cluster's sets meet once in a task, which tests pairs that share a band until their components are known, so
a group of near copies costs a forest of links and not all its pairs. Clusters of more than BLOCK classes or SET_BYTES are dealt
into blocks, each pair of blocks to a task of its own.

Null texts count as empty. Texts of any length are read whole, in chunks of CHUNK shingles. Rows may repeat and share ids;
rows with a null id come last in the order and take the component of their class (null if no row of the component has an
id). Ties in the order go by a hash of the text, then the text. An empty table gives no rows. Only the id and the text are
read: other columns clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import Scratch, connected_components, per_batch, small_batches
from tessera.llm.simhash import shingle_hashes

SHINGLE, SLOTS, SEED = 5, 128, 20240607
#: Rows of a band and the likeness that near duplicates reach; 25 bands of 5 miss a pair at 0.8 once in 20,000.
BAND, THRESHOLD = 5, 0.8
CHUNK = 2048
#: Bytes of text that one range of ids holds, about.
RANGE_BYTES = 1 << 25
#: Classes, and bytes of their sets, that a block of a cluster holds; sets compared with one at a time.
BLOCK, SET_BYTES, AT_ONCE = 4096, 1 << 26, 64

_rng = np.random.default_rng(SEED)
#: Odd multipliers and offsets of the universal hash functions.
A = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 2**64, SLOTS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each hash function, 64 bits; of no hashes, the largest value everywhere."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, (hashes[at : at + CHUNK, None] * A + B).min(axis=0), out=low)
    return low


def text_signature(text: str | None) -> np.ndarray:
    return signature(np.unique(shingle_hashes(text, SHINGLE, SEED)))


def slots(sig: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, mixed from all of its 64 (the finalizer of splitmix64)."""
    x = (sig ^ (sig >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(48)).astype(np.uint16)


def packed(sig: np.ndarray) -> bytes:
    """The fingerprint: 16 bits of each slot."""
    return slots(sig).astype(">u2").tobytes()


def spell(sig: np.ndarray) -> str:
    """The fingerprint in hex."""
    return packed(sig).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots of two fingerprints."""
    return float(np.mean(slots(a) == slots(b)))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row. No shuffle."""
    return per_batch(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")), lambda c: [c[0], [len(t or "") for t in c[1]], [spell(text_signature(t)) for t in c[1]]], "doc_id bigint, n_chars bigint, fingerprint string")


# ---- each document against its edited text and the next document ---------------------------------------------------


def _neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (range, lead, doc_id, h, text), where ``lead`` marks a copy of the first row after a range's own, and the number of ranges.

    The order is descending doc_id (nulls last), then a hash of the text, then the text. Ranges are cut at quantiles of doc_id, in
    number by the bytes of text; an id that fills several ranges (and the rows without one) is cut further by the hash. No
    document is shuffled more than once but for one copy of each range's first row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ~id is the order's key: it falls as the id rises, without overflow
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("doc_id").isNull().alias("late"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)).alias("k"), F.xxhash64(text).alias("h"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("late"), 1)).alias("late")).first()
    pieces = max(1, -(-(size["bytes"] or 0) // RANGE_BYTES))
    low = -(2**63)
    keys: list[int] = []
    if pieces > 1 and size["n"] > size["late"]:
        keys = sorted(docs.where("not late").agg(F.percentile_approx("k", [i / pieces for i in range(1, pieces)], max(10_000, 20 * pieces))).first()[0])

    def spread(m: int) -> list[int]:
        """Cuts of the hashes into m parts."""
        return [low + i * 2**64 // m for i in range(m)]

    times = {k: keys.count(k) for k in dict.fromkeys(keys)} if len(set(keys)) < len(keys) else dict.fromkeys(keys, 1)
    cuts = [(k, h) for k, m in times.items() for h in spread(m)]
    cut_k, cut_h = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
    late_h = np.array(spread(max(1, -(-pieces * size["late"] // max(1, size["n"])))), np.int64)

    @F.pandas_udf("int")
    def piece(late: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        late, k, h = late.to_numpy(bool), k.to_numpy(np.int64), h.to_numpy(np.int64)
        lo, hi = np.searchsorted(cut_k, k, side="left"), np.searchsorted(cut_k, k, side="right")
        out = lo.copy()
        for at in np.unique(lo[hi > lo]).tolist():
            own = (lo == at) & (hi > lo)
            out[own] = at + np.searchsorted(cut_h[at : hi[own][0]], h[own], side="right")
        out[late] = len(cut_k) + np.searchsorted(late_h, h[late], side="right")
        return pd.Series(out.astype(np.int32))

    dealt = docs.withColumn("range", piece("late", "k", "h"))
    # a row for each range, whose number is bounded by the bytes of text over RANGE_BYTES
    firsts = {r["range"]: (r["first"]["late"], r["first"]["k"], r["first"]["h"]) for r in dealt.groupBy("range").agg(F.min(F.struct("late", "k", "h")).alias("first")).collect()}
    order = sorted(firsts)
    leads = docs.sparkSession.createDataFrame([(*firsts[r], order[i - 1]) for i, r in enumerate(order)], "late boolean, k long, h long, lead_of int")
    copies = docs.join(F.broadcast(leads), ["late", "k", "h"]).groupBy("lead_of", "doc_id", "h").agg(F.min("text").alias("text"))
    own = dealt.select("range", F.lit(0).alias("lead"), "doc_id", "h", "text")
    return own.unionByName(copies.select(F.col("lead_of").alias("range"), F.lit(1).alias("lead"), "doc_id", "h", "text")), len(cuts) + len(late_h) + 1


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def untouched(text: str) -> int:
    """Leading shingles that an edit of the text leaves: those of the whole words before its second half."""
    return max(0, len(text[: len(text) - len(text) // 2].encode().split()) - SHINGLE)


def edited_signature(change: str, same: int, first: np.ndarray) -> np.ndarray:
    """The signature of an edited text whose ``same`` leading shingles have the signature ``first``."""
    rest = change.encode().split(None, same)[same].decode() if same else change
    return np.minimum(first, text_signature(rest))


def class_key(hashes: np.ndarray) -> bytes:
    """What equal shingle sets share."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def against_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, its edited text's, and its likeness to that and to the next document's; the key of its class.

    One shuffle, by ranges of doc_id; a task reads the rows of its range in order and holds two of them at a time.
    Rows that share an id follow each other by a hash of their text; a table of one row has itself for its next document.
    """
    schema = T._parse_datatype_string("doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, key binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for r in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    hashes, same = shingle_hashes(r[4], SHINGLE, SEED), untouched(r[4])
                    first = signature(np.unique(hashes[:same]))
                    now = (*r, np.minimum(first, signature(np.unique(hashes[same:]))), class_key(np.unique(hashes)), same, first)
                    if held is not None and held[0] == now[0] and not held[1]:
                        _, _, i, _, own, sig, key, same, first = held
                        change = edited(own, now[4])
                        other = sig if change == own else edited_signature(change, same, first)
                        out.append((i, len(own), hashlib.sha256(change.encode()).digest(), packed(sig), packed(other), likeness(sig, other), likeness(sig, now[5]), key))
                    held = now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []

    small_batches(docs.sparkSession)
    rows, ranges = _neighbours(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lead", F.col("doc_id").desc_nulls_last(), "h", "text").mapInArrow(run, schema)


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``against_neighbours`` with fingerprints in hex, and the component of near duplicates of every row."""
    found = against_neighbours(docs, doc_id, text)
    near = near_components(docs, doc_id, text)
    # only classes of several documents or with links have a row there; the join is broadcast if they are few
    spelled = [F.lower(F.hex(c)).alias(c) if c in ("edited_sha256", "fingerprint", "edited_fingerprint") else F.col(c) for c in found.columns if c != "key"]
    return found.join(near, "key", "left").select(*spelled, F.coalesce("component_id", "doc_id").alias("component_id"))


# ---- near-duplicate pairs ------------------------------------------------------------------------------------------


def band_hashes(sig: np.ndarray) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(bytes([i]) + sig[i * BAND : (i + 1) * BAND].tobytes(), digest_size=8).digest(), "big", signed=True) for i in range(SLOTS // BAND)]


def _once(texts: DataFrame) -> DataFrame:
    """Texts packed for the shuffle; a task passes a node on once, so that repeated rows cost a row for each task."""
    schema = T._parse_datatype_string("node bigint, cluster bigint, blocks int, bands array<bigint>, packed binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pack = set(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            fresh = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            some = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c).cast(arrow.field(c).type) for c in range(4)), pa.array([pack(t.encode()) for t in some.column(4).to_pylist()], pa.binary())], schema=arrow)

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, schema)


def _links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """A forest of the links between two blocks of a cluster: pairs that share a band and are alike enough."""
    pdf = pdf.drop_duplicates(["node", "side"]).sort_values("node", kind="stable")
    nodes, sides = pdf["node"].to_numpy(), pdf["side"].to_numpy()
    unpack = zstandard.ZstdDecompressor().decompress
    sets = [np.unique(shingle_hashes(unpack(x).decode(), SHINGLE, SEED)) for x in pdf["packed"]]
    sizes = np.array([len(x) for x in sets])
    by_band: dict[int, list[int]] = {}
    parent = np.arange(len(nodes))
    one = len(set(sides.tolist())) == 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    out = []
    for i, bands in enumerate(pdf["bands"]):
        met = [np.array(by_band[b]) for b in bands if b in by_band]
        for b in bands:
            by_band.setdefault(b, []).append(i)
        if not met:
            continue
        # earlier classes by the number of bands shared, the likeliest links first
        others, shared = np.unique(np.concatenate(met), return_counts=True)
        ok = (np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i])) & (one | (sides[others] != sides[i]))
        others = others[ok][np.argsort(-shared[ok], kind="stable")]
        while len(others):
            part, others = others[:AT_ONCE], others[AT_ONCE:]
            flat = np.concatenate([sets[j] for j in part])
            cuts = np.cumsum(sizes[part]) - sizes[part]
            if sizes[i]:
                hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
                both = np.add.reduceat(hit, cuts) if len(flat) else np.zeros(len(part), int)
                score = both / (sizes[part] + sizes[i] - both)
            else:
                score = np.ones(len(part))
            for j in part[score >= threshold].tolist():
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(nodes[i]), int(nodes[j])))
            mine = root(i)
            others = np.array([j for j in others.tolist() if root(j) != mine], np.int64)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, component_id) of the classes that hold several rows or have links; component_id is the smallest id of the linked classes.

    A class holds the documents of one shingle set. Only classes that share a band with another are read again.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(c: list[list]) -> list[list]:
        hashes = [np.unique(shingle_hashes(t, SHINGLE, SEED)) for t in c[2]]
        return [c[0], c[1], [class_key(h) for h in hashes], [len(h) for h in hashes], [band_hashes(signature(h)) for h in hashes]]

    rows = per_batch(plain.select("doc_id", F.xxhash64("text"), "text"), run, "doc_id bigint, mark bigint, key binary, size bigint, bands array<bigint>")
    rep = F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    # written once, so that a node's number is its own for good
    classes = scratch.write(rows.groupBy("key").agg(F.min(rep).alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    # of each band that several classes share, its members beside the first of them
    over = Window.partitionBy("band")
    met = classes.select("node", F.explode("bands").alias("band")).select("node", F.min("node").over(over).alias("first"), F.count(F.lit(1)).over(over).alias("n")).where("n > 1").select("node", "first").distinct()
    stars = scratch.write(met)
    clusters = scratch.write(connected_components(stars.select(F.col("first").alias("a"), F.col("node").alias("b")), scratch).withColumnRenamed("component", "cluster"))
    members = clusters.join(classes, "node").select("node", "cluster", "rep", "size", "bands")
    totals = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / SET_BYTES)).cast("int").alias("blocks"))
    wanted = members.join(totals, "cluster").select("node", "cluster", "blocks", "bands", "rep.*")
    found = plain.select(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("mark"), "text").join(wanted, ["late", "id", "mark"])
    texts = _once(found.select("node", "cluster", "blocks", "bands", "text"))
    dealt = (
        texts.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "node", "bands", "packed")
    )
    links = scratch.write(dealt.groupBy("cluster", "i", "j").applyInPandas(lambda pdf: _links(pdf, threshold), "a bigint, b bigint"))
    parts = connected_components(links, scratch)
    marked = classes.select("node", "key", "copies", "rep").join(parts, "node", "left").where("component IS NOT NULL OR copies > 1").select("key", F.coalesce("component", "node").alias("component"), "rep")
    least = marked.groupBy("component").agg(F.min("rep").alias("rep"))
    return scratch.only(scratch.write(marked.select("key", "component").join(least, "component").select("key", F.when(~F.col("rep.late"), F.col("rep.id")).alias("component_id"))))
