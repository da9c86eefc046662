"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are collapsed, then dealt by hash into shards. A task builds the graph of its shard, audits it, and streams
every vector of the table past it: each query enters at the top level, and its beam is widened while it is full of links.
Cosines are verified in double precision; links join into components, from a spanning forest of each task's links.

The audit compares a shard's answers with brute force, for some of its own vectors and for some of the whole table's, and widens the
search beam until RECALL of their links are found. A vector's match with itself is no link. Own vectors are drawn until
LINKS true links are at hand, or all are drawn. The figures of all shards are returned.

A task holds one shard and a batch of queries at a time; shards hold about SHARD_ROWS vectors whatever the table's
size, and no fewer than SHARDS are made. A group of equal vectors is one node, of any size.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows with a null id;
vectors of different length never link. Rows that share an id count as vectors of their own. A cosine of exactly the
threshold (a tie) is a link. An empty table gives no rows. Only the id and the vector are read: other columns clash with
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, connected_components

THRESHOLD = 0.9
#: Neighbours of a node above and on the ground level, later nodes it leads to for good, beam while building, first beam of the search.
DEGREE, GROUND, CHILDREN, BUILD_BEAM, BEAM = 12, 24, 6, 32, 24
SHARD_ROWS, SHARDS = 100_000, 6
#: Vectors drawn at a time for an audit, vectors of the whole table that every shard is asked, true links that an audit needs, and the share of them that must be found.
AUDITED, FOREIGN, LINKS, RECALL = 200, 200, 200, 0.97
#: Queries and insertions at a time, and nodes that a beam expands at a time.
BATCH, STEP = 256, 3


class Graph:
    """A navigable small-world graph of unit vectors, by cosine."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        n = len(vectors)
        rng = np.random.default_rng(n)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int), 8)
        self.order = np.argsort(-self.level, kind="stable")
        self.links = [np.full((n, GROUND + CHILDREN if level == 0 else DEGREE), -1, np.int32) for level in range(int(self.level.max(initial=0)) + 1)]
        self.room = np.full(n, CHILDREN)
        self.beam = BEAM
        self._build()

    def _build(self) -> None:
        """Inserts nodes from the highest level down, in batches that at most double the graph."""
        n, at = len(self.x), min(1, len(self.x))
        self.entry = int(self.order[0]) if n else -1
        while at < n:
            top = self.level[self.order[at]]
            to = min(n, at + min(BATCH, max(1, at)))
            to = at + int(np.searchsorted(-self.level[self.order[at:to]], -top, side="right"))
            new = self.order[at:to]
            at = to
            start = np.full(len(new), self.entry)
            for level in range(len(self.links) - 1, -1, -1):
                if level > top:
                    start = self._search(self.x[new], level, start[:, None], 1)[0][:, 0]
                    continue
                found, near = self._search(self.x[new], level, start.reshape(len(new), -1), BUILD_BEAM)
                among = self.x[new] @ self.x[new].T
                np.fill_diagonal(among, -np.inf)
                k = min(BUILD_BEAM // 2, len(new))
                best = np.argpartition(-among, k - 1, axis=1)[:, :k]
                ids = np.concatenate([found, np.where(np.isfinite(np.take_along_axis(among, best, 1)), new[best], -1)], axis=1)
                sims = np.concatenate([near, np.take_along_axis(among, best, 1)], axis=1)
                chosen = self._choose(ids, sims, DEGREE)
                self._connect(level, new, chosen)
                start = np.where(found[:, :4] < 0, found[:, :1], found[:, :4])

                if level == 0:
                    self._adopt(new, ids, sims)

    def _adopt(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """A lasting link to each new node from the nearest earlier one that has room: no node is beyond reach of the entry, and a group of near copies hangs together."""
        batch = {int(u): i for i, u in enumerate(new)}
        ranked = np.take_along_axis(ids, np.argsort(-np.where(ids < 0, -np.inf, sims), axis=1, kind="stable"), 1)
        for i, row in enumerate(ranked.tolist()):
            old = [v for v in row if v >= 0 and batch.get(v, -1) < i]
            v = next((v for v in old if self.room[v]), old[0])
            if not self.room[v]:
                self.room += CHILDREN
                self.links[0] = np.concatenate([self.links[0], np.full((len(self.x), CHILDREN), -1, np.int32)], axis=1)
            self.links[0][v, self.links[0].shape[1] - self.room[v]] = new[i]
            self.room[v] -= 1

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, the nearest that are nearer to the node than to one already chosen; then the nearest of the rest."""
        sims = np.where(ids < 0, -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[ids]
        between = np.einsum("bid,bjd->bij", v, v)
        rows, width = ids.shape
        kept = np.zeros((rows, width), bool)
        cover = np.full((rows, width), -np.inf)
        for j in range(width):
            ok = (ids[:, j] >= 0) & (cover[:, j] < sims[:, j]) & (kept.sum(axis=1) < most)
            kept[:, j] = ok
            cover = np.where(ok[:, None], np.maximum(cover, between[:, j]), cover)
        rank = np.where(kept, 0, 1) * 10 + np.arange(width) / width + 100 * (ids < 0)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, pick, 1)
        # half of a full list is left to diversity alone; near copies would fill it with each other
        out[(~np.take_along_axis(kept, pick, 1)) & (np.arange(out.shape[1]) >= most // 2)] = -1
        return out

    def _connect(self, level: int, new: np.ndarray, chosen: np.ndarray) -> None:
        table = self.links[level]
        table[new, : chosen.shape[1]] = chosen
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        if not len(b):
            return
        sims = np.einsum("ed,ed->e", self.x[a], self.x[b])
        order = np.lexsort((-sims, b))
        a, b = a[order], b[order]
        targets, first, counts = np.unique(b, return_index=True, return_counts=True)
        place = np.arange(len(b)) - np.repeat(first, counts)
        width = GROUND if level == 0 else DEGREE
        some = place < width
        incoming = np.full((len(targets), width), -1, np.int32)
        incoming[np.repeat(np.arange(len(targets)), counts)[some], place[some]] = a[some]
        for at in range(0, len(targets), BATCH):
            t = targets[at : at + BATCH]
            ids = np.concatenate([table[t, :width], incoming[at : at + BATCH]], axis=1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == t[:, None]] = -1
            picked = self._choose(ids, np.einsum("bd,bcd->bc", self.x[t], self.x[ids]), width)
            table[t, :width] = -1
            table[t, : picked.shape[1]] = picked

    def _search(self, q: np.ndarray, level: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of each query's beam, best first, padded with -1 and -inf."""
        rows, n, table = len(q), len(self.x), self.links[level]
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        ids, sims = np.full((rows, beam), -1, np.int64), np.full((rows, beam), -np.inf)
        open_ = np.zeros((rows, beam), bool)

        def offer(who: np.ndarray, cand: np.ndarray) -> None:
            cand = np.where(cand < 0, n, cand)
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
            cand = np.where(seen[who[:, None], cand], n, cand)
            seen[who[:, None], cand] = True
            # only columns that some row needs
            cand = np.sort(cand, axis=1)
            cand = cand[:, : max(1, int((cand < n).sum(axis=1).max(initial=0)))]
            near = np.where(cand < n, np.einsum("bd,bcd->bc", q[who], self.x[np.minimum(cand, n - 1)]), -np.inf)
            every = np.concatenate([sims[who], near], axis=1)
            top = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            ids[who] = np.take_along_axis(np.concatenate([ids[who], np.where(cand < n, cand, -1)], axis=1), top, 1)
            open_[who] = np.take_along_axis(np.concatenate([open_[who], cand < n], axis=1), top, 1)
            sims[who] = np.take_along_axis(every, top, 1)

        offer(np.arange(rows), start)
        while len(who := np.flatnonzero(open_.any(axis=1))):
            first = np.argsort(~open_[who], axis=1, kind="stable")[:, : min(STEP, beam)]
            live = np.take_along_axis(open_[who], first, 1)
            cur = np.where(live, np.take_along_axis(ids[who], first, 1), -1)
            open_[who[:, None], first] = False
            offer(who, np.where(cur[:, :, None] < 0, -1, table[cur]).reshape(len(who), -1))
        return ids, sims

    def near(self, q: np.ndarray, threshold: float, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the links found; a query whose beam ends full of links is asked again with twice the beam."""
        if not len(self.x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.full((len(q), 1), self.entry)
        for level in range(len(self.links) - 1, 0, -1):
            start = self._search(q, level, start, 2)[0]
        out, who, beam = [], np.arange(len(q)), beam or self.beam
        while len(who):
            ids, sims = self._search(q[who], 0, start, beam)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= threshold - 1e-9) if beam < len(self.x) else np.zeros(len(who), bool)
            i, j = np.nonzero((sims >= threshold - 1e-9) & ~full[:, None] & (ids >= 0))
            out.append((who[i], ids[i, j]))
            who, start, beam = who[full], ids[full], 2 * beam
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def audit(self, nodes: np.ndarray, foreign: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[int, int]:
        """Widens the beam until the audited vectors' links are found: (links by brute force, links found)."""
        n = len(self.x)

        def linked(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
            """The number of true links of each vector."""
            counts = [((q[at : at + BATCH] @ self.x.T >= threshold) & (ids[at : at + BATCH, None] != nodes)).sum(axis=1) for at in range(0, len(q), BATCH)]
            return np.concatenate(counts) if counts else np.empty(0, int)

        own = np.random.default_rng(n).permutation(n)
        drawn, want, asked = 0, 0, []
        some = foreign
        while True:
            counts = linked(*some)
            want += int(counts.sum())
            # a vector without a link has none to be missed
            asked.append((some[0][counts > 0], some[1][counts > 0]))
            if drawn >= n or (drawn and want >= LINKS):
                break
            part = own[drawn : drawn + AUDITED]
            drawn += len(part)
            some = (nodes[part], self.x[part])
        ids, q = np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked])
        while True:
            found = 0
            for at in range(0, len(q), BATCH):
                i, j = self.near(q[at : at + BATCH], threshold)
                sure = (ids[at : at + BATCH][i] != nodes[j]) & (np.einsum("ed,ed->e", q[at : at + BATCH][i], self.x[j]) >= threshold)
                found += int(sure.sum())
            # a beam as wide as the shard is brute force itself
            if found >= RECALL * want or self.beam >= n:
                return want, found
            self.beam *= 2


class _Forest:
    """Tells which links of a task connect what was not connected before."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def new(self, a: list[int], b: list[int]) -> list[bool]:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = self.root(x), self.root(y)
            self.parent[max(x, y)] = min(x, y)
            out.append(x != y)
        return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that tiny and huge vectors keep their direction."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, joins, want, found) of the linked nodes of ``distinct`` (node: long, v: array<double>, valid and without repeats), both ways.

    Links whose ``joins`` is true connect what all links connect. Rows without a node hold a shard's audit. A link
    that two shards' tasks find from both ends comes twice.
    """
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("joins", pa.bool_()), ("want", pa.int64()), ("found", pa.int64())])
    sizes = distinct.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    spark = distinct.sparkSession
    schema = "a long, b long, joins boolean, want long, found long"
    shards = {r.d: max(SHARDS, -(-r.n // SHARD_ROWS)) for r in sizes}
    if not shards:
        return spark.createDataFrame([], schema)
    # shards of each length of vector are numbered on from those of the lengths before
    first, total = {}, 0
    for d in sorted(shards):
        first[d], total = total, total + shards[d]
    table = F.broadcast(spark.createDataFrame([(d, first[d], shards[d]) for d in sorted(shards)], "d int, first int, shards int"))
    rows = distinct.withColumn("d", F.size("v")).join(table, "d")
    members = rows.select((F.col("first") + F.pmod(F.xxhash64("node"), F.col("shards"))).cast("int").alias("shard"), F.lit(0).alias("role"), "node", "v")
    every = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard")
    asked = rows.select(every, F.lit(2).alias("role"), "node", "v")
    # FOREIGN vectors of each length, about: the nodes are hashes already
    share = {r.d: min(1.0, FOREIGN / r.n) for r in sizes}
    shares = F.broadcast(spark.createDataFrame([(d, int(share[d] * 1_000_000)) for d in sorted(share)], "d int, share int"))
    audits = rows.join(shares, "d").where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1_000_000)) < F.col("share")).select(every, F.lit(1).alias("role"), "node", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph, nodes, parts, audits, forest = None, None, None, [], [], None
        for batch in batches:
            keys, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(roles) != 0)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if keys[lo] != shard:
                    shard, graph, nodes, parts, audits, forest = int(keys[lo]), None, None, [], [], _Forest()
                part = batch.slice(lo, hi - lo)
                own = (part.column(2).to_numpy(), _matrix(part.column(3)))
                if roles[lo] < 2:
                    (parts, audits)[roles[lo]].append(own)
                    continue
                if not parts and graph is None:
                    continue  # a shard without members
                if graph is None:
                    nodes, raw = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    graph, parts = Graph(_unit(raw)), []
                    foreign = (np.concatenate([p[0] for p in audits]), _unit(np.concatenate([p[1] for p in audits]))) if audits else (nodes[:0], graph.x[:0])
                    want, got = graph.audit(nodes, foreign, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, want, got), arrow, strict=True)], schema=arrow)
                asked_nodes, queries = own[0], _unit(own[1])
                for at in range(0, len(queries), BATCH):
                    i, j = graph.near(queries[at : at + BATCH], threshold)
                    a, b = asked_nodes[at : at + BATCH][i], nodes[j]
                    sure = (a != b) & (np.einsum("ed,ed->e", queries[at : at + BATCH][i], graph.x[j]) >= threshold)
                    a, b = a[sure], b[sure]
                    joins, n = np.array(forest.new(a.tolist(), b.tolist()), bool), 2 * len(a)
                    none = pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([joins, np.zeros(len(a), bool)])), none, none], schema=arrow)

    return members.unionByName(audits).unionByName(asked).repartitionById(total, F.col("shard")).sortWithinPartitions("shard", "role").mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, and the share of the audited links that the graphs found."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    plain = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.col("vec_id").isNotNull() & F.coalesce(plain, F.lit(False))
    # 0.0 and -0.0 are one number, so that equal vectors are one group; 128 bits of hash stand for a vector, so that no join moves one
    good = rows.where(valid).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    groups = scratch.write(good.groupBy("h", "g").agg(F.any_value("v").alias("v"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    every = scratch.write(links(groups.select("node", "v"), threshold))
    found = every.where("a IS NOT NULL")
    audit = every.agg(F.sum("want").alias("want"), F.sum("found").alias("found")).first()
    recall = audit["found"] / audit["want"] if audit["want"] else 1.0
    linked = found.select("a", "b").distinct().join(groups.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    parts = connected_components(found.where("joins").select("a", "b"), scratch)
    marked = groups.select("node", "h", "g", "least", "copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = marked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_vector = scratch.write(marked.join(least, "component").join(linked, "node", "left").select("h", "g", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    done = good.select("vec_id", "h", "g").join(by_vector, ["h", "g"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("audit_recall", F.lit(float(recall)))
