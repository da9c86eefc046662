"""Removal of passages that an earlier document has, byte by byte.

A byte goes if it lies in a string of SPAN bytes that also starts in a document with a smaller id. Equal strings are found
by sorting sampled suffixes. The sample is a cover by content: of the GRAM-byte grams that start in a SPAN-byte string, the one with
the least hash (the leftmost of equals) is sampled, so two equal strings have a sample at the same place. A cover by position
(two of every three suffixes, say) has that property only for pairs of places, and keeps ten times as many suffixes.

1. Every partition of the documents sends the hashes of its sampled grams; those that only one document has are dropped.
2. The remaining samples are sent with the bytes around them. A sample and its sides are named by sorting: the grams first,
   then each further byte to the left, and to the right, as the pair of a name and a byte, one level after another.
   A string that holds the sample is a pair of names, left side and right side. The pairs are sorted, equal ones are
   adjacent, and the least id of each run of equals tells which strings are repeats. Names are exact; hashes only sample.
3. The strings' starts go back to the documents, which drop the bytes covered.

Documents are never shuffled: what goes back to them is dealt by the number of their partition and zipped to it. A string that
occurs many times in a partition is sent once, with the least id; the others are repeats at once. So a hot passage
costs a task one row for each partition.

A null text counts as empty. Rows that share an id don't remove from each other; a row with a null id keeps all its
bytes and removes none. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back

#: Bytes of a string, of a gram, and the starts of grams in a string. A window of 31 is the minimum over two of 16.
SPAN, GRAM = 50, 20
STARTS = SPAN - GRAM + 1
SIDE = SPAN - GRAM
#: Bytes of documents handled together, and bits of a place among them.
CHUNK, PLACE_BITS = 1 << 19, 22
#: Bytes of text, about, whose samples a task holds at a time.
STRETCH = 1 << 23
#: Bytes of text whose samples meet in one task.
SHARD_BYTES = 1 << 24
BASE = 0x100000001B3 * 2 + 1
LOW = (1 << 40) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each gram of the bytes, by its content alone."""
    n = len(data)
    if n < GRAM:
        return np.empty(0, np.uint64)
    size = max(CHUNK, 1 << (n - 1).bit_length())
    if size not in _kept:
        _kept.clear()
        _kept[size] = _powers(size)
    up, down = _kept[size]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def samples(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the sampled grams of documents that lie one after the other in ``data``."""
    h = gram_hashes(data)
    n = len(data) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    blocks = []
    # a text longer than the place bits hold is searched in stretches that overlap by a window
    for at in range(0, n, 1 << (PLACE_BITS - 1)):
        part = h[at : at + (1 << (PLACE_BITS - 1)) + STARTS - 1]
        key = (part >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(part), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: -(STARTS - 16)], key[STARTS - 16 :])
        blocks.append((key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
    least = np.concatenate(blocks)[:n]
    edge = np.zeros(len(data) + 1, np.int32)
    whole = sizes >= SPAN
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, (starts + sizes - SPAN + 1)[whole], -1)
    chosen = np.zeros(len(data), bool)
    chosen[least[np.cumsum(edge)[:n] > 0]] = True
    places = np.flatnonzero(chosen)
    return places, h[places]


def _chunks(docs: Iterable[tuple[int | None, str | None]]) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first document, ids, bytes, starts, sizes) of documents handled together."""
    first, ids, parts, total = 0, [], [], 0
    for i, t in docs:
        ids.append(i)
        parts.append((t or "").encode())
        total += len(parts[-1])
        if total >= CHUNK // 2:
            yield (first, ids, *_joined(parts))
            first, ids, parts, total = first + len(ids), [], [], 0
    if ids:
        yield (first, ids, *_joined(parts))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each by planes of its items' bytes."""
    planes = [np.ascontiguousarray(a.reshape(len(a), -1).view(np.uint8).reshape(len(a), -1).T if a.ndim == 1 else a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpack(blob: bytes, n: int, *types) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for t in types:
        if isinstance(t, int):
            out.append(np.frombuffer(raw, np.uint8, n * t, at).reshape(n, t))
            at += n * t
        else:
            size = np.dtype(t).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
            at += n * size
    return out


def _sampled(docs: Iterable[tuple[int | None, str | None]]) -> Iterator[tuple]:
    """For each chunk: (first, ids, data, starts, sizes, places, hashes, documents of the places)."""
    for first, ids, data, starts, sizes in _chunks(docs):
        known = np.array([i is not None for i in ids])
        places, hashes = samples(data, starts, np.where(known, sizes, 0))
        yield first, ids, data, starts, sizes, places, hashes, np.searchsorted(starts, places, side="right") - 1


def _stretches(docs: Iterable[tuple[int | None, str | None]]) -> Iterator[list[tuple]]:
    """The sampled chunks of a partition, STRETCH bytes at a time: the same ones each time that it is read."""
    held, size = [], 0
    for chunk in _sampled(docs):
        held.append(chunk)
        size += len(chunk[2])
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _gathered(chunks: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, whether documents of several ids have them) of a partition's sampled chunks."""
    hashes, owners = [], []
    for _, ids, _, _, _, _, h, doc in chunks:
        if len(h):
            hashes.append(h)
            owners.append(np.array([i or 0 for i in ids], np.int64)[doc])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h, own = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """The order of ``h`` by shard, and the cuts between shards."""
    shard = ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1)).tolist()


def _names(old: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Names of pairs of a name and a further symbol, by sorting them."""
    return np.unique(old.astype(np.int64) * 512 + more, return_inverse=True)[1].astype(np.int32)


def repeated_starts(around: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each sample a mask: bit x is set if the string that starts x bytes before it is one of a smaller id.

    ``around`` holds SIDE bytes, the gram, and SIDE bytes; ``left`` and ``right`` say how many of the sides are the document's.
    """
    n = len(ids)
    gram = np.unique(np.ascontiguousarray(around[:, SIDE : SIDE + GRAM]).view(f"V{GRAM}").ravel(), return_inverse=True)[1].astype(np.int32)
    before, after = [gram], [gram]
    for x in range(SIDE):
        # beyond the document's bytes stands a symbol of its own
        before.append(_names(before[-1], np.where(x < left, around[:, SIDE - 1 - x], 256).astype(np.int64)))
        after.append(_names(after[-1], np.where(x < right, around[:, SIDE + GRAM + x], 256).astype(np.int64)))
    masks = np.zeros(n, np.uint32)
    for x in range(SIDE + 1):
        fits = np.flatnonzero((x <= left) & (SIDE - x <= right))
        if len(fits) < 2:
            continue
        pair = before[x][fits].astype(np.int64) * (n + 1) + after[SIDE - x][fits]
        order = np.argsort(pair, kind="stable")
        run = pair[order]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        least = np.repeat(np.minimum.reduceat(ids[fits][order], first), np.diff(np.r_[first, len(run)]))
        masks[fits[order]] |= np.where(ids[fits][order] > least, np.uint32(1 << x), np.uint32(0))
    return masks


def _samples_of(index: int, chunks: list[tuple], flags: list[tuple[int, bytes]], shards: int) -> Iterator:
    """What a stretch sends: its samples that other documents may have, to their shards; repeats within it, to be passed on."""
    h, _ = _gathered(chunks)
    order, cuts = _by_shard(h, shards)
    keep = np.zeros(len(h), bool)
    for q, raw in flags:
        pick = order[cuts[q] : cuts[q + 1]]
        keep[pick] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(pick)).astype(bool)
    shared = h[keep]
    parts = []
    for first, ids, data, starts, sizes, places, hashes, doc in chunks:
        some = _among(hashes, shared)
        places, doc, hashes = places[some], doc[some], hashes[some]
        if not len(places):
            continue
        left = np.minimum(SIDE, places - starts[doc])
        right = np.minimum(SIDE, starts[doc] + sizes[doc] - places - GRAM)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * SIDE + GRAM)[places]
        at = np.arange(2 * SIDE + GRAM)
        around[(at < SIDE - left[:, None]) | (at >= SIDE + GRAM + right[:, None])] = 0
        row = np.concatenate([around, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
        parts.append((row, np.array([i or 0 for i in ids], np.int64)[doc], (first + doc).astype(np.uint32), (places - starts[doc]).astype(np.uint32), hashes))
    chunks.clear()
    if not parts:
        return
    row, ids, doc, place, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # of equal surroundings the least id is sent; the others are repeats of it
    _, group = np.unique(np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel(), return_inverse=True)
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    repeat = ids > least[group]
    if repeat.any():
        left, right = row[repeat, -2].astype(int), row[repeat, -1].astype(int)
        masks = np.zeros(int(repeat.sum()), np.uint32)
        for x in range(SIDE + 1):
            masks |= np.where((x <= left) & (SIDE - x <= right), np.uint32(1 << x), np.uint32(0))
        yield index % shards, (index, None, len(masks), _pack(doc[repeat], place[repeat], masks))
    once = np.flatnonzero(~repeat)
    order, cuts = _by_shard(hashes[once], shards)
    for q in range(shards):
        pick = once[order[cuts[q] : cuts[q + 1]]]
        if len(pick):
            # like next to like, for the compressor
            pick = pick[np.argsort(hashes[pick], kind="stable")]
            yield q, (index, 1, len(pick), _pack(row[pick], ids[pick], doc[pick], place[pick]))


def _whole(it: Iterable) -> Iterator[list]:
    held = [list(it)]
    yield held.pop()
    give_back()


def _zipped(docs: RDD, back: RDD) -> RDD:
    """One (documents, what went back to them) for each partition of the documents."""
    mine = docs.mapPartitions(_whole)
    if extra := back.getNumPartitions() - docs.getNumPartitions():
        mine = mine.union(docs.context.parallelize([], extra).mapPartitions(_whole))
    return mine.zip(back.mapPartitions(lambda it: [[v for _, v in it]]))


def _itself(key: int) -> int:
    return key


def remove_repeats(table: DataFrame, doc_id: str = "doc_id", text: str = "text", kept_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row and, if asked for, the kept bytes."""
    spark = table.sparkSession
    docs = table.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).rdd.map(tuple)
    own = docs.getNumPartitions()
    size = table.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), own)

    def send_hashes(part: int, it: Iterable) -> Iterator:
        for nth, chunks in enumerate(_stretches(it)):
            h, several = _gathered(chunks)
            chunks.clear()
            order, cuts = _by_shard(h, shards)
            for q in range(shards):
                if pick := order[cuts[q] : cuts[q + 1]].tolist():
                    low = (h[pick] & np.uint64(LOW)).view(np.uint8).reshape(-1, 8)[:, :5]
                    yield q, (part, nth, len(pick), zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(low.T).tobytes() + np.packbits(several[pick]).tobytes()))
        give_back()

    def shared_hashes(q: int, it: Iterable) -> Iterator:
        got = []
        for _, (part, nth, n, blob) in it:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
            low = np.zeros((n, 8), np.uint8)
            low[:, :5] = raw[: 5 * n].reshape(5, n).T
            got.append(((part, nth), low.view(np.uint64).ravel(), np.unpackbits(raw[5 * n :], count=n).astype(bool)))
        if not got:
            return
        every = np.sort(np.concatenate([h for _, h, _ in got]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        flagged = np.unique(np.concatenate([h[s] for _, h, s in got]))
        keep = np.union1d(twice, flagged)
        for (part, nth), h, _ in got:
            yield part, (nth, q, np.packbits(_among(h, keep)).tobytes())
        del got, every, twice, flagged, keep
        give_back()

    def send_samples(index: int, it: Iterable) -> Iterator:
        for mine, flags in it:
            bits: dict[int, list] = {}
            for nth, q, raw in flags:
                bits.setdefault(nth, []).append((q, raw))
            for nth, chunks in enumerate(_stretches(mine)):
                yield from _samples_of(index, chunks, bits.pop(nth, []), shards)
            mine.clear()
        give_back()

    def find(it: Iterable) -> Iterator:
        got = []
        for _, (part, kind, n, blob) in it:
            if kind is None:
                yield part, (n, blob)
            else:
                got.append((part, *_unpack(blob, n, 2 * SIDE + GRAM + 2, np.int64, np.uint32, np.uint32)))
        if not got:
            return
        row, ids = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        masks = repeated_starts(row[:, :-2], row[:, -2].astype(np.int64), row[:, -1].astype(np.int64), ids)
        at = 0
        for part, _, own_ids, doc, place in got:
            m = masks[at : at + len(own_ids)]
            at += len(own_ids)
            if some := np.flatnonzero(m).tolist():
                yield part, (len(some), _pack(doc[some], place[some], m[some]))
        del got, row, ids, masks
        give_back()

    def drop(it: Iterable) -> Iterator:
        for mine, blobs in it:
            found = [_unpack(blob, n, np.uint32, np.uint32, np.uint32) for n, blob in blobs]
            doc, place, masks = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint32),) * 3
            order = np.argsort(doc, kind="stable")
            doc, place, masks = doc[order].astype(np.int64), place[order].astype(np.int64), masks[order]
            for first, ids, data, starts, sizes in _chunks(mine):
                lo, hi = np.searchsorted(doc, [first, first + len(ids)])
                at, m = starts[doc[lo:hi] - first] + place[lo:hi], masks[lo:hi]
                begins = np.zeros(len(data) + SPAN, np.int32)
                for x in range(SIDE + 1):
                    begins[at[(m >> np.uint32(x)) & np.uint32(1) == 1] - x] = 1
                seen = np.cumsum(begins)
                covered = seen[: len(data)] - np.concatenate([np.zeros(SPAN, seen.dtype), seen])[: len(data)] > 0
                for i, a, n in zip(ids, starts.tolist(), sizes.tolist(), strict=True):
                    gone = covered[a : a + n]
                    kept = data[a : a + n][~gone].tobytes()
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n and gone[0])
                    yield (i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([bytearray(kept)] if kept_text else []))
            mine.clear()
        give_back()

    flags = docs.mapPartitionsWithIndex(send_hashes).partitionBy(shards, _itself).mapPartitionsWithIndex(shared_hashes).partitionBy(own, _itself)
    starts = _zipped(docs, flags).mapPartitionsWithIndex(send_samples).partitionBy(shards, _itself).mapPartitions(find).partitionBy(own, _itself)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if kept_text else "")
    return spark.createDataFrame(_zipped(docs, starts).mapPartitions(drop), schema, verifySchema=False)
