"""Byte-level BPE encoding and decoding with a pair occurrence index.

For all words of a batch that were not met before, every adjacent pair of symbols with a rank is listed at all
its positions. Active ranks are applied in ascending order; each merge updates the lists of the pairs beside it.
The vocabulary is read once on the driver and broadcast: its size is fixed by the tokenizer's file.

Nulls count as the empty text, which has no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import per_text

#: Words kept encoded between batches; the cache starts anew when it holds more.
CACHE_WORDS = 400_000
#: A batch with a longer word than this starts the cache anew, which bounds its bytes.
CACHE_LENGTH = 10_000
#: Larger than any id: a pair of ids is one key. Symbols between words, and of positions that were merged away.
KEY, END, GONE = 1 << 20, -1, -2

# fixed value: the published pre-tokenisation pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as one printable letter: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids and merge ranks of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], _byte_letters()
        to_byte = {c: b for b, c in letters.items()}
        self.ids: dict[str, int] = model["vocab"]
        self.byte_ids = [self.ids[letters[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for line in model["merges"]:
            a, b = line.split(" ") if isinstance(line, str) else line
            self.rank.setdefault((self.ids[a], self.ids[b]), len(self.made))
            self.made.append(self.ids[a + b])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in self.ids.items() if all(c in to_byte for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class Encoder:
    """Encodes texts batch by batch; keeps the words it has met, up to CACHE_WORDS."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.forget()
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        keys = np.array([a * KEY + b for a, b in vocabulary.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], np.array(list(vocabulary.rank.values()), np.int64)[order]
        self.merges = {r: (a, b, vocabulary.made[r]) for (a, b), r in vocabulary.rank.items()}
        #: One object for each id, however many words hold it.
        self.shared = list(range(1 + max(vocabulary.ids.values(), default=0)))

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if self.special is None or not any(s in text for s in self.v.special):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.words.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.words.findall(text[at:])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        keys = left * KEY + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.rank_of_key[at], -1)

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word, by one pair occurrence index over all of them."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1 if len(coded) else 0
        # words are set apart by END, a symbol of no pair; one more stands before the first
        symbols = np.append(self.byte_ids[np.frombuffer(b"\0".join([*coded, b""]), np.uint8)], END)
        symbols[ends] = END
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        before[0] = n
        index: dict[int, list[np.ndarray]] = {}

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks >= 0
            places, ranks = places[some], ranks[some]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            heads = ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else []
            for r, part in zip(heads, np.split(places, cuts), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        active: list[int] = []
        enter(np.arange(n), self._ranks(symbols[:-1], symbols[1:]))
        while active:
            r = heapq.heappop(active)
            left, right, new = self.merges[r]
            places = np.unique(np.concatenate(index.pop(r)))
            places = places[symbols[places] == left]
            places = places[symbols[after[places]] == right]
            if left == right:
                # of overlapping pairs the first is merged
                kept, taken = [], -1
                for i, j in zip(places.tolist(), after[places].tolist(), strict=True):
                    if i != taken:
                        kept.append(i)
                        taken = j
                places = np.array(kept, np.int64)
            if not len(places):
                continue
            gone = after[places]
            symbols[places], symbols[gone] = new, GONE
            beyond = after[gone]
            after[places], before[beyond] = beyond, places
            ahead = before[places]
            enter(np.concatenate([places, ahead]), self._ranks(np.concatenate([symbols[places], symbols[ahead]]), np.concatenate([symbols[beyond], symbols[places]])))
        kept = symbols[:n] >= 0
        ids = list(map(self.shared.__getitem__, symbols[:n][kept].tolist()))
        stops = np.cumsum(kept)[ends].tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text. Between the texts' splitting and their encoding, a word is a number."""
        if len(self.table) > CACHE_WORDS:
            self.forget()
        number, known = self.number, len(self.table)
        numbered = [array("i", [number[w] for w in self.split(t or "")]) for t in texts]
        fresh = list(islice(number, known, None))
        special = self.v.special
        merged = dict(zip(plain := [w for w in fresh if w not in special], self.merge(plain), strict=True))
        self.table += [merged[w] if w in merged else (special[w],) for w in fresh]
        find = self.table.__getitem__
        for words in numbered:
            yield list(chain.from_iterable(map(find, words)))
        if any(len(w) > CACHE_LENGTH for w in fresh):
            self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.table: list[tuple[int, ...]] = []


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def encode_table(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep``, then n_tokens, ids (array, if ``with_ids``), ids_sha256 and decoded_sha256 of every text. No shuffle."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary_path))
    own: dict = {}

    def run(cols: list[list]) -> list[list]:
        encoder = own.get("encoder") or own.setdefault("encoder", Encoder(shared.value))
        spell = own.get("spell") or own.setdefault("spell", {i: str(i) for i in encoder.v.bytes_of})
        rows = [(len(ids), *([array("i", ids)] if with_ids else []), hashlib.sha256(",".join(map(spell.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decode(encoder.v, ids).encode()).hexdigest()) for ids in encoder.encode(cols[-1])]
        return [*cols[:-1], *map(list, zip(*rows, strict=True))]

    more = ["n_tokens bigint", *(["ids array<int>"] if with_ids else []), "ids_sha256 string", "decoded_sha256 string"]
    return per_text(docs, keep, text, run, ", ".join(more), own)
