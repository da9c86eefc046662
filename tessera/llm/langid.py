"""Language of texts by a linear-chain conditional random field over words.

Every word (run of letters, lower case) scores each language by its affixes, character n-grams and an entry of the
lexicon of training words; learned transitions tie neighbouring words, and forward-backward gives each word's posterior.
A text's language is the one with the largest mean posterior, which is its score. ``label_words`` returns the words'
own languages, for code-switched text.

The field is fitted on the driver, on at most PER_LABEL rows of each label (distinct texts, those with the smallest hash,
so that a group of copies counts once) and on their whole texts. The bound is a parameter, so the driver's share does not grow
with the table. Training sequences join runs of documents of different labels, from which the transitions are learned.
Prediction reads whole texts, without a shuffle, in time linear in their length.

Null texts, texts without a letter (numerals are none) and a model without labels give ``und`` with score 0. Ties go to
the label first in order. Rows repeat and ids may be null: each row is predicted by its text alone. An empty table gives
no rows. A kept column that is called ``lang_pred`` or ``score`` comes back with ``_kept`` added.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import least_hashes, per_text

PER_LABEL = 400
UNKNOWN = "und"
#: The documents that the registered query and the pipeline learn from; those without an id are among them.
LEARNS = "coalesce(crc32(cast(doc_id as string)) % 4 <> 2, true)"


def _class(kinds: str) -> str:
    """The characters of some Unicode categories (by first letter), as ranges of a pattern's class."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
    cuts = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1), len(codes)]
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in zip(cuts, cuts[1:], strict=False))


#: A letter, then letters and the marks on them; the same, faster, for texts without a mark or a numeral that is no digit.
WORD = re.compile(f"[{_class('L')}][{_class('LM')}]*")
LETTERS = re.compile(r"[^\W\d_]+")
RARE = re.compile(f"[{_class('M')}]|(?![{_class('L')}])[^\\W\\d_]")
#: Words of a training sequence, sequences, mean words of a run of one label, rounds and penalty of the fit.
LENGTH, SEQUENCES, RUN, ROUNDS, RATE, PENALTY = 60, 900, 15, 60, 0.25, 2e-5
#: Words whose scores a worker keeps, and cells of one forward-backward block.
CACHE_WORDS, CELLS = 400_000, 400_000
#: Words scored at a time.
SCORED = 20_000


def _rare(text: str) -> bool:
    """Whether any of the text's characters beyond ASCII is a mark or a numeral."""
    return RARE.search("".join(set(text))) is not None


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (LETTERS if text.isascii() or not _rare(text) else WORD).findall(text)


def features(word: str) -> list[str]:
    """Affixes, character n-grams and the word itself; the first character tells which (upper case, as words have none)."""
    framed = f"^{word}$"
    out = ["W" + word]
    out += ["P" + word[:k] for k in (1, 2, 3) if len(word) >= k]
    out += ["S" + word[-k:] for k in (1, 2, 3) if len(word) >= k]
    for k in (2, 3):
        out += ["N" + framed[i : i + k] for i in range(len(framed) - k + 1)]
    return out


class Field:
    """A fitted field: labels, a row of weights for each feature, transitions and starts (in log space)."""

    def __init__(self, labels: list[str], rows: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.labels, self.rows, self.weights, self.moves, self.starts = labels, rows, weights, moves, starts

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; features that were not met in training add nothing."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        get = self.rows.get
        for at in range(0, len(words), SCORED):
            found = [[r for f in features(w) if (r := get(f)) is not None] for w in words[at : at + SCORED]]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            some = np.flatnonzero(sizes)
            if len(some):
                flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
                out[at + some] = np.add.reduceat(self.weights[flat], np.cumsum(sizes)[some] - sizes[some], axis=0)
        return out


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, starts: np.ndarray, pairs: bool = False):
    """Forward-backward over padded sequences: scores (B, T, K) to marginals (B, T, K), zero beyond each length.

    With ``pairs``, also the expected transitions (K, K) over all sequences.
    """
    b, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    step, first = np.exp(moves - moves.max()), np.exp(starts - starts.max())
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = first * e[0]
    now /= now.sum(axis=1, keepdims=True)
    alpha[0] = now
    for i in range(1, t):
        now = now @ step
        now *= e[i]
        now /= now.sum(axis=1, keepdims=True)
        alpha[i] = now
    now = np.ones((b, k), e.dtype)
    ends = lengths - 1
    by_end = np.argsort(ends, kind="stable")
    at_end = np.split(by_end, np.searchsorted(ends[by_end], np.arange(1, t)))
    beta[t - 1] = now
    for i in range(t - 2, -1, -1):
        now = (now * e[i + 1]) @ step.T
        now /= now.sum(axis=1, keepdims=True)
        if len(at_end[i]):
            now[at_end[i]] = 1
        beta[i] = now
    m = alpha * beta
    m /= m.sum(axis=2, keepdims=True)
    m *= (np.arange(t)[:, None] < lengths)[:, :, None]
    if not pairs:
        return m.transpose(1, 0, 2)
    joint = np.einsum("tbi,ij,tbj->tbij", alpha[:-1], step, e[1:] * beta[1:])
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    joint *= (np.arange(1, t)[:, None] < lengths)[:, :, None, None]
    return m.transpose(1, 0, 2), joint.sum(axis=(0, 1))


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Field:
    """The field of (label, text) rows; rows without words are left out."""
    docs = [(a, w) for a, t in sorted(rows) if len(w := words_of(t))]
    labels = sorted({a for a, _ in docs})
    k = len(labels)
    if k < 2:
        return Field(labels, {}, np.zeros((0, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    rng = np.random.default_rng(seed)
    by_label = [[w for a, w in docs if a == x] for x in labels]
    seqs, tags = [], []
    for _ in range(SEQUENCES):
        seq: list[str] = []
        tag: list[int] = []
        while len(seq) < LENGTH:
            y = int(rng.integers(k))
            doc = by_label[y][int(rng.integers(len(by_label[y])))]
            n = min(int(rng.geometric(1 / RUN)), LENGTH - len(seq), len(doc))
            at = int(rng.integers(len(doc) - n + 1))
            seq += doc[at : at + n]
            tag += [y] * n
        seqs.append(seq)
        tags.append(tag)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(seqs)))}
    rows_of: dict[str, int] = {}
    flat, sizes = [], []
    for w in vocabulary:
        f = [rows_of.setdefault(x, len(rows_of)) for x in features(w)]
        flat += f
        sizes.append(len(f))
    flat_rows, owner = np.array(flat), np.repeat(np.arange(len(sizes)), sizes)
    starts_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids, gold = np.array([[vocabulary[w] for w in s] for s in seqs]), np.array(tags)
    hot = np.eye(k)[gold]
    lengths = np.full(len(ids), LENGTH)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    params = [np.zeros((len(rows_of), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = ids.size
    for step in range(1, ROUNDS + 1):
        by_word = np.add.reduceat(params[0][flat_rows], starts_at, axis=0)
        marginals, expected = posteriors(by_word[ids], lengths, params[1], params[2], pairs=True)
        off = (marginals - hot).reshape(-1, k)
        g_word = np.stack([np.bincount(ids.ravel(), off[:, j], len(vocabulary)) for j in range(k)], axis=1)
        g_rows = np.stack([np.bincount(flat_rows, g_word[owner, j], len(rows_of)) for j in range(k)], axis=1)
        grads = [g_rows / n + PENALTY * params[0], (expected - gold_moves) / n + PENALTY * params[1], (marginals[:, 0] - hot[:, 0]).sum(axis=0) / n]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Field(labels, rows_of, *(p.astype(np.float32) for p in params))


def train(labelled: DataFrame, text: str = "text", label: str = "lang", per_label: int = PER_LABEL) -> Field:
    """Fits on at most ``per_label`` distinct texts of each non-null label. Texts leave their tasks only if they are chosen."""
    rows = labelled.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").cast("string").alias("t")).where("label IS NOT NULL AND t IS NOT NULL")
    keyed = rows.withColumn("hash", F.xxhash64("t"))
    chosen = least_hashes(keyed.select("label", "hash"), per_label)
    if not chosen:
        return fit([])
    # at most per_label rows for each label
    picked = labelled.sparkSession.createDataFrame([(r.label, r.hash) for r in chosen], "label string, hash long")
    texts = keyed.join(F.broadcast(picked), ["label", "hash"]).groupBy("label", "hash").agg(F.min("t").alias("t"))
    return fit([(r.label, r.t) for r in texts.collect()])


class Labeller:
    """Predicts batches of texts; keeps the scores of the words it has met, up to CACHE_WORDS."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.field.labels)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Scores the words that were not met before."""
        fresh = sorted(words.difference(self.known))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.forget()
            fresh = sorted(words)
        n = len(self.known)
        while len(self.table) < n + len(fresh):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(fresh)] = self.field.scores(fresh)
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def marginals(self, texts: list[str | None]):
        """(place, marginals) of each text that has words."""
        split = [words_of(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        rows = [(i, np.fromiter(map(self.known.__getitem__, w), np.int32, len(w))) for i, w in enumerate(split) if w]
        rows.sort(key=lambda r: len(r[1]))
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and len(rows[to][1]) * (to + 1 - at) <= CELLS:
                to += 1
            part = rows[at:to]
            at = to
            lengths = np.array([len(x) for _, x in part])
            padded = np.zeros((len(part), lengths[-1]), np.int32)
            for j, (_, x) in enumerate(part):
                padded[j, : len(x)] = x
            m = posteriors(self.table[padded], lengths, self.field.moves, self.field.starts)
            for j, (i, x) in enumerate(part):
                yield i, m[j, : len(x)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.field.labels:
            for i, m in self.marginals(texts):
                mean = m.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                labels[i], scores[i] = self.field.labels[best], min(1.0, float(mean[best]))
        return labels, scores


def label_words(field: Field, text: str | None) -> list[tuple[str, str]]:
    """Each word of a text with its own most likely language."""
    for _, m in Labeller(field).marginals([text]) if field.labels else ():
        return [(w, field.labels[j]) for w, j in zip(words_of(text), m.argmax(axis=1), strict=True)]
    return [(w, UNKNOWN) for w in words_of(text)]


def predict_table(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, then lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    own: dict = {}

    def run(cols: list[list]) -> list[list]:
        labeller = own.get("l") or own.setdefault("l", Labeller(shared.value))
        return [*cols[:-1], *labeller.predict(cols[-1])]

    return per_text(docs, keep, text, run, "lang_pred string, score double", own)
