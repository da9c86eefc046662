"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. Nonnegative document rates r are
then fitted by least squares so that each domain's expected tokens, the sum of rate * tokens * posterior, match its
target. With A the domains' expected tokens at rate one, document by document, and G the domains' second moments
(the sum of tokens * posterior * posterior'), the problem is to minimise (A r - t)' G^+ (A r - t) over r >= 0. G is fixed
before the first round. The fit is distributed projected gradient descent from rate one: a round sums each domain's
expected tokens over all documents, and every document steps by its own part of the gradient and is cut off at zero.
Steps are measured
in tokens (long documents do not move further than short ones); in that measure the gradient's Lipschitz constant is one,
so a step of one never raises the objective. The first QUICK rounds whiten the step by the documents that are not cut off,
which meets targets within reach in few rounds. If they are not met, the fit goes on from its best rates: a round
tries several steps in its one pass, the gradient times each of STRETCHES among them, and takes the one that leaves least.

The rounds end when the targets are met, when no step lowers the objective, or after ROUNDS; a fit that
ends short of the targets says so by a warning, and ``Fit.residual`` is what is left. Targets that cannot be met get the nearest sums
of that one problem.

Only the sums of the domains and one multiplier for each domain and round reach the driver: a document's rate is the
fold of the rounds' steps over its posterior. A round is one pass in
vectorised numpy over tokens and posteriors; there is no shuffle but that of the sums. The classifier is a logistic
regression on the words of whole texts, of at most PER_DOMAIN labelled documents of each domain: that bound is a parameter.

Null texts have no tokens and the posterior of an empty text. Without labelled rows there is no domain, and every rate
is one. An empty table gives no rows. Very long texts are read whole, by one pass over their words. Repeated rows have
equal rates and equal copies; a row is copied floor(rate) times and once more with the chance that is left over, drawn
from a hash of its id and text. A kept column that is called like an output column comes back with ``_kept`` added.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, least_hashes, per_text

PER_DOMAIN = 1000
#: Rounds, rate and penalty of the classifier's fit.
FIT_ROUNDS, FIT_RATE, PENALTY = 80, 0.1, 1e-5
#: Training documents that share a word of the vocabulary, at least.
LEAST_ROWS = 20
#: Rounds of the rates' fit at most and quick ones among them, the relative residual at which it ends.
ROUNDS, QUICK, TOLERANCE = 60, 20, 1e-4
#: Multiples of the gradient that a round tries.
STRETCHES = (1.0, 8.0, 64.0, 512.0)
#: Working columns, and those that ``mix`` adds.
DRAW, TEXT = "draw_of_copies", "text_to_mix"
OUTPUTS = {"n_tokens", "posterior", "rate", "copies", "residual"}


def _shape(text: str, distinct: int) -> list[float]:
    """What the known words don't show: length, repetition, capitals and the size of words."""
    words = text.split()
    n = max(1, len(words))
    return [1.0, math.log1p(len(words)) / 10, distinct / n, sum(map(str.isupper, words)) / n, min(20.0, len(text) / n) / 10]


class Classifier:
    """Logistic regression over the words that LEAST_ROWS training documents share, and a text's shape."""

    def __init__(self, rows: list[tuple[str, str]], shares: dict[str, float] | None = None):
        """``shares`` are the domains' weights among the labelled rows (as in ``rows`` if not given), for calibrated posteriors."""
        rows = sorted(rows)
        self.domains = sorted({d for d, _ in rows})
        k = len(self.domains)
        split = [(t, t.lower().split()) for _, t in rows]
        seen: dict[str, int] = {}
        for _, words in split:
            for w in set(words):
                seen[w] = seen.get(w, 0) + 1
        self.ids = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_ROWS))}
        self.weights, self.shape_weights = np.zeros((len(self.ids) + 1, k)), np.zeros((5, k))
        if k < 2:
            return
        flat, starts, dense, scale = self._describe([t for t, _ in split])
        gold = np.eye(k)[[self.domains.index(d) for d, _ in rows]]
        weight = np.array([(shares or {}).get(d, n) for d, n in zip(self.domains, gold.sum(axis=0), strict=True)], float)
        balance = (weight / weight.sum() / gold.sum(axis=0))[gold.argmax(axis=1)][:, None]
        owner = np.repeat(np.arange(len(rows)), np.diff([*starts, len(flat)]))
        params = [self.weights, self.shape_weights]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, FIT_ROUNDS + 1):
            off = (self._posterior(flat, starts, dense, scale) - gold) * balance
            own = (off * scale[:, None])[owner]
            grads = [np.stack([np.bincount(flat, own[:, j], len(self.weights)) for j in range(k)], axis=1) + PENALTY * self.weights, dense.T @ off + PENALTY * self.shape_weights]
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= FIT_RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)

    def _describe(self, texts: list[str]):
        """Known distinct words of each text (in order, so that equal texts add up equally; the last id stands for the text itself), starts, shapes and scales."""
        get, last = self.ids.get, len(self.ids)
        found, dense, self.counts = [], [], []
        for t in texts:
            words = t.lower().split()
            distinct = set(words)
            self.counts.append(len(words))
            found.append([*sorted(i for w in distinct if (i := get(w)) is not None), last])
            dense.append(_shape(t, len(distinct)))
        sizes = np.array([len(f) for f in found])
        starts = np.cumsum(sizes) - sizes
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), starts, np.array(dense).reshape(-1, 5), 1 / np.sqrt(sizes)

    def _posterior(self, flat, starts, dense, scale) -> np.ndarray:
        z = np.add.reduceat(self.weights[flat], starts, axis=0) * scale[:, None] + dense @ self.shape_weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[int], list[list[float]]]:
        """(tokens, posteriors) of each text; tokens are words between white space."""
        if not texts:
            return [], []
        parts = self._describe([t or "" for t in texts])
        counts = self.counts
        return counts, self._posterior(*parts).tolist() if self.domains else [[] for _ in texts]


def train(docs: DataFrame, labelled: DataFrame, domain: Column, per_domain: int = PER_DOMAIN) -> Classifier:
    """Fits on at most ``per_domain`` rows of each domain of ``labelled`` (doc_id, ...), by a hash of the id."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("id"), domain.cast("string").alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    shares = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    chosen = least_hashes(rows.select(F.col("domain").alias("label"), F.xxhash64("id").alias("hash"), "id"), per_domain)
    if not chosen:
        return Classifier([])
    # at most per_domain rows for each domain
    picked = docs.sparkSession.createDataFrame([(r.id, r.label) for r in chosen], "id long, domain string")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").join(F.broadcast(picked), "id")
    # copies of an id would weigh more than others
    return Classifier([(r.domain, r.t) for r in texts.groupBy("id", "domain").agg(F.min("t").alias("t")).collect()], shares)


def posteriors(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, then n_tokens and posterior (array, by the model's domains) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return per_text(docs, keep, text, lambda c: [*c[:-1], *shared.value.predict(c[-1])], "n_tokens bigint, posterior array<double>")


@dataclass
class Fit:
    """The rounds' multipliers, the sums they lead to, and the largest distance of a sum from its target, as a share of all targets."""

    steps: list[np.ndarray]
    sums: np.ndarray
    residual: float


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate of a document: one, less each round's step, cut off at zero each time."""
    if not steps:
        return F.lit(1.0)
    lams = F.array(*[F.array(*[F.lit(float(x)) for x in lam]) for lam in steps])
    return F.aggregate(lams, F.lit(1.0), lambda r, lam: F.greatest(F.lit(0.0), r - sum((F.get("posterior", F.lit(k)) * F.get(lam, F.lit(k)) for k in range(len(steps[0]))), F.lit(0.0))))


def _fold(rates: np.ndarray, p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    for lam in steps:
        rates = np.maximum(0.0, rates - p @ lam)
    return rates


def _pass(table: DataFrame, k: int, steps: list[np.ndarray], tried: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each list of further steps tried: the sums (k) it leads to, and the second moments (k, k) of the documents that it does not cut off."""
    size = k + k * k
    arrow = pa.schema([("at", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(tried), size))
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            before = _fold(np.ones(len(n)), p, steps)
            for c, more in enumerate(tried):
                r = _fold(before, p, more)
                live = p * (n * (r > 0))[:, None]
                out[c] += np.concatenate([(r * n) @ p, (live.T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], schema=arrow)

    rows = table.select("n_tokens", "posterior").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    got = np.zeros(len(tried) * size)
    for r in rows:
        got[r["at"]] = r["v"]
    got = got.reshape(len(tried), size)
    return got[:, :k], got[:, k:].reshape(-1, k, k)


def fit_rates(table: DataFrame, targets: list[float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Fit:
    """The fit for ``table`` (n_tokens, posterior), so that expected domain tokens match ``targets``."""
    k = len(targets)
    want = np.array(targets, float)
    if not k:
        return Fit([], want, 0.0)
    far = max(1.0, want.sum())
    steps: list[np.ndarray] = []
    sums, moments = _pass(table, k, steps, [[]])
    got, live = sums[0], moments[0]
    # at rate one no document is cut off
    metric = np.linalg.pinv(live, rcond=1e-9)

    def cost(reached: np.ndarray) -> float:
        return float((reached - want) @ metric @ (reached - want))

    def met() -> bool:
        return bool(np.abs(got - want).max() <= tolerance * far) or not metric.any()

    # the step that would be best if no document were cut off anew; the objective may rise on the way
    best = (cost(got), 0, got, live)
    while not met() and len(steps) < min(QUICK, rounds):
        steps.append(np.linalg.pinv(live, rcond=1e-9) @ (got - want))
        sums, moments = _pass(table, k, steps, [[]])
        got, live = sums[0], moments[0]
        best = min(best, (cost(got), len(steps), got, live), key=lambda b: b[0])
    # targets out of easy reach: on from the best rates so far by steps that never raise the objective
    if not met():
        least, size, got, live = best
        del steps[size:]
        for _ in range(rounds - QUICK):
            off = got - want
            plain = np.linalg.pinv(live, rcond=1e-9) @ off
            exact = np.linalg.pinv(live @ metric @ live, rcond=1e-9) @ live @ metric @ off
            tried = [*([x * (metric @ off)] for x in STRETCHES), [exact], [plain]]
            sums, moments = _pass(table, k, steps, tried)
            c = min(range(len(tried)), key=lambda c: cost(sums[c]))
            # a step that gains next to nothing means that the sums are the nearest there are
            if cost(sums[c]) >= least * (1 - 1e-6):
                break
            steps += tried[c]
            got, live, least = sums[c], moments[c], cost(sums[c])
            if met():
                break
    residual = float(np.abs(got - want).max() / far)
    if residual > tolerance:
        warnings.warn(f"domain tokens miss their targets by up to {residual:.4%} of all after {len(steps)} rounds", stacklevel=2)
    return Fit(steps, got, residual)


def mix(docs: DataFrame, model: Classifier, weights: dict[str, float], keep: tuple[str, ...] = ("doc_id",), text: str = "text", budget: float = 1.0, draw: tuple[str, str] | None = None, residual: bool = False) -> DataFrame:
    """``keep``, then n_tokens, posterior, rate and copies of every row and, if asked for, the fit's residual.

    ``weights`` are the domains' shares of ``budget`` times the table's tokens; a domain left out has share 0. Copies are drawn by
    the columns ``draw``: id and text if not given.
    """
    scratch = Scratch(docs.sparkSession)
    columns = draw or ("doc_id", text)
    names = {k: f"{k}_kept" if k.lower() in OUTPUTS else k for k in keep}
    rows = docs.select(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(1 << 52)).alias(DRAW), *[F.col(f"`{k}`").alias(n) for k, n in names.items()], F.col(f"`{text}`").alias(TEXT))
    table = scratch.write(posteriors(rows, model, (DRAW, *names.values()), TEXT))
    total = (table.agg(F.sum("n_tokens")).first()[0] or 0) * budget
    whole = sum(weights.get(d, 0.0) for d in model.domains)
    fit = fit_rates(table, [total * weights.get(d, 0.0) / whole for d in model.domains]) if whole else Fit([], np.zeros(0), 0.0)
    rated = table.select("*", _rate(fit.steps).alias("rate"))
    out = rated.withColumn("copies", (F.floor("rate") + F.when(F.col(DRAW) / float(1 << 52) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")).drop(DRAW)
    return out.withColumn("residual", F.lit(fit.residual)) if residual else out
