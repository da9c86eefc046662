"""Personal data: patterns, then boosted trees over candidate spans.

Base spans are the leftmost matches of four fixed patterns that pass their check. High-recall generators propose
further spans, which may overlap: strict forms inside longer runs of digits, national phone numbers, spelled-out or
accented addresses, 13 to 15 digit cards, IPv6. Gradient boosted trees score each candidate by its format and context, and
thresholds calibrated for each kind on held-out candidates select the ones that are added, best first, without overlap.
The trees are trained on the driver on candidates of synthetic sentences, made by rule with a fixed seed: the size of the
training table is a parameter.

A null text counts as empty: no spans. Offsets are code points. Base spans always stay; an added span never lies
inside a base span. Of added spans with equal scores (ties) the first, then the longer, is taken. Each row is judged by
its own text, so repeats and null ids are harmless. Very long texts take time linear in their length: every pattern is
anchored where a run starts, and spans are compared in order. An empty table gives no rows. A kept column named
like an output column comes back with ``_kept`` added. No shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right, insort
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import per_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns, each searched where a run of its characters starts, so that a run is read once. An address is looked
# for from its sign on: of the run of characters before it, all that no earlier address has taken belong to it.
LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?=@)")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A text without these holds no match of the kind.
NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]")}

PROPOSE = {
    "email": (
        re.compile(r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)++"),
        re.compile(r"(?<![\w.%+-])[\w.%+-]++\s?(?:\(at\)|\[at\]|\sat\s)\s?[\w-]++(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[\w-]{2,}+)++", re.I),
    ),
    "ip": (
        re.compile(r"(?<![0-9.])(?=((?:[0-9]{1,3}\.){3}[0-9]{1,3}))(?!(?:[0-9]+\.){4})"),
        re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ),
    "card": (
        re.compile(r"(?<![0-9])(?=((?:[0-9]{4}[\x20-]?){3}[0-9]{4})(?![0-9]))"),
        re.compile(r"(?<![0-9])(?=([0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9]))"),
        re.compile(r"(?<![0-9])(?=([0-9]{13,19})(?![0-9]))"),
    ),
    "phone": (
        re.compile(r"(?=(\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])))"),
        re.compile(r"(?<![\w+.])(?=(\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4})(?![\w]))"),
        re.compile(r"(?<![\w+.])(?=(00[1-9][0-9]{0,2}[\x20.-][0-9][0-9\x20.-]{5,14}[0-9])(?![\w]))"),
    ),
}
PROPOSE_NEEDS = {"email": re.compile(r"@|\(at\)|\[at\]|\sdot\s|\(dot\)|\[dot\]", re.I), "ip": re.compile(r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": re.compile(r"[0-9]{4}"), "phone": re.compile(r"[0-9]{3}")}
CUES = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reach|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|addr|login|client|ping)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|fax|cell|whatsapp|telefon|teléfono)\b", re.I),
}
AGAINST = re.compile(r"\b(order|invoice|isbn|version|build|release|serial|part|item|no|nr|id|section|figure|table|ticket|ref|tracking|account)\b[\s.:#]*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _passes(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    return (16 <= len(digits) <= 19 and luhn(digits)) if kind == "card" else 8 <= len(digits) <= 15


def _emails(text: str) -> list[Span]:
    out, last = [], 0
    for m in LOCAL.finditer(text):
        # the part of the run that an earlier address ended in is its own
        start = max(m.start(), last)
        if start < m.end() and (d := DOMAIN.match(text, m.end())):
            out.append(("email", start, d.end()))
            last = d.end()
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = _emails(text) if NEEDS["email"].search(text) else []
    return out + [(kind, m.start(), m.end()) for kind, pattern in BASE.items() if NEEDS[kind].search(text) for m in pattern.finditer(text) if _passes(kind, m.group())]


def propose(text: str) -> list[Span]:
    """Candidates of all generators, overlapping, without repeats."""
    out = dict.fromkeys((kind, *m.span(1 if m.re.groups else 0)) for kind in KINDS if PROPOSE_NEEDS[kind].search(text) for pattern in PROPOSE[kind] for m in pattern.finditer(text))
    return list(out)


def _around(c: str) -> float:
    return 0.0 if c == "" else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    digits = re.sub("[^0-9]", "", s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    dots = [int(g[-4:]) for g in s.split(".") if g.isdigit()]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(luhn(digits)) if digits else 0.0, float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(set(digits))), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.startswith("+")), float("(" in s), float(max(dots, default=0)), float(s.count("@")),
        float(":" in s), float(bool(CUES[kind].search(before))), float(bool(AGAINST.search(before))), _around(before[-1:]), _around(after[:1]), float(bool(re.match(r"[.-][0-9]", after))), float(bool(re.search(r"[0-9][.-]$", before))),
        float(bool(re.search(r"\.(com|org|net|edu|gov|io|de|fr|es|uk)$|\bdot\b", s, re.I))), float(int(digits[0]) if digits else -1), float(digits[:2] in ("34", "37")), float(all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split(".")) if kind == "ip" and ":" not in s and all(p.isdigit() for p in s.split(".")) else 1),
    ]


# ---- boosted trees -------------------------------------------------------------------------------------------------

DEPTH, TREES, SHRINK, ROWS, SEED = 3, 40, 0.3, 4000, 11


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right) or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 10:
        return leaf
    best, total_g, total_h = (1e-3, 0, 0.0), g.sum(), h.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
        gain[v[1:] == v[:-1]] = -1
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), f, float((v[i] + v[i + 1]) / 2))
    if best[0] <= 1e-3:
        return leaf
    left = x[:, best[1]] < best[2]
    return best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


class Trees:
    """Boosted trees under logistic loss with a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        held = np.arange(len(y)) % 4 == 3
        tx, ty = x[~held], y[~held]
        self.trees, f = [], np.zeros(len(ty))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = _grow(tx, p - ty, p * (1 - p), DEPTH)
            self.trees.append(tree)
            f += SHRINK * np.array([_value(tree, r) for r in tx])
        scores = np.array([self.score(r) for r in x[held]])
        self.cuts = {}
        for k, kind in enumerate(KINDS):
            own = x[held][:, 0] == k
            wrong = scores[own & (y[held] == 0)]
            # above nearly all wrong candidates that were held out, and never below one half
            self.cuts[kind] = max(0.5, float(np.quantile(wrong, 0.99)) if len(wrong) else 0.5)

    def score(self, row) -> float:
        return float(1 / (1 + np.exp(-SHRINK * sum(_value(t, row) for t in self.trees))))


def _sample(rng: random.Random) -> tuple[str, str, str, bool]:
    """(before, string, after, is personal) of a synthetic sentence."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n: int) -> str:
        body = rng.choice(["4", "51", "37", "6011"]) + num(n)
        body = body[: n - 1]
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    domain = f"{word()}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}"
    ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    c16, area, end = card(16), f"{rng.randint(200, 999)}", f"{rng.randint(200, 999)}-{num(4)}"
    good = [
        (rng.choice(["", "email ", "write to "]), f"{word()}.{num(2)}@{domain}"), ("contact ", f"{word()} at {word()} dot com"), ("mail ", f"{word()}[at]{domain}"), ("", f"{word()}é{word()}@{domain}"),
        (rng.choice(["", "ip ", "host "]), ip), ("server ", ":".join(f"{rng.randrange(65536):x}" for _ in range(8))),
        (rng.choice(["", "card "]), c16), ("card ", " ".join(c16[i : i + 4] for i in range(0, 16, 4))), ("amex ", card(15)), (f"+1 ({area}) {end} ", c16), (f"{num(3)}-{num(4)} ", c16),
        ("", f"+1 ({area}) {end}"), ("call ", f"({area}) {end}"), ("tel ", f"{area}-{end}"), ("phone ", f"{area}.{end.replace('-', '.')}"), ("tel ", f"0049 {num(2)} {num(7)}"), ("", f"+{rng.randint(30, 49)} {num(3)} {num(3)} {num(4)}"),
    ]
    bad_card = next(x for x in iter(lambda: num(16), None) if not luhn(x))
    bad = [
        ("", f"meet at {word()} dot {word()}s"), (f"{word()} ", f"{word()} at {word()}.{word()}"), ("version ", ".".join(str(rng.randint(0, 20)) for _ in range(4))), ("", f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}.{num(3)}"), ("release ", f"{num(1)}.{num(1)}.{num(1)}.{num(2)}"),
        ("order ", num(16)), ("", bad_card), ("tracking ", num(15)), ("id ", num(rng.randint(13, 19))), ("", f"{num(rng.randint(17, 19))}"), ("invoice ", f"{num(3)}-{num(3)}-{num(4)}"), ("part ", f"{num(3)} {num(3)} {num(4)}"), ("isbn ", f"{num(3)}-{num(3)}-{num(4)}"), ("", f"{num(3)} {num(3)} {num(4)}"), ("no ", f"001 {num(3)} {num(6)}"), ("", f"00{num(2)}.{num(8)}"), ("", f"{num(3)} {num(3)} {num(4)} {num(3)}"),
    ]
    true = rng.random() < 0.5
    before, s = rng.choice(good if true else bad)
    filler = " ".join(word() for _ in range(rng.randint(1, 5)))
    tail = rng.choice([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.15:
        tail = f" {num(rng.randint(4, 16))} {word()}"
    return f"{filler} {before}", s, tail, true


@cache
def model(rows: int = ROWS, seed: int = SEED) -> Trees:
    """The trees, fitted on the candidates of ``rows`` synthetic sentences."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(rows):
        before, s, after, true = _sample(rng)
        text, a = before + s + after, len(before)
        for span in propose(text):
            inside = span[1] < a + len(s) and span[2] > a
            if inside:
                x.append(describe(text, span))
                y.append(float(true and span[1:] == (a, a + len(s))))
    return Trees(np.array(x), np.array(y))


class _Sorted:
    """Spans in order of their starts, for questions about a stretch of text."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans, key=lambda s: s[1])
        self.starts = [a for _, a, _ in self.spans]
        self.reach = list(accumulate((b for _, _, b in self.spans), max))

    def holds(self, a: int, b: int) -> bool:
        """Whether one span holds all of the stretch."""
        i = bisect_right(self.starts, a)
        return i > 0 and self.reach[i - 1] >= b

    def meeting(self, a: int, b: int) -> list[Span]:
        """The spans that share a character with the stretch."""
        out = []
        for i in range(bisect_left(self.starts, b) - 1, -1, -1):
            if self.reach[i] <= a:
                break
            if self.spans[i][2] > a:
                out.append(self.spans[i])
        return out


def find(text: str | None, trees: Trees) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    known = _Sorted(base)
    rest = [c for c in propose(text) if not known.holds(*c[1:])]
    if not rest:
        return base, base
    scored = sorted(((trees.score(describe(text, c)), c) for c in rest), key=lambda r: (-r[0], r[1][1], -r[1][2], KINDS.index(r[1][0])))
    # added spans do not overlap, so only the nearest two can meet a candidate
    taken: list[tuple[int, int]] = []
    added: list[Span] = []
    for score, c in scored:
        kind, a, b = c
        i = bisect_left(taken, (a, b))
        free = (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a)
        if score >= trees.cuts[kind] and free and all(k == kind and a <= x and y <= b for k, x, y in known.meeting(a, b)):
            insort(taken, (a, b))
            added.append(c)
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, overlapping ones joined, replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, at, last = [], 0, None
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            if b > at and last is not None:
                at = b
            continue
        out += [text[at:a], f"[{k.upper()}]"]
        at, last = b, k
    return "".join([*out, text[at:]])


def scan_table(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """``keep``, then n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and, if asked for, the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(cols: list[list]) -> list[list]:
        found = [find(t, shared.value) for t in cols[-1]]
        counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
        marks = [hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in found]
        return [*cols[:-1], *counts, marks, [spell(every) for _, every in found], *([[redact(t, every) for t, (_, every) in zip(cols[-1], found, strict=True)]] if redacted else [])]

    more = [*(f"n_{k} bigint" for k in KINDS), "base_sha256 string", "spans string", *(["redacted string"] if redacted else [])]
    return per_text(docs, keep, text, run, ", ".join(more))
