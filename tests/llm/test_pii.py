import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

TEXTS = [
    "mail a.b+c@x-y.example.com, or a@b (no) and é@x.org",
    "ips 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5 and 0000000000000000000001.2.3.255 " + "9" * 6000 + ".1.1.1",
    "card 4532 0151 1283 0366, 4532015112830367, 4532-0151-1283-0366",
    "call +1 (269) 555-3296 4524132264652876 or +49 30 1234567",
    "", None, "nothing here", "+12", "a@@b.c @", "x" * 100_000 + "@y.zz",
]


# the contract's patterns, word for word
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            s = m.group()
            digits = [int(c) for c in s if c in "0123456789"]
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p[-3:]) > 255 for p in s.split(".")):
                continue
            if kind == "card" and (not 16 <= len(digits) <= 19 or sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("text", TEXTS[:9])
def test_base_spans(text):
    assert pii.base_spans(text or "") == slow_base(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="a1.@-+ %(é5", max_size=12), st.sampled_from(["a@b.co", "+x@y.de", "1.2.3.4", "1.2.3", "4532015112830366", "+49 30 123", "@", "..", "255.1"])), max_size=8).map("".join))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == slow_base(text)


@pytest.mark.parametrize(
    "text",
    ["x@y " + "a" * 2_000_000, "1.1 " + "7" * 2_000_000, "+1 212 555 0175, " * 120_000, "a.b-c@d " * 250_000, "1.2.3 " * 330_000, "+1 " + " " * 2_000_000, "1" * 2_000_000 + ".2.3", "a@b.cd+" * 280_000, "x at y dot zz " * 2000 + "w" * 1_900_000],
    ids=["letters", "digits", "phones", "no addresses", "no ips", "blanks", "long ip", "joined addresses", "spelled out"],
)
def test_long_runs_take_linear_time(text):
    trees = pii.model()
    whole, part = [], text[: len(text) // 8]
    for t in (part, text):
        start = time.process_time()
        pii.find(t, trees)
        whole.append(time.process_time() - start)
    # 8 times the text: far from the 64 times of a quadratic search
    assert whole[1] < 20 * whole[0] + 2


def test_precision_and_recall_of_added_spans():
    """On synthetic sentences of another seed: spans that the base patterns do not find."""
    trees, rng = pii.model(), random.Random(77)
    hit = wrong = missed = 0
    for _ in range(3000):
        before, s, after, true = pii._sample(rng)
        a, b = len(before), len(before) + len(s)
        base, every = pii.find(before + s + after, trees)
        added = [x for x in every if x not in base and x[1] < b and x[2] > a]
        known = any(x[1] <= a and b <= x[2] for x in base)
        if true and not known:
            found = any(x[1:] == (a, b) for x in added)
            hit += found
            missed += not found
            wrong += sum(x[1:] != (a, b) for x in added)
        elif not true:
            wrong += len(added)
    print(f"added spans: precision {hit / (hit + wrong):.3f}, recall {hit / (hit + missed):.3f}")
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.75


def test_clash(spark):
    df = spark.createDataFrame([(1, "a@b.co", "s", 5)], "doc_id long, text string, spans string, n_ip int")
    (r,) = pii.scan_table(df, keep=("doc_id", "spans", "n_ip")).collect()
    assert (r.spans_kept, r.n_ip_kept, r.spans, r.n_ip) == ("s", 5, "email:0:6", 0)


def test_added_spans():
    trees = pii.model()
    spans = lambda s: {(k, s[a:b]) for k, a, b in pii.find(s, trees)[1]}
    assert ("phone", "+1 (269) 555-3296") in spans(TEXTS[3]) and ("card", "4524132264652876") in spans(TEXTS[3])
    assert spans("tel 212-555-0175 please") == {("phone", "212-555-0175")}
    assert spans("order 1234567890123456 of page 3") == set()
    assert spans("invoice 123-456-7890") == set()
    for t in TEXTS:
        base, every = pii.find(t, trees)
        assert set(base) <= set(every)


def test_redaction():
    s = "x a@b.co y 10.0.0.1 z"
    assert pii.redact(s, pii.find(s, pii.model())[1]) == "x [EMAIL] y [IP] z"
    assert pii.redact("abcdef", [("card", 1, 3), ("phone", 2, 5)]) == "a[CARD]f"


def test_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "c"), (0, TEXTS[0], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.scan_table(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            base = slow_base(TEXTS[r.doc_id])
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in pii.KINDS)
            assert r.base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
    assert pii.scan_table(df.limit(0)).count() == 0
