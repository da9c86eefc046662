import hashlib
import itertools

import numpy as np
import pytest
import xxhash

from tessera.llm import minhash


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))


BASE = words(1, 400)
ROWS = [(9, BASE), (3, BASE), (7, BASE.replace(BASE.split()[100], "zz")), (5, None), (4, ""), (12, words(2, 300)), (1, "few words"), (-6, "x"), (20, words(3, 5000) + " é中🎉" * 9), (7, "again seven"), (None, "no id"), (None, BASE)]


def slow_fingerprint(text):
    """128 universal hashes over the distinct 5-word shingles, in plain integers: 16 bits of a mix of each minimum."""
    toks = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    grams = {" ".join(toks[i : i + 5]) for i in range(max(1, len(toks) - 4))} if toks else set()
    hashes = [xxhash.xxh64_intdigest(g.encode(), minhash.SEED) for g in grams]
    out = ""
    for a, b in zip(minhash.A.tolist(), minhash.B.tolist(), strict=True):
        x = min(((h * a + b) % 2**64 for h in hashes), default=2**64 - 1)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        out += f"{x >> 48:04x}"
    return out


def test_fingerprint_is_the_plain_one():
    for t in ["", None, "One", "a b c d e f", "É x " * 40, words(5, 700)]:
        assert minhash.spell(minhash.text_signature(t)) == slow_fingerprint(t)


def test_edited_signature_is_the_whole_texts():
    texts = ["", "a", "a b", " a  b c d e f g h ", "a b c d e f g h i j k", "x" * 50, words(6, 40), words(7, 41) + "é" * 30, "q r s t u v w" + " " * 40, " " * 9 + "A b  C d e f\tg h i j\nk l", "a b c d e f g h i j k l m n" * 9]
    for own, after in itertools.product(texts, texts):
        hashes, same = minhash.shingle_hashes(own, minhash.SHINGLE, minhash.SEED), minhash.untouched(own)
        change = minhash.edited(own, after)
        assert np.array_equal(minhash.edited_signature(change, same, minhash.signature(hashes[:same])), minhash.text_signature(change))


@pytest.mark.parametrize("size", [1 << 25, 3000, 40])
def test_against_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(minhash, "RANGE_BYTES", size)
    df = spark.createDataFrame([(*r, 1.0) for r in ROWS], "doc_id long, text string, near_next double")
    got = sorted((tuple(r) for r in minhash.fingerprinted(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    order = sorted([(i, t or "") for i, t in ROWS], key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1]), r[1]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        change = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(change.encode()).hexdigest(), t, change, after))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:3] == w[:3]
        assert g[3] == slow_fingerprint(w[3]) and g[4] == slow_fingerprint(w[4])
        assert g[5] == pytest.approx(jaccard(w[3], w[4]), abs=0.15) and g[6] == pytest.approx(jaccard(w[3], w[5]), abs=0.15)


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    (r,) = minhash.fingerprinted(df).collect()
    assert r.near_next == 1.0 and r.component_id == 1
    assert minhash.fingerprinted(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_near_components(spark, monkeypatch, block):
    """Against all pairs by true Jaccard likeness, with ids that repeat and are null."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [*ROWS, *[(100 + k, BASE.replace(BASE.split()[k], f"y{k}")) for k in range(8)], (-50, BASE.upper()), (None, words(3, 5000) + " é中🎉" * 9), (200, "few  words\n"), (4, words(2, 300))]
    rows += [(300 + k, " ".join(BASE.split()[20 * k : 20 * k + 330])) for k in range(4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_chars, r.component_id) for r in minhash.fingerprinted(df).collect()), key=str)
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.permutations(range(len(rows)), 2):
            if comp[j] < comp[i] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                comp[i], changed = comp[j], True
    least = {c: min((i for (i, _), d in zip(rows, comp, strict=True) if d == c and i is not None), default=None) for c in set(comp)}
    assert got == sorted(((i, len(t or ""), least[c]) for (i, t), c in zip(rows, comp, strict=True)), key=str)
    assert minhash.near_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100_000, 300_000])
def test_long_texts(n):
    a, b = (" ".join(f"{p}{i}" for i in range(n)) for p in "ab")
    x, y, half = (minhash.text_signature(t) for t in (a, b, f"{a} {b}"))
    assert minhash.likeness(x, y) == 0.0
    assert minhash.likeness(x, half) == pytest.approx(jaccard(a, f"{a} {b}"), abs=0.15)
    assert len({minhash.spell(x)[i : i + 4] for i in range(0, 512, 4)}) > 100
