import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49) if i is not None else ():
            s = b[a : a + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 49) if i is not None else ():
            if least[b[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def text(rng, n, letters="abcd é中"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [text(rng, rng.choice([25, 48, 49, 50, 51, 60, 90, 300])) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng, rng.randint(0, 80)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, 50) if rng.random() < 0.95 else None, "".join(parts)))
    rows += [(3, None), (70, ""), (71, rows[5][1]), (72, rows[5][1]), (72, rows[5][1]), (73, "a" * 400), (74, "a" * 49), (75, "a" * 50), (76, "ab" * 60), (2**40, "ab" * 60), (-5, passages[7])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


def test_long_texts_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 10)
    monkeypatch.setattr(repeats, "PLACE_BITS", 9)
    rng = random.Random(8)
    a, b = text(rng, 5000), text(rng, 3000)
    rows = [(1, a), (2, b + a[1000:3000] + b), (3, a[:700] + "x" + b[:60])]
    monkeypatch.setattr(repeats, "_kept", {})
    data, starts, sizes = repeats._joined([t.encode() for _, t in rows])
    small = repeats.samples(data, starts, sizes)
    monkeypatch.setattr(repeats, "PLACE_BITS", 22)
    whole = repeats.samples(data, starts, sizes)
    assert np.isin(small[0], whole[0]).mean() > 0.99
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str) == brute(rows)


def test_test_table_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect()), key=str) == brute(rows)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs, kept_text=True).collect()}
    assert all(hashlib.sha256(kept[i]).hexdigest() == s for i, _, _, _, s in brute(rows))
