import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(fps):
    """Component of each (id, fp) by all pairs."""
    out = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 4 and out[j] < out[i]:
                    out[i], changed = out[j], True
    return out


def test_fingerprint():
    for t in [None, "", " \n", "One", "a b c d", "É a b c D e f g  h\x0bi", "w " * 70000 + "x y z"]:
        assert simhash.fingerprint(t) % 2**64 == slow_fingerprint(t)


@pytest.mark.parametrize(("hot", "work"), [(simhash.HOT, simhash.WORK), (2, simhash.WORK), (simhash.HOT, 4)])
def test_components(spark, monkeypatch, hot, work):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "WORK", work)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(14):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.links(df).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert got <= want
    parts = lambda pairs: brute_parts(fps, pairs)
    assert parts(got) == parts(want)
    if hot != 2 and work != 4:
        assert got == want


def brute_parts(nodes, pairs):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in nodes}


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base, 1), (3, base, 2), (9, base.replace("w150", "v"), 0), (5, None, 0), (6, "", 0), (8, "  ", 1), (4, "quite another text of a few words", 0), (None, base, 0), (None, "alone with no id", 0), (7, base, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    ids = [(r[0], slow_fingerprint(r[1])) for r in rows if r[0] is not None]
    want = brute(ids)
    for i, _, c in got:
        if i is not None:
            assert c == want[i]
    nulls = sorted([c for i, _, c in got if i is None], key=str)
    assert nulls == [3, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_goes_by_rows_not_ids(spark):
    base = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    third = " ".join(f"u{i}" for i in range(300))
    rows = [(1, base, "a"), (2, base, "b"), (2, other, "c"), (None, base, "d"), (None, third, "e"), (None, third, "e"), (4, None, "f"), (3, "", "g"), (2, other, "c"), (5, third + " x", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    near = (simhash.fingerprint(third) ^ simhash.fingerprint(third + " x")).bit_count() <= 4
    got = sorted(map(tuple, simhash.one_of_each(df.withColumnRenamed("fp", "mark").withColumnRenamed("mark", "late")).collect()), key=str)
    want = [(1, base, "a"), (2, other, "c"), (3, "", "g"), (5, third + " x", "h")] + ([] if near else [(None, third, "e")])
    assert got == sorted(want, key=str)
    assert simhash.one_of_each(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).columns == df.columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exploded_table_is_broadcast(spark):
    # ever so small a table of fingerprints is exploded into many times its rows; those must not go through the driver
    df = spark.createDataFrame([(i, f"word{i} " * 3) for i in range(50)], "doc_id long, text string")
    fps = simhash.fingerprints(df).select("fp").distinct()
    assert not [part for part in plan(simhash.links(fps)).split("BroadcastExchange")[1:] if "Generate" in part.split("\n")[1]]
    assert "SortMergeJoin" in plan(simhash.links(fps))
    assert "Broadcast" not in plan(simhash.near_duplicates(df))
    assert "Broadcast" not in plan(simhash.one_of_each(df))
