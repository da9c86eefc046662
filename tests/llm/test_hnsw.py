import numpy as np
import pytest

from tessera.llm import hnsw


def brute(rows, threshold=0.9):
    """(id, n_links, component) of each row, by all pairs."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = [v / np.linalg.norm(v) for _, v in good]
    near = [[k for k, b in enumerate(unit) if k != j and len(a) == len(b) and a @ b >= threshold] for j, a in enumerate(unit)]
    comp = [i for i, _ in good]
    while True:
        new = [min([comp[j], *(comp[k] for k in near[j]), *(comp[k] for k, (i, _) in enumerate(good) if i == good[j][0])]) for j in range(len(good))]
        if new == comp:
            break
        comp = new
    taken = iter(range(len(good)))
    out = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        j = next(taken) if ok else None
        out.append((i, len(near[j]) if ok else 0, comp[j] if ok else i))
    return out


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[:400] = x[0] + 0.2 * rng.normal(size=(400, 32)) * np.linalg.norm(x[0]) / 32**0.5
    x = hnsw._unit(rng.permutation(x))
    g, ids = hnsw.Graph(x), np.arange(len(x))
    want, found = g.audit(ids, (ids[:0], x[:0]), 0.9)
    assert want >= hnsw.LINKS and found >= hnsw.RECALL * want
    pairs = [(i + a, j) for a in range(0, len(x), 256) for i, j in zip(*g.near(x[a : a + 256], 0.9), strict=True) if i + a != j]
    every = int((x @ x.T >= 0.9).sum()) - len(x)
    assert 0.98 * every <= len(pairs) <= every


def test_audit_counts_no_vector_as_its_own_link():
    """Few true links among many vectors: a graph that misses them must widen, however many vectors find themselves."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[1490:] = x[:10] + 0.05 * rng.normal(size=(10, 24))
    x = hnsw._unit(x)
    g, ids = hnsw.Graph(x), np.arange(len(x))
    g.links[0][:] = -1
    g.beam = 4
    want, found = g.audit(ids, (ids[:0], x[:0]), 0.9)
    # every vector was drawn, the links are those of the ten pairs; without edges no beam finds them
    assert want == 20 and found < 20 and g.beam >= len(x)
    none = hnsw.Graph(hnsw._unit(rng.normal(size=(50, 24))))
    assert none.audit(np.arange(50), (ids[:0], x[:0]), 0.9999) == (0, 0)
    foreign = (np.array([7000]), none.x[:1] + 1e-9)
    assert none.audit(np.arange(50), foreign, 0.9999) == (1, 1)


def test_recall_of_the_query(spark):
    """The registered query's links on the test table against all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {i: (n, c) for i, n, c in brute(rows)}
    got = hnsw.near_duplicates(df).collect()
    assert sum(r.n_links for r in got) >= 0.9 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got) and {r.audit_recall for r in got} == {max(r.audit_recall for r in got)}
    assert got[0].audit_recall >= 0.9 and np.mean([r.component_id == want[r.vec_id][1] for r in got]) >= 0.9


def test_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rows += [(10_000 + i, [x + 0.01 * k for k, x in enumerate(rows[3][1][:60])] + rows[3][1][60:]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    back = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect())
    assert got == sorted(brute(back))


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (4, [1.0, 0.4]), (6, [1.0, 0.6]), (1, None), (2, []), (7, [0.0, 0.0]), (8, [1.0, None]), (10, [1.0, nan]), (11, [inf, 0.0]), (12, [1.0]), (13, [-0.0, -1.0]), (14, [0.0, -1.0]), (15, [1e-30, 1e-30]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in hnsw.near_duplicates(df).collect())
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
    assert hnsw.near_duplicates(df.where("vec_id < 3")).count() == 2


@pytest.mark.parametrize("n", [1, 2, 7])
def test_small_graphs(n):
    x = hnsw._unit(np.random.default_rng(n).normal(size=(n, 4)))
    g = hnsw.Graph(x)
    g.audit(np.arange(n), (np.arange(0), x[:0]), 0.5)
    i, j = g.near(x, -1.0)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(n) for b in range(n)}
