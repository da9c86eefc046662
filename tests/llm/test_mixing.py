import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SF = "/root/testdata/sf0.01"


def nearest(tokens, p, targets):
    """Nonnegative least squares by an active set: (rates, the least cost), from the problem's statement alone."""
    g = (p * tokens[:, None]).T @ p
    root = np.linalg.cholesky(np.linalg.inv(g)).T
    a, b = root @ (p * tokens[:, None]).T, root @ targets
    x, live = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
    for _ in range(10_000):
        gain = a.T @ (b - a @ x)
        gain[live] = -np.inf
        if live.all() or gain.max() <= 1e-9 * max(1.0, np.abs(b).max()) * np.abs(a).max():
            break
        live[int(gain.argmax())] = True
        while True:
            z = np.zeros(len(tokens))
            z[live] = np.linalg.lstsq(a[:, live], b, rcond=None)[0]
            if (z[live] > 0).all():
                break
            low = live & (z <= 0)
            x += np.min(x[low] / (x[low] - z[low])) * (z - x)
            live &= x > 1e-12
        x = z
    return x, float(np.sum((a @ x - b) ** 2))


def cost(tokens, p, targets, r):
    off = (r * tokens) @ p - targets
    return float(off @ np.linalg.inv((p * tokens[:, None]).T @ p) @ off)


@pytest.mark.parametrize("shares", [(0.5, 0.3, 0.2), (0.8, 0.15, 0.05), (0.9, 0.1, 0.0)])
def test_rates_are_the_nearest_nonnegative_ones(spark, shares):
    rng = np.random.default_rng(4)
    p, tokens = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 900, 200).astype(float)
    table = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>")
    targets = np.array([s * float(tokens.sum()) for s in shares])
    fit = mixing.fit_rates(table, targets.tolist())
    rows = table.select("n_tokens", "posterior", mixing._rate(fit.steps).alias("r")).collect()
    r, n, q = (np.array([x[k] for x in rows], float) for k in ("r", "n_tokens", "posterior"))
    assert (r >= 0).all()
    assert (r * n) @ q == pytest.approx(fit.sums, rel=1e-6, abs=1e-3)
    least = nearest(tokens, p, targets)[1]
    scale = float(targets @ np.linalg.inv((p * tokens[:, None]).T @ p) @ targets)
    assert cost(tokens, p, targets, r) <= least + 1e-3 * scale
    if min(shares) > 0:
        assert fit.residual <= mixing.TOLERANCE


def test_targets_out_of_reach_are_told(spark):
    table = spark.createDataFrame([(10, [0.6, 0.4]), (30, [0.5, 0.5])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        fit = mixing.fit_rates(table, [40.0, 0.0])
    # only the first document is of use: r * 10 * (0.6, 0.4) nearest to (40, 0)
    p, tokens = np.array([[0.6, 0.4], [0.5, 0.5]]), np.array([10.0, 30.0])
    x, least = nearest(tokens, p, np.array([40.0, 0.0]))
    assert fit.residual > 0.1 and fit.sums == pytest.approx((x * tokens) @ p, rel=0.05)


def test_documents_of_the_test_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    domain = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' ELSE 'low' END")
    model = mixing.train(docs, labels, domain)
    weights = {"high": 0.7, "low": 0.25, "toxic": 0.05}
    rows = mixing.mix(docs, model, weights, keep=("doc_id",)).collect()
    assert len(rows) == 1000 and all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    totals = np.array([np.array(r.posterior) * r.n_tokens * r.rate for r in rows]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx([weights[d] for d in model.domains], abs=0.002)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(texts[r.doc_id].split()) for r in rows)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    domain = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' ELSE 'low' END")
    model = mixing.train(docs, labels.where("doc_id % 3 > 0"), domain)
    held = docs.join(labels.where("doc_id % 3 = 0").select("doc_id", domain.alias("domain")), "doc_id")
    rows = mixing.posteriors(held, model, keep=("domain",)).collect()
    assert np.mean([model.domains[int(np.argmax(r.posterior))] == r.domain for r in rows]) > 0.9


def test_edges(spark):
    rows = [(1, "good words here " * 5, 1.0), (1, "good words here " * 5, 1.0), (2, None, 0.0), (3, "", 0.0), (None, "bad bad", 0.0), (4, "x " * 200_000, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    none = mixing.train(df, spark.createDataFrame([], "doc_id long, d string"), F.col("d"))
    got = mixing.mix(df, none, {"a": 1.0}).collect()
    assert [r.rate for r in got] == [1.0] * 6 and [r.copies for r in got] == [1] * 6
    model = mixing.Classifier([("a", "good words here")] * 30 + [("b", "bad bad other")] * 30)
    got = mixing.mix(df, model, {"a": 0.5, "b": 0.5}).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 15, 15, 200_000]
    same = [r.rate for r in got if r.doc_id == 1]
    assert same[0] == same[1] and all(r.rate >= 0 for r in got)
    assert mixing.mix(df.limit(0), model, {"a": 1.0}).count() == 0
    kept = mixing.mix(df, model, {"a": 0.5, "b": 0.5}, keep=("rate", "doc_id"), residual=True)
    assert kept.columns == ["rate_kept", "doc_id", "n_tokens", "posterior", "rate", "copies", "residual"] and kept.count() == 6


def test_training_reads_whole_texts(spark):
    # what tells the domains apart stands beyond 20,000 words of the same
    same = "same " * 20_000
    df = spark.createDataFrame([(i, same + ("left" if i % 2 else "right")) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "l" if i % 2 else "r") for i in range(60)], "doc_id long, d string")
    model = mixing.train(df, labels, F.col("d"))
    assert {"left", "right"} <= set(model.ids)
    assert len(mixing.train(df, labels, F.col("d"), per_domain=3).domains) == 2
