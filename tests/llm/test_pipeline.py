"""The pipeline against a plain run of its stages over lists of rows."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import langid, mixing, pii, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 !!", "en", "s", 6), (9003, docs.first().text, None, "s", 1), (None, "the and of no id", "en", "s", 5), (9004, "the and of a.b@c.example " * 3, "en", "s", 1)], docs.schema)
    docs, out = docs.unionByName(more), []
    out.append(docs.collect())
    for i, (_, f) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns(stages):
    for rows in stages[:-1]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_language(stages, spark):
    before, after = stages[:2]
    field = langid.train(spark.createDataFrame(before).where(langid.LEARNS))
    labels, scores = langid.Labeller(field).predict([r.text for r in before])
    want = [(r.doc_id, r.text, r.lang or p, r.source, r.n_chars) for r, p, s in zip(before, labels, scores, strict=True) if p != "und" and s >= cp.LEAST_SCORE]
    assert sorted(want, key=str) == sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in after), key=str)
    assert not {9001, 9002} & {r.doc_id for r in after}


def plain_survivors(rows):
    """One row of each component of fingerprints at 4 bits or fewer, by all pairs: the smallest id's."""
    fps = [simhash.fingerprint(r.text) % 2**64 for r in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    best = {}
    for r, c in zip(rows, comp, strict=True):
        key = (r.doc_id is None, r.doc_id or 0)
        if c not in best or key < best[c][0]:
            best[c] = (key, r)
    return [r for _, r in best.values()]


def test_near_duplicates(stages):
    before, after = stages[1:3]
    assert sorted(plain_survivors(before), key=str) == sorted(after, key=str)


def test_personal_data(stages):
    before, after = stages[2:4]
    key = lambda r: (r[0] is None, r[0])
    for a, b in zip(sorted(before, key=key), sorted(after, key=key), strict=True):
        assert b.text == pii.redact(a.text, pii.find(a.text, pii.model())[1]) and b.n_chars == len(b.text)
        assert not pii.base_spans(b.text)


def test_mixture(stages, spark):
    before, after = stages[3:5]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = mixing.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.expr(cp.DOMAIN))
    mixed = mixing.mix(docs, model, cp.WEIGHTS, keep=tuple(docs.columns), draw=("doc_id", "text")).collect()
    want = [r[:5] for r in mixed for _ in range(r.copies)]
    assert sorted(want, key=str) == sorted(map(tuple, after), key=str) and len(want) > 50


def test_tokens(stages):
    before, after = stages[4:]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, r.lang, r.source, r.n_chars, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(map(tuple, after), key=str)


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    assert len(rows) > 50


CLASHES = ["lang_pred", "score", "_nth", "kept", "fp", "mark", "component", "row", "late", "redacted", "spans", "n_email", "copies", "rate", "posterior", "n_tokens", "copy", "c0", "draw_of_copies", "ids", "ids_sha256", "decoded_sha256", "label", "hash", "id", "t", "rest", "key"]


def through(spark, docs, tmp_path):
    """The rows after each stage."""
    out = [docs]
    for i, (_, f) in enumerate(cp.STAGES):
        f(spark, out[-1], SF).write.parquet(str(tmp_path / str(i)))
        out.append(spark.read.parquet(str(tmp_path / str(i))))
    return out


def test_further_columns_and_repeated_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    a, b = (max((t for t in texts), key=len), min((t for t in texts if len(t) > 200), key=len))
    more = spark.createDataFrame([(9101, a + " x", "en", "s", 1), (9102, b, "en", "s", 1), (9102, "the of and " + a[: len(a) // 2], "en", "s", 1), (9103, "the and of " * 460_000, "en", "s", 1)], docs.schema)
    plain = through(spark, docs.unionByName(more), tmp_path / "plain")
    wide = through(spark, docs.unionByName(more).select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in CLASHES]), tmp_path / "wide")
    for p, w in zip(plain[:-1], wide[:-1], strict=True):
        assert w.columns == [*docs.columns, *CLASHES] and p.columns == docs.columns
        assert sorted(map(str, p.collect())) == sorted(map(str, w.select(*docs.columns).collect()))
        assert w.where(" OR ".join(f"`{c}` <> concat('{c}:', doc_id)" for c in CLASHES)).count() == 0
    assert wide[-1].count() == plain[-1].count() and {"ids_kept", "ids", "score"} <= set(wide[-1].columns)
    # both texts of id 9102 are judged by themselves
    kept = [r for r in plain[2].collect() if r.doc_id == 9102]
    assert {r.text for r in kept} == {r.text for r in plain_survivors(plain[1].collect()) if r.doc_id == 9102}
    assert 9103 in {r.doc_id for r in plain[3].collect()}


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for step in through(spark, docs.limit(0), tmp_path):
        assert step.count() == 0
