import itertools

import numpy as np
import pytest

from tessera.llm import langid

EN = "the cat and the dog with that house of this was there when they"
DE = "der hund und die katze mit das haus von dieser war nicht wenn sie"


def test_forward_backward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    k, lengths = 3, np.array([4, 2, 1])
    scores, moves, starts = rng.normal(size=(3, 4, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, joint = langid.posteriors(scores, lengths, moves, starts, pairs=True)
    want_joint = np.zeros((k, k))
    for b, n in enumerate(lengths):
        weights = {p: np.exp(starts[p[0]] + sum(scores[b, i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in itertools.pairwise(p))) for p in itertools.product(range(k), repeat=int(n))}
        total = sum(weights.values())
        for t in range(n):
            for y in range(k):
                assert got[b, t, y] == pytest.approx(sum(w for p, w in weights.items() if p[t] == y) / total)
        for p, w in weights.items():
            for x, y in itertools.pairwise(p):
                want_joint[x, y] += w / total
        assert not got[b, n:].any()
    assert joint == pytest.approx(want_joint)


@pytest.fixture(scope="module")
def field():
    return langid.fit([("en", f"{EN} {i}") for i in range(5)] + [("de", DE.upper())] * 5)


def test_words_of_code_switched_text(field):
    got = dict(langid.label_words(field, "the dog and the house, der hund und das haus!"))
    assert got["the"] == got["house"] == "en" and got["der"] == got["haus"] == "de"


def test_edges(spark, field):
    rows = [(1, EN, "x"), (2, None, "x"), (3, "123 ... \n", "x"), (None, DE, "x"), (1, EN, "x"), (4, "haus " * 50_000, None), (5, "", "x"), (6, "½ ²³ Ⅷ ٣ 一1"[:7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict_table(df, field).collect()), key=str)
    assert [(i, p) for i, p, _ in got] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "de"), (5, "und"), (6, "und"), (None, "de")]
    assert all(0 <= s <= 1 for *_, s in got) and all(s == 0 for _, p, s in got if p == "und")
    assert langid.predict_table(df.limit(0), field).count() == 0
    none = langid.train(spark.createDataFrame([(1, None, "a b")], "doc_id long, lang string, text string"))
    assert {r.lang_pred for r in langid.predict_table(df, none).collect()} == {"und"}


def test_cache_bound(monkeypatch, field):
    want = langid.Labeller(field).predict([EN, DE])
    monkeypatch.setattr(langid, "CACHE_WORDS", 2)
    one = langid.Labeller(field)
    assert [one.predict([t])[0][0] for t in (EN, DE, EN)] == ["en", "de", "en"]
    assert one.predict([EN, DE]) == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "crc32(cast(doc_id as string)) % 4 = 2 as held")
    field = langid.train(docs.where("not held"))
    rows = langid.predict_table(docs.where("held"), field, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_words_are_letters_with_their_marks():
    assert langid.words_of("½ a1b ²³ Ünï हिन्दी भाषा e\u0301t x_y Ⅷ") == ["a", "b", "ünï", "हिन्दी", "भाषा", "e\u0301t", "x", "y"]
    assert langid.words_of(None) == langid.words_of("12 ¼ _ .") == []


def test_templates_do_not_meet():
    # prefix "p" + "a" and the bigram "pa", suffix "s" + "th" and the trigram "sth", word "w" + "a" and the bigram "wa"
    kinds = {}
    for w in ("pa", "a", "wa", "sth", "th", "path", "was"):
        for f in langid.features(w):
            kinds.setdefault(f[1:], set()).add(f[0])
            assert f[0] in "WPSN"
    assert kinds["pa"] >= {"W", "P", "N"} and len(set(langid.features("a"))) == len(langid.features("a"))


def test_training_takes_distinct_texts_and_whole_ones(spark):
    late = "zzz " * 3000 + "le chat et la maison"
    rows = [("fr", "copie " * 4)] * 500 + [("fr", late)] + [("en", EN)] * 3
    df = spark.createDataFrame(rows, "lang string, text string")
    seen = {}
    real = langid.fit
    try:
        langid.fit = lambda got, **_: seen.update(rows=got) or real(got)
        langid.train(df, per_label=2)
    finally:
        langid.fit = real
    assert sorted(seen["rows"]) == sorted([("en", EN), ("fr", "copie " * 4), ("fr", late)])


def test_clash(spark, field):
    df = spark.createDataFrame([(1, EN, "x", 2.0)], "doc_id long, text string, lang_pred string, score double")
    got = langid.predict_table(df, field, keep=("lang_pred", "score")).collect()
    assert [tuple(r)[:3] for r in got] == [("x", 2.0, "en")]
