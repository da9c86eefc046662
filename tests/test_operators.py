"""Operators against plain Python, hand-computed values and each other."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import queries
from tessera.apps import identity, segments
from tessera.functions import spatial as sx
from tessera.functions import text as tx
from tessera.functions import vector as vx
from tessera.operators import evaluation, knn, search, spatial
from tessera.streaming import events

DOCS = [(1, "uno dos"), (2, "dos tres tres"), (3, "CUATRO, único_dos"), (4, ""), (5, None), (6, "ﬁn de año")]


def slow_bm25(docs, query):
    toks = {i: tx.tokenize(t) for i, t in docs if t is not None}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, t in toks.items():
        s = 0.0
        for q in set(tx.tokenize(query)):
            df, tf = sum(q in x for x in toks.values()), t.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        out[i] = s
    return out


def test_bm25(spark):
    df = spark.createDataFrame(DOCS, "id int, t string")
    got = {r.id: r.score for r in search.bm25(df, "t", "dos tres nada").collect()}
    assert got == pytest.approx(slow_bm25(DOCS, "dos tres nada") | {5: 0.0})


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for _, t in DOCS], "t string")
    rows = df.select("t", tx.tokens("t").alias("fast"), tx.tokens("t", exact=True).alias("full"), tx.tokens("t", ["Dós"]).alias("fewer")).collect()
    for r in rows:
        want = None if r.t is None else tx.tokenize(r.t)
        assert r.full == want
        assert r.fast == want and r.fewer == (None if want is None else [w for w in want if w != "dos"])
    assert len(tx.stopwords(spark, "spanish")) > 300


SCRIPTS = ["мой дом Йод", "tiếng Việt Đường", "ﬁle ﬂow ﬀ", "ώρα ΏΡΑ ὥρα", "한국어 문서", "हिन्दी", "日本語 ｶﾞ ㎏ ①", "ǅ Ǆ ĳ ŉ", "𝐁old 𝟙", "İstanbul ẞ ſ", "e\u0301te\u0301 a\u0323\u0302", "Ω ℃ ½ x²", "ᾳ ΐ"]


def test_tokens_of_all_scripts(spark):
    df = spark.createDataFrame(list(enumerate(SCRIPTS)), "id int, t string")
    for r in df.select("t", tx.tokens("t").alias("got")).collect():
        assert r.got == tx.tokenize(r.t), r.t
    for i, word in [(0, "мой"), (0, "МОЙ"), (0, "йод"), (1, "tiếng"), (1, "viet"), (2, "file"), (2, "ﬁle"), (3, "ώρα"), (4, "한국어"), (6, "ガ"), (8, "bold"), (9, "istanbul"), (10, "été"), (10, "ậ")]:
        assert [x.id for x in search.match(df, "t", word).collect()] == [i], word
        assert [x.id for x in search.bm25(df, "t", word).where("score > 0").collect()] == [i], word


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_tokens_of_any_text(spark, texts):
    texts = [t for t in texts if "\0" not in t]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.tokens("t").alias("got")).collect():
        assert r.got == tx.tokenize(r.t), repr(r.t)


def test_index_changes(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "id int, t string")
    index = search.TextIndex.build(df.where("id < 3"), "id", "t", str(tmp_path / "i"))
    grown = index.add(df.where("id >= 3"), "id", "t").remove(spark.createDataFrame([(1,)], "doc int"))
    want = {k: v for k, v in slow_bm25([d for d in DOCS if d[0] != 1], "dos tres").items() if v}
    assert {r.doc: r.score for r in grown.search("dos tres").collect()} == pytest.approx(want)


def test_distances(spark):
    one = spark.range(1)
    lima, cusco = (-77.0428, -12.0464), (-71.9675, -13.5320)
    row = one.select(sx.haversine(*lima, *cusco).alias("h"), sx.haversine(179.9, 0, -179.9, 0).alias("d"), sx.euclidean(0, 0, 3, 4).alias("e")).first()
    assert row.h == pytest.approx(573_000, rel=0.02) and row.d == pytest.approx(22_239, rel=0.001) and row.e == 5


def test_radius_boxes_hold_every_near_point():
    rng = random.Random(3)

    def distance(a, b):
        x1, y1, x2, y2 = map(math.radians, (*a, *b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * sx.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))

    for _ in range(300):
        c, r = (rng.uniform(-180, 180), rng.uniform(-90, 90)), 10 ** rng.uniform(2, 7.4)
        boxes = sx.radius_boxes(*c, r)
        for _ in range(40):
            p = (rng.uniform(-180, 180), rng.uniform(-90, 90))
            if distance(c, p) <= r:
                assert any(w <= p[0] <= e and s <= p[1] <= n for w, s, e, n in boxes)


def test_ring_and_grid(spark, tmp_path):
    ring = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0), (0.0, 0.0))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 2.0, 2.0), (4, 4.0, 1.0), (5, 0.0, 0.0), (6, 5.0, 5.0), (7, 3.0, 3.0), (8, None, 1.0)], "id int, x double, y double")
    assert {r.id for r in spatial.within_polygon(pts, "x", "y", ring).collect()} == {1, 3, 4, 5, 7}
    grid = spatial.GridIndex.build(pts, "x", "y", str(tmp_path / "g"), 2.0)
    assert {r.id for r in grid.radius((2.0, 2.0), 1.0, "EUCLIDEAN").collect()} == {r.id for r in spatial.radius(pts, "x", "y", (2.0, 2.0), 1.0, "EUCLIDEAN").collect()} == {2, 3}
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = spark.range(1).select(sx.box_meets_ring(box(1.5, 2.5, 2.5, 5), ring).alias("notch"), sx.box_meets_ring(box(1.9, 3.9, 2.1, 5), ring).alias("gap"), sx.box_meets_ring(box(-9, 1, 9, 2), ring).alias("across"), sx.box_meets_ring(box(4, 0, 5, 1), ring).alias("touch")).first()
    assert (row.notch, row.gap, row.across, row.touch) == (True, False, True, True)


def test_knn_join_and_ivf(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>").repartition(3)
    for metric in ("cosine", "euclidean", "dot_product"):
        d = vx.np_distance(x[:5].astype(float), x.astype(float), metric)
        got = {}
        for r in knn.knn_join(df.where("id < 5"), df, "id", "id", "v", 4, metric).collect():
            got.setdefault(r.query, set()).add(r.neighbour)
        assert got == {q: set(np.argsort(d[q], kind="stable")[:4].tolist()) for q in range(5)}
        one = [r.id for r in knn.knn(df, "v", x[0].tolist(), 4, metric, "id").collect()]
        assert set(one) == got[0]
    index = knn.IvfIndex.build(df, "v", str(tmp_path / "ivf"), 8)
    exact = {r.id for r in knn.knn(df, "v", x[0].tolist(), 10, key="id").collect()}
    assert {r.id for r in index.search(x[0].tolist(), 10, probe=8, key="id").collect()} == exact
    assert len({r.id for r in index.search(x[0].tolist(), 10, probe=4, key="id").collect()} & exact) >= 5
    index.add(spark.createDataFrame([(999, x[0].tolist())], "id int, v array<float>"))
    assert 999 in {r.id for r in index.search(x[0].tolist(), 2, key="id").collect()}


def test_ivf_is_exact(spark, tmp_path, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = knn.IvfIndex.build(e, "embedding", str(tmp_path / "ivf"))
    rows = {r.vec_id: r.embedding for r in e.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    asked = [i for i in ids.tolist() if i % 50 == 0]
    queries = e.where("vec_id % 50 = 0")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 15 * 8 * x.shape[1])
    for metric in ("cosine", "euclidean", "dot_product"):
        d = vx.np_distance(np.array([rows[i] for i in asked], float), x, metric)
        got = {}
        for r in index.search_join(queries, "vec_id", "vec_id", "embedding", 10, metric).collect():
            got.setdefault(r.query, set()).add(r.neighbour)
        recall = [len(got[q] & set(ids[np.argsort(d[i], kind="stable")[:10]].tolist())) / 10 for i, q in enumerate(asked)]
        assert np.mean(recall) >= 0.99
        for q in asked[:2]:
            assert {r.vec_id for r in index.search(rows[q], 10, metric, key="vec_id").collect()} == got[q]


def test_zero_and_broken_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [2.0, 0.0])], "id int, v array<float>")
    assert [(r.id, r.distance) for r in knn.knn(df, "v", [1.0, 0.0], 9, key="id").collect()] == [(6, 0.0), (1, 1.0)]


def candidates(spark, rows):
    return spark.createDataFrame([(1, i, i * 2.5, i * 2.5 + 5, song, ref * 2.5, ref * 2.5 + 5, score) for i, song, ref, score in rows], "query_id int, segment_index int, query_start_s double, query_end_s double, song_id int, reference_start_s double, reference_end_s double, score double")


def test_detection(spark):
    rows = [(1, 7, 4, 0.95), (2, 7, 5, 0.93), (3, 7, 6, 0.97), (4, 7, 7, 0.91), (0, 9, 1, 0.5), (2, 9, 30, 0.6)]
    (m,) = segments.detect(candidates(spark, rows)).collect()
    assert (m.song_id, m.query_start_s, m.query_end_s, m.reference_start_s, m.reference_end_s, m.similarity_pct, m.max_similarity_pct, m.segments) == (7, 2.5, 15.0, 10.0, 22.5, 94.0, 97.0, 4)
    assert segments.detect(candidates(spark, [(1, 7, 4, 0.95), (1, 8, 4, 0.94), (2, 7, 5, 0.9), (2, 8, 5, 0.89)])).count() == 0
    assert segments.detect(candidates(spark, [(1, 7, 4, 0.95), (4, 7, 7, 0.95)])).count() == 0
    line = {r.segment_index: r for r in segments.timeline(candidates(spark, rows)).collect()}
    assert line[2].best_song_id == 7 and line[0].above_threshold is False


def test_intervals(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 5.0), (2, 10.0), (3, 11.0), (4, 0.0)], "id int, d double")
    got = {}
    for r in segments.explode_intervals(df, "d").collect():
        got.setdefault(r.id, []).append((r.start_s, r.end_s))
    assert got == {0: [(0.0, 3.0)], 1: [(0.0, 5.0)], 2: [(0.0, 5.0), (2.5, 7.5), (5.0, 10.0)], 3: [(0.0, 5.0), (2.5, 7.5), (5.0, 10.0), (6.0, 11.0)]}


def test_identity(spark):
    hits = spark.createDataFrame([(1, 10, 1, 0.9), (1, 10, 2, 0.5), (1, 11, 3, 0.95), (1, 12, 4, 0.8), (2, 12, 5, 0.2), (2, None, 6, 0.99)], "query_id int, identity_id int, sample_id int, score double")
    people = spark.createDataFrame([(10, "participant", "granted"), (11, "participant", "withdrawn"), (12, "public_lfw", None)], "identity_id int, source string, consent_status string")
    got = {(r.query_id, r.identity_id): r.score for r in identity.candidates(hits, people).collect()}
    assert got == {(1, 10): 0.9}
    mean = {(r.query_id, r.identity_id): r.score for r in identity.candidates(hits, people, "mean_top", True).collect()}
    assert mean == pytest.approx({(1, 10): 0.7, (1, 12): 0.8, (2, 12): 0.2})
    decided = {r.query_id: (r.identity_id, r.status) for r in identity.decide(identity.candidates(hits, people, "max", True)).collect()}
    assert decided == {1: (10, "registered"), 2: (None, "unknown")}


def test_rates_and_recall(spark):
    s = spark.createDataFrame([(0.9, True), (0.4, True), (0.5, False), (0.1, False)], "score double, genuine boolean")
    got = {r.threshold: (r.tar, r.far) for r in evaluation.accept_rates(s, "score", "genuine", [0.45, 0.95]).collect()}
    assert got == {0.45: (0.5, 0.5), 0.95: (0.0, 0.0)}
    exact = spark.createDataFrame([(1, 1), (1, 2)], "q int, d int")
    assert evaluation.recall_against(exact, exact.where("d = 1"), "q", "d").first().recall == 0.5


def test_truncation_and_names(spark):
    long = "añb " * 10
    df = spark.createDataFrame([(long,), ("short",), ("ñ" * 20,), (None,)], "t string")
    got = [r[0] for r in df.select(tx.truncate_utf8(F.col("t"), 13)).collect()]
    assert got == ["añb añb", "short", "ñ" * 6, None]
    names = spark.createDataFrame([("/a/Mi Tabla-1.csv",), ("9x.CSV",), ("__.csv",)], "f string")
    assert [r[0] for r in names.select(tx.suggest_table_name(F.col("f"))).collect()] == ["mi_tabla_1", "t_9x", "t_"]


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.to_timestamp("ts").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = events.to_table(events.late_tolerant(stream, "ts", "1 hour", "6 hours", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = events.windowed(spark.read.parquet(str(tmp_path / "in")), F.window("ts", "6 hours"), "event_type")
    got, want = {tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).collect()}, {tuple(r)[:4] for r in batch.collect()}
    assert got <= want and len(got) > 0.8 * len(want)


def test_whole_boxes_hold_every_point(spark):
    sf = "/root/testdata/sf0.01"
    boxes = {r.c_nationkey: r for r in queries.QUERIES["mbr_by_nation_whole"](spark, sf).collect()}
    points = queries._points(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).collect()
    assert all(boxes[p.c_nationkey].west <= p.lon <= boxes[p.c_nationkey].east and boxes[p.c_nationkey].south <= p.lat <= boxes[p.c_nationkey].north for p in points)


def test_knn_join_takes_any_number_of_queries(spark):
    x = np.random.default_rng(5).normal(size=(20, 2))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    asked = spark.range(100_001).select("id", F.array(F.cos("id"), F.sin("id")).alias("v"))
    got = {r.query: r.neighbour for r in knn.knn_join(asked, base.withColumn("id", F.col("id").cast("long")), "id", "id", "v", 1).collect()}
    ids = np.arange(100_001)
    d = vx.np_distance(np.stack([np.cos(ids), np.sin(ids)], axis=1), x)
    assert len(got) == len(ids) and np.mean([got[i] == n for i, n in enumerate(d.argmin(axis=1).tolist())]) > 0.999


def test_knn_join_blocks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 60 * 64)
    d = vx.np_distance(x, x, "euclidean")
    got = {}
    for r in knn.knn_join(df, df, "id", "id", "v", 3, "euclidean").collect():
        got.setdefault(r.query, set()).add(r.neighbour)
    assert got == {i: set(np.argsort(d[i], kind="stable")[:3].tolist()) for i in range(200)}


@pytest.mark.parametrize("seed", range(4))
def test_radius_boxes_hold_the_circle(seed):
    rng = random.Random(seed)
    for _ in range(300):
        lon, lat = rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90), -90.0, 0.0])
        radius = rng.choice([0.0, 10 ** rng.uniform(0, 7.4)])
        boxes = sx.radius_boxes(lon, lat, radius)
        assert all(-180 <= w <= e <= 180 and -90 <= s <= n <= 90 for w, s, e, n in boxes)
        angle, d = rng.uniform(0, 2 * math.pi), radius / sx.EARTH_RADIUS_M * rng.random()
        # a point at a smaller distance, by the direct formula on the sphere
        f, g = math.radians(lat), math.radians(lon)
        y = math.asin(max(-1, min(1, math.sin(f) * math.cos(d) + math.cos(f) * math.sin(d) * math.cos(angle))))
        x = g + math.atan2(math.sin(angle) * math.sin(d) * math.cos(f), math.cos(d) - math.sin(f) * math.sin(y))
        px, py = (math.degrees(x) + 180) % 360 - 180, math.degrees(y)
        assert any(w - 1e-7 <= px <= e + 1e-7 and s - 1e-7 <= py <= n + 1e-7 for w, s, e, n in boxes), (lon, lat, radius)
    assert sx.radius_boxes(0, 0, math.inf) == sx.radius_boxes(5, 5, -1.0) == [(-180.0, -90.0, 180.0, 90.0)]
    assert sx.radius_boxes(179, 0, 2, "EUCLIDEAN") == [(177, -2, 180.0, 2)]


def test_of_overlapping_chains_the_longer_stays(spark):
    rows = [(i, 7, i + 3, 0.9) for i in range(1, 6)] + [(i, 7, i + 20, 0.95) for i in range(4, 7)] + [(i, 7, i + 40, 0.8) for i in range(9, 11)]
    got = {(r.query_start_s, r.segments, r.similarity_pct) for r in segments.detect(candidates(spark, rows)).collect()}
    assert got == {(2.5, 5, 90.0), (22.5, 2, 80.0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rare_decompositions_are_found_quickly(spark):
    # in parts of few ranges, so that most characters are passed over at once; the same characters as in one class
    pattern = tx._accents()[2]
    assert max(part.count("\\x{") // 2 for part in pattern.split("&&")) <= 18
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    known = set(tx._accents()[0])
    want = [c for c in chars if tx._plain(c) != c and c not in known]
    df = spark.createDataFrame([(c,) for c in chars if ord(c) < 0x3400 or 0xF900 <= ord(c) < 0x20000], "c string")
    assert sorted(r.c for r in df.where(F.col("c").rlike(pattern)).collect()) == sorted(c for c in want if ord(c) < 0x3400 or 0xF900 <= ord(c) < 0x20000)


def test_postings_are_counted_where_they_are_read(spark):
    rows = [(1, "uno DOS dos"), (2, None), (3, ""), (4, "ﬁn crème crème"), (1, "dos tres"), (None, "uno"), (None, "uno tres")]
    want = {("uno", 1): 1, ("dos", 1): 3, ("tres", 1): 1, ("fin", 4): 1, ("creme", 4): 2, ("uno", None): 2, ("tres", None): 1}
    for found, expected in ((rows, want), (rows[:4], {("uno", 1): 1, ("dos", 1): 2, ("fin", 4): 1, ("creme", 4): 2})):
        got = search.postings(spark.createDataFrame(found, "id long, t string"), "id", "t")
        assert {(r.term, r.doc): r.tf for r in got.collect()} == expected and got.count() == len(expected)
    assert "Exchange" not in plan(got)


def test_precision_reads_the_texts_once(spark):
    assert "documents.parquet" not in plan(queries.QUERIES["precision_recall_at_10"](spark, "/root/testdata/sf0.001"))


def test_customers_of_few_nations_are_dealt_out(spark):
    assert "REPARTITION_BY_NUM" in plan(queries.QUERIES["distance_column_target"](spark, "/root/testdata/sf0.001"))
