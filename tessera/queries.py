"""The registered queries: each in Spark beside the SQL that an oracle runs. Parameters stand in one place for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.apps import identity, segments
from tessera.functions import spatial as sx
from tessera.functions import text as tx
from tessera.functions import vector as vx
from tessera.operators import evaluation, knn, relational, search, spatial
from tessera.plans import views
from tessera.scratch import folder
from tessera.sources import csv as csv_source
from tessera.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TERMS = "the house of thing querky"
SECOND_QUERY = "la de que"
SPANISH_QUERY = "ción para los unknownterm para"
TARGET_ID = 7
CENTER, RADIUS_M, RADIUS_DEG = (5.0, -5.0), 2_500_000.0, 20.0
RING = ((-120.0, -40.0), (-20.0, -60.0), (40.0, 0.0), (10.0, 50.0), (-90.0, 30.0), (-120.0, -40.0))


def query(sql: str | None = None):
    """Registers a function of (tables) under its name, with its oracle."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- relational ----------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def scan_project(t):
    return t("region").select("r_regionkey", "r_name")


def _filters() -> None:
    for name, op in (("eq", "="), ("neq", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):

        def run(spark: SparkSession, sf_dir: str, op: str = op) -> DataFrame:
            return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(f"l_quantity {op} 25").select("l_orderkey", "l_linenumber", "l_quantity")

        QUERIES[f"filter_{name}"] = run
        ORACLES[f"filter_{name}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {op} 25"


_filters()


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax < l_discount")
def filter_col_col(t):
    return t("lineitem").where("l_tax < l_discount").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey = 42")
def index_scan_point(t):
    return t("orders").where("o_orderkey = 42").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200 ORDER BY o_orderkey")
def index_range(t):
    return t("orders").where("o_orderkey BETWEEN 100 AND 200").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")


@query("SELECT max(o_custkey) AS o_custkey FROM orders WHERE o_custkey <= 77")
def index_predecessor(t):
    return relational.predecessor(t("orders"), "o_custkey", 77)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def bitmap_semi(t):
    keys = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi_join(t("customer"), keys, "c_custkey").select("c_custkey", "c_name")


_JOIN_SQL = "SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"


def _joins() -> None:
    for name, strategy in (("join_hash", "hash"), ("join_sort_merge", "sort_merge"), ("join_nested_loop", "broadcast"), ("join_auto", None)):

        def run(spark: SparkSession, sf_dir: str, strategy: str | None = strategy) -> DataFrame:
            o, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
            return relational.equi_join(o, c, o["o_custkey"] == c["c_custkey"], strategy).select("o_orderkey", "c_name", "o_orderstatus")

        QUERIES[name], ORACLES[name] = run, _JOIN_SQL


_joins()


@query("SELECT c_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey")
def join_where_order(t):
    c, o = t("customer"), t("orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).where("o_totalprice > 200000").orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("c_name", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_group_agg(t):
    c, o = t("customer"), t("orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


def _summary() -> list:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")]


_SUMMARY = "count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last"


@query(f"SELECT {_SUMMARY} FROM lineitem")
def agg_global(t):
    return t("lineitem").agg(*_summary())


@query(f"SELECT l_returnflag, {_SUMMARY} FROM lineitem GROUP BY l_returnflag")
def agg_group(t):
    return t("lineitem").groupBy("l_returnflag").agg(*_summary())


@query(f"SELECT l_returnflag, l_linestatus, {_SUMMARY} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_multi(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(*_summary())


@query(f"SELECT l_suppkey, {_SUMMARY} FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey")
def agg_sorted(t):
    return t("lineitem").groupBy("l_suppkey").agg(*_summary()).orderBy("l_suppkey")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_first_value(t):
    return relational.first_values(t("orders"), ["o_custkey"], ["o_orderpriority"], "o_orderkey", F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def group_dedupe_first(t):
    return relational.first_row(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC NULLS FIRST, p_size DESC NULLS LAST, p_partkey")
def sort_multi_asc_desc(t):
    return t("part").select("p_partkey", "p_brand", "p_size").orderBy(relational.null_order("p_brand"), relational.null_order("p_size", False), "p_partkey")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t):
    return t("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def limit(t):
    return t("nation").orderBy("n_nationkey").limit(10).select("n_nationkey", "n_name")


@query("SELECT count(*) AS rows, count(v) AS present FROM (SELECT CASE WHEN l_quantity > 10 THEN l_quantity END AS v FROM lineitem)")
def count_nulls_ansi(t):
    v = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    return t("lineitem").select(v.alias("v")).agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("present"))


# ---- full text -----------------------------------------------------------------------------------------------------

_TOK = "SELECT doc_id, text, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL"


def _list(terms) -> str:
    return "[" + ", ".join(f"'{x}'" for x in terms) + "]"


def _bm25_sql(terms_of: str) -> str:
    """CTEs up to ``s(doc_id, score)``: BM25 over all documents, zero where no term occurs."""
    terms = _list(sorted(set(tx.tokenize(terms_of))))
    return f"""
    WITH tok AS ({_TOK}), corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
    tf AS (SELECT doc_id, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM tok, (SELECT unnest({terms}) AS term) q),
    df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
    s AS (SELECT doc_id, coalesce(sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) END), 0) AS score FROM tf JOIN df USING (term), corpus GROUP BY doc_id)
    """


_POSTINGS = f"WITH tok AS ({_TOK}), post AS (SELECT term, doc_id AS doc, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)"


def _tfidf_sql(terms_of: str) -> str:
    asked = tx.tokenize(terms_of)
    values = ", ".join(f"('{x}', {asked.count(x)})" for x in sorted(set(asked)))
    return f"""{_POSTINGS}, corpus AS (SELECT count(*) AS n FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), q(term, c) AS (VALUES {values}),
    w AS (SELECT doc, post.term, tf * ln(1 + n / df) AS w FROM post JOIN df USING (term), corpus), norms AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc),
    qw AS (SELECT q.term, c * ln(1 + n / df) AS qw FROM q JOIN df USING (term), corpus), qn AS (SELECT sqrt(sum(qw * qw)) AS qnorm FROM qw),
    s AS (SELECT doc, sum(w * qw) / (any_value(norm) * any_value(qnorm)) AS score FROM w JOIN qw USING (term) JOIN norms USING (doc), qn GROUP BY doc)
    """


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM ({_TOK})")
def tokenize_stats(t):
    toks = t("documents").where("text IS NOT NULL").select("doc_id", tx.tokens("text").alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"{_POSTINGS} SELECT term, doc, tf FROM post")
def postings(t):
    return search.postings(t("documents"), "doc_id", "text")


@query(f"{_POSTINGS}, corpus AS (SELECT count(*) AS n FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT doc, round(sqrt(sum(pow(tf * ln(1 + n / df), 2))), 6) AS norm, sum(tf)::BIGINT AS length FROM post JOIN df USING (term), corpus GROUP BY doc")
def doc_stats(t):
    posts = search.postings(t("documents"), "doc_id", "text")
    n = t("documents").where("text IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))
    stats = search.doc_norms(posts.crossJoin(F.broadcast(n)), F.col("n"), search.document_frequencies(posts), F.sum("tf").alias("length"))
    return stats.select("doc", F.round("norm", 6).alias("norm"), "length")


@query(f"SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM ({_TOK})")
def corpus_stats(t):
    return search.corpus_stats(t("documents"), "text", []).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"{_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term ORDER BY df DESC, term LIMIT 50")
def df_top_terms(t):
    posts = search.postings(t("documents"), "doc_id", "text")
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).orderBy(F.col("df").desc(), "term").limit(50)


@query(f"SELECT doc_id FROM ({_TOK}) WHERE list_has_any(t, {_list(tx.tokenize(SECOND_QUERY))})")
def match_or(t):
    return search.match(t("documents"), "text", SECOND_QUERY).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOK}) WHERE list_has_all(t, {_list(tx.tokenize(SECOND_QUERY))})")
def match_and(t):
    return search.match(t("documents"), "text", SECOND_QUERY, "and").select("doc_id")


@query(f"{_bm25_sql(TERMS)} SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 20")
def bm25_topk(t):
    scored = search.bm25(t("documents"), "text", TERMS).where("score > 0")
    return search.top_k(scored, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_bm25_sql(TERMS)} SELECT doc_id, round(score, 6) AS score FROM s")
def bm25_all_scores(t):
    return search.bm25(t("documents"), "text", TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_bm25_sql(SECOND_QUERY)} SELECT lang, count(*) FILTER (score > 0) AS hits, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM s JOIN documents USING (doc_id) GROUP BY lang")
def bm25_by_lang(t):
    scored = search.bm25(t("documents"), "text", SECOND_QUERY)
    return scored.groupBy("lang").agg(F.count(F.when(F.col("score") > 0, 1)).alias("hits"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"{_tfidf_sql(SPANISH_QUERY)} SELECT doc AS doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc LIMIT 20")
def tfidf_cosine_topk(t):
    found = search.tfidf_cosine(t("documents"), "doc_id", "text", SPANISH_QUERY)
    return search.top_k(found, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_tfidf_sql(SPANISH_QUERY)} SELECT doc AS doc_id, round(least(1, score), 6) AS score FROM s")
def tfidf_all_scores(t):
    return search.tfidf_cosine(t("documents"), "doc_id", "text", SPANISH_QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_bm25_sql('para que')} SELECT doc_id, round(score, 6) AS score, score = 0 AS unmatched FROM s")
def score_without_match(t):
    return search.bm25(t("documents"), "text", "para que").select("doc_id", F.round("score", 6).alias("score"), (F.col("score") == 0).alias("unmatched"))


@query(f"{_bm25_sql(TERMS)} SELECT doc_id, round(score, 6) AS score FROM s JOIN tok USING (doc_id) WHERE list_has_any(t, {_list(tx.tokenize(SECOND_QUERY))})")
def match_score_other_query(t):
    return search.match(search.bm25(t("documents"), "text", TERMS), "text", SECOND_QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_bm25_sql(TERMS)} SELECT doc_id, quality, toxic, round(score, 6) AS score FROM s JOIN labels USING (doc_id) WHERE score > 0 AND quality = 1 ORDER BY s.score DESC, doc_id LIMIT 10")
def search_join_labels(t):
    scored = search.bm25(t("documents"), "text", TERMS).where("score > 0").join(t("labels").where("quality = 1"), "doc_id")
    return search.top_k(scored, "doc_id", 10).select("doc_id", "quality", "toxic", F.round("score", 6).alias("score"))


_PR = [("q1", "the of thing"), ("q2", "la de"), ("q3", "und der"), ("q4", "para los")]


@query(
    " UNION ALL ".join(
        f"""SELECT * FROM ({_bm25_sql(q)}, top AS (SELECT doc_id FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10), rel AS (SELECT doc_id FROM tok WHERE list_has_all(t, {_list(sorted(set(tx.tokenize(q))))})),
        h AS (SELECT count(*) AS hits FROM top WHERE doc_id IN (SELECT doc_id FROM rel)), r AS (SELECT count(*) AS n FROM rel)
        SELECT '{name}' AS query, hits, n AS n_relevant, hits / 10 AS precision, CASE WHEN n > 0 THEN round(hits / n, 6) END AS recall FROM h, r)"""
        for name, q in _PR
    )
)
def precision_recall_at_10(t):
    found = search.bm25_batch(t("documents"), "doc_id", "text", _PR)
    ranked = evaluation.rank_by(found.where("score > 0"), "query", F.col("score").desc(), F.col("doc_id")).where("rank <= 10")
    relevant = found.where("every")
    return evaluation.precision_recall(ranked, relevant, "query", "doc_id", 10).withColumn("recall", F.round("recall", 6))


@query()
def truncate_text(t):
    return t("documents").select("doc_id", F.octet_length(tx.truncate_utf8(F.col("text"), 600)).alias("n_bytes"))


# ---- vectors -------------------------------------------------------------------------------------------------------

_BASE = f"WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = {TARGET_ID})"
_DISTANCE = {"cosine": "1 - list_cosine_similarity(v, qv)", "euclidean": "list_distance(v, qv)", "dot_product": "-list_inner_product(v, qv)"}
_SCORE = {"cosine": "1 - d", "euclidean": "1 / (1 + d)", "dot_product": "-d"}


def _target(t) -> list[float]:
    return t("embeddings").where(F.col("vec_id") == TARGET_ID).first()["embedding"]


def _knn_queries() -> None:
    for name, metric in (("knn_cosine", "cosine"), ("knn_euclidean", "euclidean"), ("knn_dot", "dot_product")):

        def run(spark: SparkSession, sf_dir: str, metric: str = metric) -> DataFrame:
            t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
            near = knn.knn(t("embeddings"), "embedding", _target(t), 10, metric, "vec_id")
            return near.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))

        QUERIES[name] = run
        ORACLES[name] = f"{_BASE}, d AS (SELECT vec_id, {_DISTANCE[metric]} AS d FROM e, q) SELECT vec_id, round(d, 6) AS distance, round({_SCORE[metric]}, 6) AS score FROM d ORDER BY d.d, vec_id LIMIT 10"


_knn_queries()


@query(f"{_BASE}, h AS (SELECT label, {_SCORE['cosine'].replace('d', '(' + _DISTANCE['cosine'] + ')')} AS s FROM e, q WHERE vec_id <> {TARGET_ID}) SELECT label, round(max(s), 6) AS best, count(*) AS n FROM h GROUP BY label")
def knn_by_label_vote(t):
    near = knn.with_distance(t("embeddings").where(F.col("vec_id") != TARGET_ID), "embedding", _target(t))
    return near.groupBy("label").agg(F.round(F.max("score"), 6).alias("best"), F.count(F.lit(1)).alias("n"))


@query(f"{_BASE}, h AS (SELECT vec_id, label, list_cosine_similarity(v, qv) AS s FROM e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM h) SELECT label AS identity_id, round(avg(s) FILTER (n <= 3), 6) AS score, round(max(s), 6) AS best_sample_score, count(*) AS matched_samples FROM r WHERE label % 4 <> 1 GROUP BY label")
def knn_mean_top3(t):
    hits = knn.with_distance(t("embeddings"), "embedding", _target(t)).select(F.lit(1).alias("query_id"), F.col("label").alias("identity_id"), F.col("vec_id").alias("sample_id"), "score")
    people = t("embeddings").select(F.col("label").alias("identity_id")).distinct()
    people = people.select("identity_id", F.lit("participant").alias("source"), F.when(F.col("identity_id") % 4 == 1, "withdrawn").otherwise("granted").alias("consent_status"))
    found = identity.candidates(hits, people, "mean_top")
    return found.select("identity_id", F.round("score", 6).alias("score"), F.round("best_sample_score", 6).alias("best_sample_score"), "matched_samples")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 9), neighbour) AS n FROM p) SELECT query, neighbour, round(d, 6) AS distance FROM r WHERE n <= 5")
def knn_join(t):
    e = t("embeddings")
    return knn.knn_join(e.where("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", 5).select("query", "neighbour", F.round("distance", 6).alias("distance"))


@query(f"{_BASE} SELECT vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM e, q WHERE list_cosine_similarity(v, qv) >= 0.45")
def knn_range(t):
    return knn.within(t("embeddings"), "embedding", _target(t), 0.45).select("vec_id", F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM e")
def vector_norms(t):
    v = F.col("embedding")
    return t("embeddings").select("vec_id", F.round(vx.norm(v), 6).alias("norm"), F.round(F.get(vx.normalized(v), F.lit(0)), 6).alias("first"))


@query("WITH w AS (SELECT vec_id, unnest([CAST(floor(x * 40) AS BIGINT) FOR x IN embedding::DOUBLE[]]) AS word FROM embeddings), c AS (SELECT vec_id, word, count(*) AS c FROM w GROUP BY ALL), tot AS (SELECT vec_id, sum(c) AS t FROM c GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM c GROUP BY ALL), n AS (SELECT count(*) AS n FROM tot), x AS (SELECT vec_id, word, c / t * (ln((n + 1) / (df + 1)) + 1) AS w FROM c JOIN tot USING (vec_id) JOIN df USING (word), n), y AS (SELECT vec_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY ALL) SELECT vec_id, word, round(w / norm, 6) AS weight FROM x JOIN y USING (vec_id)")
def bow_tfidf(t):
    words = t("embeddings").select("vec_id", F.explode(F.transform("embedding", lambda x: F.floor(x.cast("double") * 40))).alias("word"))
    return knn.bow_tfidf(words, "vec_id", "word").select("vec_id", "word", F.round("weight", 6).alias("weight"))


@query("SELECT vec_id, len(embedding) AS dims, true AS same FROM embeddings")
def json_vector_decode(t):
    e = t("embeddings").withColumn("back", vx.from_json(F.to_json("embedding")))
    return e.select("vec_id", F.size("back").cast("long").alias("dims"), (F.col("back") == F.col("embedding")).alias("same"))


@query("SELECT vec_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def bytes_vector_decode(t):
    e = t("embeddings").withColumn("raw", vx.to_bytes("embedding"))
    return e.select("vec_id", F.octet_length("raw").cast("long").alias("bytes"), (vx.from_bytes("raw") == F.col("embedding")).alias("same"))


# ---- spatial -------------------------------------------------------------------------------------------------------

_POINTS = "SELECT c_custkey, c_nationkey, (c_custkey * 37 % 36000) / 100.0 - 180 AS lon, (c_custkey * 53 % 18000) / 100.0 - 90 AS lat FROM customer"


def _points(t) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", "c_nationkey", (k * 37 % 36000 / 100.0 - 180).alias("lon"), (k * 53 % 18000 / 100.0 - 90).alias("lat"))


def _haversine_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"2 * {sx.EARTH_RADIUS_M} * asin(sqrt(least(1, pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


_TO_CENTER = _haversine_sql("lon", "lat", str(CENTER[0]), str(CENTER[1]))
_PLANAR = f"sqrt(pow(lon - ({CENTER[0]}), 2) + pow(lat - ({CENTER[1]}), 2))"


@query(f"SELECT c_custkey, round({_TO_CENTER}, 3) AS distance FROM ({_POINTS}) WHERE {_TO_CENTER} <= {RADIUS_M}")
def radius_haversine(t):
    return spatial.radius(_points(t), "lon", "lat", CENTER, RADIUS_M).select("c_custkey", F.round("distance", 3).alias("distance"))


@query(f"SELECT c_custkey, round({_PLANAR}, 6) AS distance FROM ({_POINTS}) WHERE {_PLANAR} < {RADIUS_DEG}")
def radius_euclidean(t):
    return spatial.radius(_points(t), "lon", "lat", CENTER, RADIUS_DEG, "EUCLIDEAN", "<").select("c_custkey", F.round("distance", 6).alias("distance"))


@query(f"SELECT c_custkey FROM ({_POINTS}) WHERE {_TO_CENTER} > {4 * RADIUS_M}")
def radius_gt(t):
    return spatial.radius(_points(t), "lon", "lat", CENTER, 4 * RADIUS_M, op=">").select("c_custkey")


@query(f"SELECT c_custkey, round({_haversine_sql('lon', 'lat', '179.5', '60')}, 3) AS distance FROM ({_POINTS}) WHERE {_haversine_sql('lon', 'lat', '179.5', '60')} <= 1500000")
def radius_date_line(t):
    return spatial.radius(_points(t), "lon", "lat", (179.5, 60.0), 1_500_000.0).select("c_custkey", F.round("distance", 3).alias("distance"))


@query(f"SELECT c_custkey, round({_TO_CENTER}, 3) AS distance FROM ({_POINTS}) ORDER BY {_TO_CENTER}, c_custkey LIMIT 15")
def spatial_knn(t):
    return spatial.nearest(_points(t), "lon", "lat", CENTER, 15, ties=["c_custkey"]).select("c_custkey", F.round("distance", 3).alias("distance"))


@query(f"SELECT c_custkey, c_nationkey, round(sqrt(pow(floor(lon / 30), 2) + pow(floor(lat / 30), 2)), 6) AS distance FROM ({_POINTS}) ORDER BY sqrt(pow(floor(lon / 30), 2) + pow(floor(lat / 30), 2)), c_nationkey, c_custkey LIMIT 20")
def spatial_knn_tiebreak(t):
    cells = _points(t).withColumn("x", F.floor(F.col("lon") / 30).cast("double")).withColumn("y", F.floor(F.col("lat") / 30).cast("double"))
    return spatial.nearest(cells, "x", "y", (0.0, 0.0), 20, "EUCLIDEAN", ["c_nationkey", "c_custkey"]).select("c_custkey", "c_nationkey", F.round("distance", 6).alias("distance"))


def _ring_sql() -> str:
    crossings = " + ".join(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < {x1} + (lat - ({y1})) * ({x2} - ({x1})) / ({y2} - ({y1})) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:], strict=False))
    edges = " OR ".join(f"(({x2} - ({x1})) * (lat - ({y1})) - ({y2} - ({y1})) * (lon - ({x1})) = 0 AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)})" for (x1, y1), (x2, y2) in zip(RING, RING[1:], strict=False))
    return f"(({crossings}) % 2 = 1 OR {edges})"


@query(f"SELECT c_custkey, lon, lat FROM ({_POINTS}) WHERE {_ring_sql()}")
def within_polygon(t):
    return spatial.within_polygon(_points(t), "lon", "lat", RING).select("c_custkey", "lon", "lat")


@query(f"SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({_POINTS})")
def mbr_extent(t):
    return _points(t).agg(*sx.mbr("lon", "lat"))


_BOXES = f"SELECT c_nationkey, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({_POINTS} WHERE c_custkey % 7 = 0) GROUP BY c_nationkey"


def _boxes(t) -> DataFrame:
    return _points(t).where("c_custkey % 7 = 0").groupBy("c_nationkey").agg(*sx.mbr("lon", "lat"))


def _whole_boxes(t) -> DataFrame:
    return _points(t).groupBy("c_nationkey").agg(*sx.mbr("lon", "lat"))


def _areas(boxes: DataFrame) -> DataFrame:
    box = [F.col(c) for c in ("west", "south", "east", "north")]
    return boxes.withColumn("area", F.round(sx.box_area(box), 4))


def _meeting(boxes: DataFrame) -> DataFrame:
    names = ("west", "south", "east", "north")
    a = boxes.select(F.col("c_nationkey").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = boxes.select(F.col("c_nationkey").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    pa, pb = [F.col(f"a_{c}") for c in names], [F.col(f"b_{c}") for c in names]
    return a.join(b, (F.col("a") < F.col("b")) & sx.boxes_intersect(pa, pb)).select("a", "b", sx.box_contains(pa, pb).alias("holds"))


@query(f"SELECT c_nationkey, west, south, east, north, round((east - west) * (north - south), 4) AS area FROM ({_BOXES})")
def mbr_by_nation(t):
    return _areas(_boxes(t))


@query(f"WITH b AS ({_BOXES}) SELECT a.c_nationkey AS a, b.c_nationkey AS b, a.west <= b.west AND a.south <= b.south AND a.east >= b.east AND a.north >= b.north AS holds FROM b a, b WHERE a.c_nationkey < b.c_nationkey AND a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north")
def mbr_intersects(t):
    return _meeting(_boxes(t))


_WHOLE_BOXES = f"SELECT c_nationkey, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({_POINTS}) GROUP BY c_nationkey"


@query(f"SELECT c_nationkey, west, south, east, north, round((east - west) * (north - south), 4) AS area FROM ({_WHOLE_BOXES})")
def mbr_by_nation_whole(t):
    return _areas(_whole_boxes(t))


@query(f"WITH b AS ({_WHOLE_BOXES}) SELECT a.c_nationkey AS a, b.c_nationkey AS b, a.west <= b.west AND a.south <= b.south AND a.east >= b.east AND a.north >= b.north AS holds FROM b a, b WHERE a.c_nationkey < b.c_nationkey AND a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north")
def mbr_intersects_whole(t):
    return _meeting(_whole_boxes(t))


@query("WITH p AS (SELECT c_custkey, (c_custkey * 37 % 360) - 180 AS x, (c_custkey * 53 % 180) - 90 AS y FROM customer) SELECT c_custkey, round((x + x + 1 + x + 2) / 3, 6) AS lon, round((y + y + 3 + y + 1) / 3, 6) AS lat FROM p")
def centroid_polygon(t):
    k = F.col("c_custkey")
    x, y = (k * 37 % 360 - 180).cast("double"), (k * 53 % 180 - 90).cast("double")
    at = lambda dx, dy: F.struct((x + dx).alias("lon"), (y + dy).alias("lat"))
    c = sx.ring_centroid(F.array(at(0, 0), at(1, 3), at(2, 1), at(0, 0)))
    return t("customer").select("c_custkey", c.alias("c")).select("c_custkey", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query(f"SELECT c_custkey, n_name, round({_TO_CENTER}, 3) AS distance FROM ({_POINTS}) JOIN nation ON c_nationkey = n_nationkey WHERE {_TO_CENTER} <= {RADIUS_M}")
def join_spatial_filter(t):
    joined = _points(t).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return spatial.radius(joined, "lon", "lat", CENTER, RADIUS_M).select("c_custkey", "n_name", F.round("distance", 3).alias("distance"))


@query(f"WITH s AS (SELECT s_suppkey, s_nationkey, (s_suppkey * 41 % 36000) / 100.0 - 180 AS slon, (s_suppkey * 59 % 18000) / 100.0 - 90 AS slat FROM supplier) SELECT c_custkey, s_suppkey, round({_haversine_sql('lon', 'lat', 'slon', 'slat')}, 3) AS distance FROM ({_POINTS}) JOIN s ON c_nationkey = s_nationkey")
def distance_column_target(t):
    k = F.col("s_suppkey")
    s = t("supplier").select("s_suppkey", "s_nationkey", (k * 41 % 36000 / 100.0 - 180).alias("slon"), (k * 59 % 18000 / 100.0 - 90).alias("slat"))
    # a small file would be one task, and nations are few: dealt by a fixed number, which adaptive execution does not merge
    points = _points(t)
    points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    joined = points.join(s, F.col("c_nationkey") == F.col("s_nationkey"))
    return joined.select("c_custkey", "s_suppkey", F.round(sx.haversine("lon", "lat", F.col("slon"), F.col("slat")), 3).alias("distance"))


# ---- changes, loading, dataflows -----------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), NULL FROM nation WHERE n_regionkey = 1")
def dml_insert_select(t):
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    more = n.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.upper("n_name").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))
    return n.unionByName(more)


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE p_brand END AS p_brand FROM part")
def dml_update(t):
    return t("part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise(F.col("p_brand")).alias("p_brand"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def dml_delete(t):
    return t("orders").where(~F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1")
def unique_violation_check(t):
    return relational.duplicates(t("orders"), ["o_custkey"])


@query("WITH d AS (SELECT p_partkey, (p_partkey * 7 % 200) / 10.0 + 0.3 AS dur FROM part), n AS (SELECT *, CAST(floor((dur - 5 + 1e-9) / 2.5) AS INT) AS n FROM d), g AS (SELECT p_partkey, dur, i AS segment_index, CASE WHEN dur <= 5 THEN 0 WHEN i <= n THEN i * 2.5 ELSE dur - 5 END AS s, CASE WHEN dur <= 5 THEN dur WHEN i <= n THEN i * 2.5 + 5 ELSE dur END AS e FROM n, LATERAL (SELECT unnest(range(0, CASE WHEN dur <= 5 THEN 1 WHEN n * 2.5 + 5 < dur - 1e-9 THEN n + 2 ELSE n + 1 END)) AS i)) SELECT p_partkey, segment_index::INT AS segment_index, round(s::DOUBLE, 3) AS start_s, round(e::DOUBLE, 3) AS end_s FROM g")
def segment_intervals(t):
    d = t("part").select("p_partkey", (F.col("p_partkey") * 7 % 200 / 10.0 + 0.3).alias("dur"))
    return segments.explode_intervals(d, "dur").select("p_partkey", "segment_index", "start_s", "end_s")


_EV = "SELECT user_id, event_id, event_type, value, epoch(ts) AS s, epoch(ts) + 60 + event_id % 7 * 600 AS e FROM events"


def _spans(t) -> DataFrame:
    s = F.unix_micros(F.to_timestamp("ts")) / 1e6
    return t("events").select("user_id", "event_id", "event_type", "value", s.alias("s"), (s + 60 + F.col("event_id") % 7 * 600).alias("e"))


@query(f"WITH v AS ({_EV}), w AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v), m AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS run FROM w) SELECT user_id, round(min(s), 3) AS s, round(max(e), 3) AS e, count(*) AS n FROM m GROUP BY user_id, run")
def chain_gaps_islands(t):
    found = segments.islands(_spans(t), ["user_id"], "s", "e", 3600.0)
    return found.select("user_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), "n")


@query(f"WITH v AS ({_EV}), w AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v) SELECT event_type, round(sum(CASE WHEN reach IS NULL OR s > reach THEN e - s WHEN e > reach THEN e - reach ELSE 0 END), 2) AS covered FROM w GROUP BY event_type")
def interval_coverage(t):
    return segments.coverage(_spans(t), ["event_type"], "s", "e").select("event_type", F.round("covered", 2).alias("covered"))


@query("WITH b AS (SELECT user_id, event_type, max(value) AS best FROM events GROUP BY ALL) SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE e.value - coalesce((SELECT max(best) FROM b WHERE b.user_id = e.user_id AND b.event_type <> e.event_type), -1e300) >= 0.03 - 1e-9")
def margin_filter(t):
    e = t("events").select("event_id", "user_id", "event_type", "value")
    return segments.beats_others(e, ["user_id"], "event_type", "value", 0.03).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(v := value, i := event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id, event_type")
def merge_best_candidate(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.max("value").alias("value"))


@query()
def detect_chains(t):
    e = _spans(t).withColumn("i", (F.col("event_id") / 4).cast("int"))
    c = e.select(F.col("user_id").alias("query_id"), F.col("i").alias("segment_index"), (F.col("i") * 2.5).alias("query_start_s"), (F.col("i") * 2.5 + 5).alias("query_end_s"), F.col("event_type").alias("song_id"), (F.col("i") * 2.5 + 7.5).alias("reference_start_s"), (F.col("i") * 2.5 + 12.5).alias("reference_end_s"), F.least(F.lit(1.0), F.abs("value") / 100).alias("score"))
    return segments.detect(c, segments.Settings(max_gap=50))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'CC0' WHEN p_partkey % 5 = 1 THEN 'CC BY' WHEN p_partkey % 5 = 2 THEN 'CC BY-NC-SA' END AS family FROM part")
def license_families(t):
    urls = ["http://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/licenses/by/4.0", " HTTP://CREATIVECOMMONS.ORG/licenses/by-nc-sa/3.0/us/", "http://creativecommons.org/licenses/by-nd/4.0", "http://example.com"]
    url = F.get(F.array(*map(F.lit, urls)), (F.col("p_partkey") % 5).cast("int"))
    return t("part").select("p_partkey", tx.license_family(url).alias("family"))


# ---- extensions: windows over events -------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(t):
    found = events.windowed(t("events"), F.window("ts", "1 hour"), "event_type")
    return found.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - to_minutes(30 * k::INT) AS window_start, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT window_start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY window_start")
def ext_sliding(t):
    found = events.windowed(t("events"), F.window("ts", "1 hour", "30 minutes"))
    return found.select("window_start", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events), m AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM w) SELECT user_id, min(ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY user_id, run")
def ext_session(t):
    found = events.windowed(t("events"), F.session_window("ts", "2 hours"), "user_id")
    return found.select("user_id", "window_start", "n", F.round("total", 4).alias("total"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def ext_set_union(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders")
def ext_window_functions(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("nth"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"))


# ---- the dialect, and stored indexes -------------------------------------------------------------------------------


def _dialect(name: str, text: str, oracle: str, tables: dict[str, str | None]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
        found = {n: (read(n), key) for n, key in tables.items() if n != "places"}
        if "places" in tables:
            found["places"] = (_points(read).select("c_custkey", "c_nationkey", F.struct("lon", "lat").alias("spot")), "c_custkey")
        out = views.sql(spark, text, found)
        return out.select(*[(F.round(c, 6) if kind == "double" else F.col(f"`{c}`")).alias(c.rpartition(".")[2]) for c, kind in out.dtypes if not kind.startswith("struct")])

    QUERIES[name], ORACLES[name] = run, oracle


_dialect("dialect_filter", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 40 ORDER BY p_brand DESC, p_partkey LIMIT 30", "SELECT p_partkey, p_brand FROM part WHERE p_size >= 40 ORDER BY p_brand DESC, p_partkey LIMIT 30", {"part": "p_partkey"})
_dialect("dialect_join", "SELECT customer.c_name, orders.o_orderkey FROM customer JOIN orders ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderstatus = 'P'", "SELECT c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'", {"customer": "c_custkey", "orders": "o_orderkey"})
_dialect("dialect_group", "SELECT p_brand, COUNT(*), MIN(p_size), MAX(p_size) FROM part GROUP BY p_brand ORDER BY p_brand", 'SELECT p_brand, count(*) AS "COUNT(*)", min(p_size) AS "MIN(p_size)", max(p_size) AS "MAX(p_size)" FROM part GROUP BY p_brand', {"part": "p_partkey"})
_dialect("dialect_match_score", f"SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, '{TERMS}') ORDER BY score DESC, doc_id LIMIT 20", ORACLES["bm25_topk"], {"documents": "doc_id"})
_dialect("dialect_tfidf", f"SELECT doc_id, SCORE() AS score FROM documents WHERE MATCH(text, '{SPANISH_QUERY}') USING TF_IDF ORDER BY score DESC LIMIT 20", ORACLES["tfidf_cosine_topk"], {"documents": "doc_id"})
_dialect("dialect_radius", f"SELECT c_custkey FROM places WHERE DISTANCIA(spot, POINT({CENTER[0]}, {CENTER[1]})) <= {RADIUS_M}", f"SELECT c_custkey FROM ({_POINTS}) WHERE {_TO_CENTER} <= {RADIUS_M}", {"places": "c_custkey"})
_dialect("dialect_nearest", f"SELECT c_custkey FROM places ORDER BY DISTANCIA(spot, POINT({CENTER[0]}, {CENTER[1]})), c_custkey LIMIT 12", f"SELECT c_custkey FROM ({_POINTS}) ORDER BY {_TO_CENTER}, c_custkey LIMIT 12", {"places": "c_custkey"})
_dialect("dialect_within", f"SELECT c_custkey FROM places WHERE DENTRO_DE(spot, POLYGON({', '.join(f'POINT({x}, {y})' for x, y in RING)}))", f"SELECT c_custkey FROM ({_POINTS}) WHERE {_ring_sql()}", {"places": "c_custkey"})


@query(ORACLES["bm25_topk"])
def text_index_bm25(t):
    docs = t("documents")
    index = search.TextIndex.build(docs, "doc_id", "text", folder(docs.sparkSession, "text-index"))
    return search.top_k(index.search(TERMS), "doc", 20).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(ORACLES["tfidf_cosine_topk"])
def text_index_tfidf(t):
    docs = t("documents")
    index = search.TextIndex.build(docs, "doc_id", "text", folder(docs.sparkSession, "text-index"))
    return search.top_k(index.search(SPANISH_QUERY, "tf_idf"), "doc", 20).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(ORACLES["radius_haversine"])
def grid_index_radius(t):
    pts = _points(t)
    grid = spatial.GridIndex.build(pts, "lon", "lat", folder(pts.sparkSession, "grid"), 30.0)
    return grid.radius(CENTER, RADIUS_M).select("c_custkey", F.round("distance", 3).alias("distance"))


@query()
def ivf_search(t):
    e = t("embeddings")
    index = knn.IvfIndex.build(e, "embedding", folder(e.sparkSession, "ivf"))
    return index.search(_target(t), 10, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(ORACLES["knn_join"].replace("n <= 5", "n <= 10"))
def ivf_search_join(t):
    e = t("embeddings")
    index = knn.IvfIndex.build(e, "embedding", folder(e.sparkSession, "ivf"))
    return index.search_join(e.where("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", 10).select("query", "neighbour", F.round("distance", 6).alias("distance"))


@query("SELECT p_partkey::INT AS p_partkey, p_brand, p_size, p_retailprice FROM part")
def csv_infer(t):
    part = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    path = folder(part.sparkSession, "csv")
    part.coalesce(1).write.csv(path, header=True)
    return csv_source.load(part.sparkSession, path).rows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search joined with labels: scan, tokens, corpus statistics, broadcast row, score, join, top k."""
    return QUERIES["search_join_labels"](spark, sf_dir)
