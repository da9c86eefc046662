"""Full-text search: matching, BM25 and TF-IDF ranking, by expressions or by a stored index.

Without an index, one pass over the texts gives the corpus statistics of the query's terms (a row of them), which
crosses the second pass as a broadcast row; texts themselves are never shuffled. An index holds the postings
sorted by term, the documents' lengths and norms, and the corpus statistics as Parquet tables, so that a query reads
its terms' row groups alone. A null text is no document; an empty one counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions import text as tx
from tessera.scratch import folder

METHODS = ("bm25", "tf_idf")


def query_terms(query: str, stop: Sequence[str] = ()) -> list[str]:
    terms = tx.tokenize(query, stop)
    if not terms:
        raise QueryError("the query has no term that can be searched")
    return terms


def match(df: DataFrame, text: str, query: str, mode: str = "or", stop: Sequence[str] = ()) -> DataFrame:
    """Documents with any (or, with mode 'and', every) term of the query."""
    terms = sorted(set(query_terms(query, stop)))
    toks = tx.tokens(text, stop)
    if mode == "or":
        return df.where(F.arrays_overlap(toks, F.array(*map(F.lit, terms))))
    return df.where(F.size(F.array_intersect(toks, F.array(*map(F.lit, terms)))) == len(terms))


def _frequencies(terms: Sequence[str]) -> list[Column]:
    return [tx.term_frequency(F.col("_toks"), t).alias(f"_tf{i}") for i, t in enumerate(terms)]


def corpus_stats(df: DataFrame, text: str, terms: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """One row: n, avgdl, and df0, df1, ... of the terms."""
    rows = df.where(F.col(text).isNotNull()).select(tx.tokens(text, stop).alias("_toks")).select(F.size("_toks").alias("_len"), *_frequencies(terms))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avgdl"), *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])


def bm25(df: DataFrame, text: str, query: str, alias: str = "score", stop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the BM25 score of each row's text, 0 where no term occurs or the text is null."""
    terms = sorted(set(query_terms(query, stop)))
    stats = corpus_stats(df, text, terms, stop)
    scored = df.withColumn("_toks", tx.tokens(text, stop)).select(*df.columns, F.size("_toks").alias("_len"), *_frequencies(terms)).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for i in range(len(terms)):
        total = total + tx.bm25_weight(F.col(f"_tf{i}"), F.col("_len"), F.col("avgdl"), tx.bm25_idf(F.col("n"), F.col(f"df{i}")))
    return scored.select(*df.columns, F.coalesce(total, F.lit(0.0)).alias(alias))


def bm25_batch(df: DataFrame, key: str, text: str, queries: Sequence[tuple[str, str]]) -> DataFrame:
    """(query, key, score, every) of each document and each named query: its BM25 score, and whether it has every term. Texts are read once for all."""
    asked = [(name, sorted(set(query_terms(q)))) for name, q in queries]
    terms = sorted({t for _, ts in asked for t in ts})
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias(key), tx.counts(F.col(text), terms).alias("_c"))
    rows = _stored(rows, "counts").select(key, F.get("_c", F.lit(0)).alias("_len"), *[F.get("_c", F.lit(i + 1)).alias(f"_tf{i}") for i in range(len(terms))])
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avgdl"), *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(terms))])
    found = []
    for name, ts in asked:
        at = [terms.index(t) for t in ts]
        total, every = F.lit(0.0), F.lit(True)
        for i in at:
            total = total + tx.bm25_weight(F.col(f"_tf{i}"), F.col("_len"), F.col("_avgdl"), tx.bm25_idf(F.col("_n"), F.col(f"_df{i}")))
            every = every & (F.col(f"_tf{i}") > 0)
        found.append(F.struct(F.lit(name).alias("query"), total.alias("score"), every.alias("every")))
    return rows.crossJoin(F.broadcast(stats)).select(key, F.explode(F.array(*found)).alias("f")).select("f.query", key, "f.score", "f.every")


def postings(df: DataFrame, key: str, text: str, stop: Sequence[str] = ()) -> DataFrame:
    """(term, doc, tf). A document's counts are made where it is read; only rows that share a key are shuffled, to be added up."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))

    def counted(found: DataFrame) -> DataFrame:
        return tx.bags(found.select("doc", "text"), stop)

    repeated = _stored(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc").alias("again")), "repeated")
    if repeated.isEmpty():
        return counted(rows)
    same = F.col("doc").eqNullSafe(F.col("again"))
    more = counted(rows.join(repeated, same, "left_semi")).groupBy("term", "doc").agg(F.sum("tf").alias("tf"))
    return counted(rows.join(repeated, same, "left_anti")).unionByName(more)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A derived table as a file, so that its size is known when a join is planned."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_frequencies(posts: DataFrame) -> DataFrame:
    """(term, df), stored: added up in the tasks that count, and broadcast to the postings if it is small."""
    return _stored(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")


def doc_lengths(df: DataFrame, key: str, text: str, stop: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.size(tx.tokens(text, stop)).cast("long").alias("len"))


def doc_norms(posts: DataFrame, n: Column | int, frequencies: DataFrame, *more: Column) -> DataFrame:
    """(doc, norm) of TF-IDF vectors over all terms, and further aggregates of a document's postings."""
    count = n if isinstance(n, Column) else F.lit(n)
    w = F.col("tf") * tx.tfidf_idf(count, F.col("df"))
    return posts.join(frequencies, "term").groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm"), *more)


def tfidf_cosine(df: DataFrame, key: str, text: str, query: str, alias: str = "score", stop: Sequence[str] = ()) -> DataFrame:
    """(key, score) of the documents that share a term with the query; repeats of a term in the query count."""
    counts = Counter(query_terms(query, stop))
    posts = postings(df, key, text, stop)
    frequencies = document_frequencies(posts)
    n = df.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    return _cosine(posts, frequencies, n, None, counts).select(F.col("doc").alias(key), F.col("score").alias(alias))


def _cosine(posts: DataFrame, frequencies: DataFrame, n: DataFrame, norms: DataFrame | None, counts: Counter) -> DataFrame:
    """(doc, score); without ``norms`` they come from the same pass over the postings."""
    weighted = posts.join(frequencies, "term").crossJoin(F.broadcast(n)).withColumn("_idf", tx.tfidf_idf(F.col("n"), F.col("df")))
    asked = F.create_map(*[F.lit(x) for t, c in sorted(counts.items()) for x in (t, float(c))])
    q = F.coalesce(F.try_element_at(asked, F.col("term")), F.lit(0.0)) * F.col("_idf")
    qterms = F.col("term").isin(sorted(counts))
    # the query's own norm comes from the same rows: one per term and document
    qnorm = frequencies.where(qterms).crossJoin(F.broadcast(n)).agg(F.sqrt(F.sum(F.pow(F.try_element_at(asked, F.col("term")) * tx.tfidf_idf(F.col("n"), F.col("df")), F.lit(2)))).alias("_qnorm"))
    dots = weighted.groupBy("doc").agg(F.sum(q * F.col("tf") * F.col("_idf")).alias("_dot"), F.sqrt(F.sum(F.pow(F.col("tf") * F.col("_idf"), F.lit(2)))).alias("_norm"), F.max(qterms).alias("_hit")) if norms is None else weighted.where(qterms).groupBy("doc").agg(F.sum(q * F.col("tf") * F.col("_idf")).alias("_dot"), F.lit(True).alias("_hit")).join(norms.withColumnRenamed("norm", "_norm"), "doc")
    cos = F.col("_dot") / (F.col("_norm") * F.col("_qnorm"))
    return dots.where("_hit").crossJoin(F.broadcast(qnorm)).select("doc", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cos, F.lit(0.0)))).alias("score"))


def top_k(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best, ties by key: each task keeps k rows, no full sort."""
    return scored.orderBy(F.col(score).desc(), F.col(key)).limit(k)


@dataclass
class TextIndex:
    """Postings, document statistics and corpus statistics of a text column, stored under ``path``."""

    spark: SparkSession
    path: str
    stop: tuple[str, ...] = ()

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str, stop: Sequence[str] = ()) -> TextIndex:
        self = cls(df.sparkSession, path, tuple(stop))
        return self._store(postings(df, key, text, stop), doc_lengths(df, key, text, stop))

    def _store(self, posts: DataFrame, lengths: DataFrame) -> TextIndex:
        # sorted by term across files, so that a query's terms prune row groups
        posts.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{self.path}/postings")
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths")
        self._read("lengths").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/corpus")
        stored = self._read("postings")
        stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms")
        doc_norms(stored.crossJoin(F.broadcast(self._read("corpus").select("n"))), F.col("n"), self._read("terms")).write.mode("overwrite").parquet(f"{self.path}/norms")
        return self

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, query: str, method: str = "bm25") -> DataFrame:
        """(doc, score) of the documents that share a term with the query."""
        terms = query_terms(query, self.stop)
        posts, frequencies, corpus = self._read("postings"), self._read("terms"), self._read("corpus")
        if method == "tf_idf":
            return _cosine(posts, frequencies, corpus.select("n"), self._read("norms"), Counter(terms))
        if method != "bm25":
            raise QueryError(f"unknown ranking {method}")
        hits = posts.where(F.col("term").isin(sorted(set(terms)))).join(F.broadcast(frequencies.where(F.col("term").isin(sorted(set(terms))))), "term").join(self._read("lengths"), "doc").crossJoin(F.broadcast(corpus))
        return hits.groupBy("doc").agg(F.sum(tx.bm25_weight(F.col("tf"), F.col("len"), F.col("avgdl"), tx.bm25_idf(F.col("n"), F.col("df")))).alias("score"))

    def remove(self, keys: DataFrame) -> TextIndex:
        """The index without some documents (doc), as a new one beside it."""
        return self._changed(lambda t: t.join(keys, "doc", "left_anti"))

    def add(self, df: DataFrame, key: str, text: str) -> TextIndex:
        """The index with further documents, whose text alone is read."""
        more = {"postings": postings(df, key, text, self.stop), "lengths": doc_lengths(df, key, text, self.stop)}
        return self._changed(lambda t: t.unionByName(more["postings" if "term" in t.columns else "lengths"]))

    def _changed(self, change) -> TextIndex:
        return TextIndex(self.spark, f"{self.path}+", self.stop)._store(change(self._read("postings")), change(self._read("lengths")))
