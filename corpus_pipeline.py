"""A training corpus from raw documents, in five stages, each written as Parquet and read again.

Every stage takes any further columns, whatever their names: a stage sees the columns numbered, and names them again
when it returns. Null and blank texts go in the first stage. Rows may share an id and ids may be null: rows, not ids,
are judged. Very long texts are read whole. An empty table gives an empty one, with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, pii, simhash
from tessera.llm.common import Scratch
from tessera.llm.queries import DOMAIN, WEIGHTS

#: Documents whose best language has a smaller mean posterior are rejected, as are those without a letter.
LEAST_SCORE = 0.4


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1, ...: names that no operator gives."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _named(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from the numbered ones of ``found``, some of them changed."""
    return found.select(*[changed.get(n, F.col(f"c{i}")).cast(docs.schema[i].dataType).alias(n) for i, n in enumerate(docs.columns)])


def _at(docs: DataFrame, name: str) -> str:
    """The numbered name of a column."""
    return f"c{docs.columns.index(name)}"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have; a missing lang is filled in.

    Rejected: null texts, texts without a letter, and those whose best language has a mean posterior below LEAST_SCORE.
    Ties go to the language first in order. Without any labelled document nothing is known, and no row stays.
    """
    field = langid.train(docs.where(langid.LEARNS))
    rows = _numbered(docs)
    found = langid.predict_table(rows, field, text=_at(docs, "text"), keep=tuple(rows.columns))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _named(kept, docs, lang=F.coalesce(F.col(_at(docs, "lang")), "lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id's; rows without an id come after those with one.

    Rows that share an id but are no near copies of each other all stay; of repeated rows one does.
    """
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind, and n_chars counted anew; every row stays. A null text stays null."""
    rows, text = _numbered(docs), _at(docs, "text")
    found = pii.scan_table(rows, text=text, keep=tuple(c for c in rows.columns if c != text), redacted=True)
    return _named(found, docs, text=F.col("redacted"), n_chars=F.char_length("redacted"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says. Repeated rows have equal rates and copies; without labels every row stays once."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.train(docs, labels, F.expr(DOMAIN))
    rows, text = _numbered(docs), _at(docs, "text")
    mixed = mixing.mix(rows, model, WEIGHTS, keep=tuple(rows.columns), text=text, draw=(_at(docs, "doc_id"), text))
    return _named(mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, then the ids of every document and their digests; a column with the name of one of those gets ``_kept`` added. A null text has no ids."""
    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=tuple(c for c in docs.columns if c != "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express none of the trained stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of the documents table."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
