"""The registered queries of the training-data operators: op1_ to op10_, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Domains of a document by its labels, and their shares of the mixture's tokens.
DOMAIN = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END"
WEIGHTS = {"high": 0.7, "low": 0.29, "toxic": 0.01}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing

    docs = _table(spark, sf_dir, "documents")
    model = mixing.train(docs, _table(spark, sf_dir, "labels"), F.expr(DOMAIN))
    return mixing.mix(docs, model, WEIGHTS, residual=True).withColumn("domain", F.get(F.array(*map(F.lit, model.domains)) if model.domains else F.array(F.lit("")), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import html

    return html.extract_table(_table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm import bpe

    return bpe.encode_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import langid

    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    return langid.predict_table(docs, langid.train(docs.where(langid.LEARNS)), keep=("doc_id", "held_out"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import simhash

    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import licenses

    return licenses.scan_table(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii

    return pii.scan_table(_table(spark, sf_dir, "documents"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import hnsw

    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import minhash

    return minhash.fingerprinted(_table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import repeats

    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html, op3_bpe, op4_langid, op5_simhash, op6_licenses, op7_pii, op8_hnsw, op9_minhash, op10_repeats)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from tessera.llm import licenses

    return {"op6_licenses": licenses.oracle_sql()}
