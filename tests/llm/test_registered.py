"""The registered queries over the smallest tables: columns, rows, and what their contracts fix."""

import zlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tests.llm.test_pii import slow_base
from tests.llm.test_simhash import slow_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_mixing": ["doc_id", "n_tokens", "posterior", "rate", "copies", "residual", "domain"], "op2_html": ["page_id", "url", "text", "n_chars"], "op3_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_langid": ["doc_id", "held_out", "lang_pred", "score"], "op5_simhash": ["doc_id", "fingerprint", "component_id"], "op6_licenses": ["doc_id", "n_hits", "licenses", "best_license", "best_dice"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op8_hnsw": ["vec_id", "n_links", "component_id", "kept", "audit_recall"],
    "op9_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"], "op10_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}
TABLES = {"op2_html": ("pages", "page_id"), "op8_hnsw": ("embeddings", "vec_id")}


@pytest.fixture(scope="module")
def found(spark):
    return {n: __spark_entry__.queries()[n](spark, SF) for n in COLUMNS}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_row_once(spark, found, name):
    table, key = TABLES.get(name, ("documents", "doc_id"))
    df = found[name]
    assert df.columns == COLUMNS[name]
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in df.select(key).collect()) == want


def test_held_out(found):
    for r in found["op4_langid"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.lang_pred in ("de", "en", "es", "fr", "und") and 0 <= r.score <= 1


def test_fingerprints_and_spans(spark, found):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.fingerprint == f"{slow_fingerprint(texts[r.doc_id]):016x}" for r in found["op5_simhash"].collect())
    for r in found["op7_pii"].collect():
        base = [f"{k}:{a}:{b}" for k, a, b in slow_base(texts[r.doc_id])]
        assert set(base) <= set(filter(None, r.spans.split(",")))


def test_licence_oracle(found):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = c.sql(__spark_entry__.oracle_sql()["op6_licenses"])
    assert want.columns == found["op6_licenses"].columns
    assert sorted(want.fetchall(), key=str) == sorted(map(tuple, found["op6_licenses"].collect()), key=str)
