"""Every registered query against its oracle, on the same Parquet tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.ORACLES:
        assert len(got) > 0
        return
    relation = oracle.sql(queries.ORACLES[name])
    want, want_names = rows(relation.fetchall(), relation.columns)
    found, names = rows([tuple(r) for r in got], df.columns)
    assert names == want_names
    assert len(found) == len(want) and len(want) > 0
    assert found == want
