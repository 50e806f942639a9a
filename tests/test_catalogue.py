"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from blockwise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((str([value(r[k]) for k in order]) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(map(tuple, got.collect()), got.columns) == plain(want.fetchall(), names)


def test_flagship(spark):
    rows = catalogue.language_report(spark, SF).collect()
    assert sum(r.documents for r in rows) > 190 and all(r.blocks >= r.documents for r in rows)
