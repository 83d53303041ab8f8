"""Each registered query of the genomic catalogue against its SQL oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from helixloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
#: Also run in one and in many partitions.
INVARIANT = ("qc_summary", "contingency", "interval_overlaps", "column_stats", "candidate_pairs", "bootstrap_columns")


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if value == value else None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, db, name):
    found = QUERIES[name](spark, sf_dir)
    expected = db.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert table(found.columns, found.collect()) == table(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", INVARIANT)
def test_does_not_depend_on_partitions(spark, sf_dir, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(table(QUERIES[name](spark, sf_dir).columns, QUERIES[name](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_keys_agree():
    assert set(ORACLES) <= set(QUERIES)
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
