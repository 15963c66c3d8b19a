"""Every registered query with an SQL statement gives the same rows in DuckDB."""

import pathlib

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True).fillna(-1)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    ours = comparable(queries()[name](spark, sf_dir).toPandas())
    theirs = comparable(duck.execute(oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    for column in ours:
        assert ours[column].eq(theirs[column]).all(), column


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark, duck):
    ours = comparable(entry(spark).toPandas())
    theirs = comparable(duck.execute(oracle_sql()["analogy_2rounds"]).df())
    assert len(ours) > 0 and all(ours[c].eq(theirs[c]).all() for c in ("pair_id", "y", "x", "v"))
