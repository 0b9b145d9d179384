"""Every registered query against its SQL, and the others for rows and a stable schema."""

import duckdb
import pandas as pd
import pytest

from ratingloom.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return float(f"{value:.12g}") if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found.columns)
    if name in ORACLE_SQL:
        wanted = duck.execute(ORACLE_SQL[name]).fetchdf()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
