"""Every query of the core library against its SQL on the smallest data."""

import os

import duckdb
import pytest

from locuspark import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(pdf, columns):
    pdf = pdf[columns].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SMALL).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_every_query_has_a_plan():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.FLAGSHIP in catalog.queries()
