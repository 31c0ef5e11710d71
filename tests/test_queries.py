"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as project
from dateline.plans import all_queries, all_sql
from oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = project.queries(), project.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(all_queries()) - set(all_sql()) == {"pca_3d", "kmeans_topics"}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert differences(frame, connection, SQL[name]) == []
    else:
        assert frame.count() > 0


def test_entry(spark):
    rows = project.entry(spark)
    assert rows.columns == ["id", "url", "title", "source", "domain", "rank"]
    assert rows.count() > 0
