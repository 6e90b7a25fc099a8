"""Every registered query agrees with its SQL twin; the others give rows."""

import pytest
import twin

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return twin.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, con, name):
    problems = twin.compare(spark, con, QUERIES[name], TWINS[name], FOLDER)
    # A selective query may find nothing in the smallest tables.
    assert [p for p in problems if p != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_query_without_twin_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_gives_severity_counts(spark):
    row = entry.entry(spark).first()
    assert sum(row) == spark.read.parquet(f"{FOLDER}/events.parquet").count()


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
