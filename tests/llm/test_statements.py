"""Each registered query with a statement, side by side with it."""

import pytest
from changelens.llm import oracle, queries

from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"


def test_every_statement_has_a_query():
    assert set(oracle.STATEMENTS) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.STATEMENTS))
def test_query_gives_the_rows_of_its_statement(spark, name):
    same, note = compare(spark, FOLDER, name, queries.QUERIES[name], oracle.STATEMENTS[name])
    assert same, note
