from __future__ import annotations

import pytest

import __spark_entry__ as entry
from verify import same, views

SQL = entry.oracle_sql()
#: What SQL can't express; tests of the subpackage say what must hold of these.
NO_SQL = {"p6_found", "p6_packing", "p7_found", "p7_documents", "p8_found", "p8_sentences"}


def test_every_query_has_its_sql():
    assert set(SQL) <= set(entry.queries()) and set(entry.queries()) - set(SQL) <= NO_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert same(got, views(sf_dir).execute(SQL[name]).df()) == ""
