"""Every registered query outside the subpackage llm: against DuckDB where it has SQL, else that it runs."""

from __future__ import annotations

import pytest
from compare import oracle, rows

from kinweave.plans import library

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(library.QUERIES))
def test_query(spark, name):
    got = rows(library.QUERIES[name](spark, SF).toPandas())
    if name in library.ORACLE_SQL:
        assert got == oracle(library.ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
