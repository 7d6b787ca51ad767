"""Every query runs; those with SQL equal DuckDB's rows."""

import pytest

import __spark_entry__
from conftest import same_rows

NAMES = sorted(__spark_entry__.catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    frame = __spark_entry__.queries()[name](spark, sf_dir)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        same_rows(frame, duck.sql(sql))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_filter_reaches_the_scan(spark, sf_dir, capsys):
    __spark_entry__.queries()["document_filter"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "StringContains(source,c1)" in plan and "ReadSchema: struct<text:string,source:string>" in plan
