"""Every catalogue query against its SQL."""

import pytest

from inferframe.plans.catalogue import all_queries, all_sql
from tests.comparing import connect, differences


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf, db, name):
    df = all_queries()[name](spark, sf)
    if name in all_sql():
        assert differences(df, all_sql()[name], db) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert sorted(__spark_entry__.entry(spark).columns) == ["lang", "n", "total_tokens"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    from inferframe.plans import request_queries

    plan = request_queries.q_filter_lang_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
