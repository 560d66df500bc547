"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import pytest

from gradewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*cols).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = sorted(duck.sql(f"select {', '.join(cols)} from ({sql})").fetchall(), key=str)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-6)) for x, y in zip(a, b)), (a, b)


def test_every_query_but_two_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"st4_w16_rank_intervals", "w12_t4_linking"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
