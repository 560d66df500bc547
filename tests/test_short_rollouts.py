"""Rollouts of a few frames, of which the smallest tables have none."""

import os

import pytest

from gradewright.plans import registry

SF = "/root/testdata/sf0.001"
#: rollout, events of a kind: 1 and 3 have one frame, 2 has two, 4 has four.
EVENTS = [(1, "click", 1), (1, "view", 1), (1, "purchase", 1), (2, "click", 2), (2, "view", 2), (2, "purchase", 3), (3, "click", 5), (3, "view", 1), (4, "click", 6), (4, "view", 4)]


@pytest.fixture(scope="module")
def short(tmp_path_factory):
    """A folder whose events are those of EVENTS, and a connection that sees its tables."""
    import duckdb

    d, c = tmp_path_factory.mktemp("short"), duckdb.connect()
    kinds = ", ".join(f"({i}, {u}, '{e}', {n})" for i, (u, e, n) in enumerate(EVENTS))
    c.sql(f"""copy (select i * 10 + j as event_id, timestamp '2024-01-01' + to_seconds(i * 10 + j) as ts, u::bigint as user_id, e as event_type, 5.0::double + 7 * j + i as value, '{{"k": ' || (i + 3 * j) || '}}' as props
      from (values {kinds}) v(i, u, e, n), range(0, 6) r(j) where j < n) to '{d}/events.parquet'""")
    for t in os.listdir(SF):
        if t != "events.parquet":
            os.symlink(f"{SF}/{t}", d / t)
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{d}/{t}'")
    return str(d), c


@pytest.mark.parametrize("name", ["w11_c8_dtmc", "w11_dtmc_run_of_three", "x3_channel_scores"])
def test_rollouts_of_one_frame(spark, short, name):
    d, c = short
    df = registry.queries()[name](spark, d)
    cols = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*cols).collect()), key=str)
    want = sorted(c.sql(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall(), key=str)
    assert {1, 2, 3, 4} - {r[cols.index("rollout_id")] for r in want if "dtmc" in name or "success.tl_dtmc" in r} == {1, 3}
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-6)) for x, y in zip(a, b)), (a, b)
