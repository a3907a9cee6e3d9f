"""Every query with plain SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skirmish.plans import registry, registry_more, registry_sources, registry_timers, road  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(str([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    names = list(want.columns)
    assert rows == sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in want.fetchall())


#: Without SQL.
NO_SQL = (
    "ability_frequency", "correlate_fights", "instance_runs", "recast_timers", "resolve_allies", "shared_rule_feed", "status_callouts", "status_pairing",
    "timer_board", "timer_events", "timer_mods", "walked_fights",
)


def test_what_has_no_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(NO_SQL)


@pytest.mark.parametrize("name", NO_SQL)
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
