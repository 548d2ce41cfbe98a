import datetime
import math
import os

import pytest

import __spark_entry__ as entry
from logweave.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def clean(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v if isinstance(v, (bool, str)) else int(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    theirs = [tuple(clean(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    ours = [tuple(clean(r[c]) for c in columns) for r in got.collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        "SELECT CASE WHEN i % 4 = 1 THEN NULL ELSE i END AS event_id, CASE WHEN i % 4 = 1 THEN TIMESTAMP '2024-01-03' ELSE TIMESTAMP '2024-01-01' + to_minutes(i::INT * 7) END AS ts FROM range(40) r(i)",
        "SELECT i AS event_id, TIMESTAMP '2024-01-01 00:09:59.999498' + to_minutes(10 * i::INT) + to_microseconds(i % 4) AS ts FROM range(40) r(i)",
        "SELECT i AS event_id, CASE WHEN i % 3 > 0 THEN TIMESTAMP '2400-01-01 00:09:59.999499' + to_minutes(10 * i::INT) END AS ts FROM range(40) r(i)",
        "SELECT i // 5 - 3 + (i % 2) * 300000 AS event_id, TIMESTAMP '1969-12-31 22:00:00' + to_minutes(10 * (i // 5)::INT) AS ts FROM range(200) r(i)",
    ],
    ids=["null ids last", "half a millisecond before a tick", "late times and none", "equal rows, two ranges, before 1970"],
)
def test_monotone_clock_on_odd_events(spark, tmp_path, rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    theirs = con.execute(registry.ORACLES["monotone_clock"]).fetchall()
    ours = [(r.event_id, r.clock) for r in registry.QUERIES["monotone_clock"](spark, str(tmp_path)).collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)


def test_every_query_is_registered(spark):
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
