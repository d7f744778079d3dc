"""Each query against its SQL, and plans."""

import re

import duckdb
import pytest

from kvstrata import queries

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == cols
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_reaches_the_reader(spark, small):
    plan = plan_of(queries.prefix_scan_entries(spark, small))
    assert "GreaterThanOrEqual(c_name" in plan and "c_acctbal" not in plan.split("ReadSchema")[1]


def test_snapshot_combines_before_its_one_shuffle(spark, small):
    plan = plan_of(queries.snapshot_as_of(spark, small))
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "partial_max_by" in plan


def test_split_exact_follows_the_rolling_rule(spark, small):
    rows = queries.split_exact(spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r.store_id, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: (r.key, r.tsn))
        part = size = 0
        for i, r in enumerate(group):
            if i and size >= 10_000:
                part, size = part + 1, 0
            assert r.part == part
            size += 21 + (4 + len(r.value) if r.op == "PUT" else 0)


@pytest.mark.parametrize("name", ["block_stats", "split_by_floor", "neighbours", "seek_floor", "seek_ceiling"])
def test_plans_read_only_what_their_inputs_have(spark, small, name):
    """The optimizer must not move a range's expression to a side of a join without its key."""
    assert not [line for line in plan_of(queries.QUERIES[name](spark, small)).splitlines() if re.match(r"[\s:+\-*()\d]*!", line)]
