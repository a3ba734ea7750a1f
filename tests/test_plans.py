"""Plans keep their shape: no join without keys, no row-at-a-time Python, pruned scans, pushed filters."""

import re

import pytest
from oracle import DATA

from gramoflow.plans import catalog, problems

QUERIES = problems.queries() | catalog.QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_keyless_joins_or_row_udfs(spark, name):
    p = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p


@pytest.mark.parametrize(
    ("name", "scan", "columns"),
    [
        ("q_first_order", "orders", {"o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"}),
        ("q_credited_semi", "credits", {"owner_type", "owner_id", "role"}),
        ("q_credited_semi", "release_records", {"discogs_id", "dump_date", "load_id", "status", "title"}),
        ("q_roles_histogram", "credits", {"role", "owner_type", "discogs_artist_id"}),
        ("q_split_group_counts", "collection_rows", {"format_raw"}),
        ("p2_found", "credits", {"credit_id", "discogs_artist_id", "dump_date"}),
    ],
)
def test_scans_read_what_is_needed(spark, name, scan, columns):
    p = plan(QUERIES[name](spark, DATA))
    read = [set(re.findall(r"(\w+):", m)) for m in re.findall(rf"{scan}\.parquet\].*?ReadSchema: struct<([^\n]*?)>(?:\n|$)", p)]
    assert read and all(r == columns for r in read)


def test_filters_reach_the_scan(spark):
    p = plan(QUERIES["q_credited_semi"](spark, DATA))
    assert "EqualTo(role,Bass)" in p and "EqualTo(owner_type,release)" in p
    assert "GreaterThan(o_orderkey,1000)" in plan(QUERIES["q_keyset_page"](spark, DATA))
