"""Queries over whole tables take in the rows that a filter on the input would leave out."""

from __future__ import annotations

import pytest

from gramoflow.operators import relational
from gramoflow.plans import catalog


def tables(spark, folder, **rows):
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_bridge_join_counts_all_lines(spark, tmp_path):
    d = tables(
        spark, tmp_path,
        customer=([(1,), (2,)], "c_custkey bigint"),
        orders=([(10, 1), (11, 1), (20, 2)], "o_orderkey bigint, o_custkey bigint"),
        lineitem=([(10, n, 100 + n) for n in range(1, 8)] + [(11, 1, 101), (11, 3, 300), (20, 7, 700)], "l_orderkey bigint, l_linenumber int, l_partkey bigint"),
    )
    assert {tuple(r) for r in catalog.QUERIES["q_bridge_join"](spark, d).collect()} == {(1, 8), (2, 1)}


def test_conditional_join_takes_all_customers(spark, tmp_path):
    d = tables(spark, tmp_path, customer=([(k,) for k in range(1, 21)], "c_custkey bigint"), part=([(k, f"Brand#{k % 9}") for k in range(1, 21)], "p_partkey bigint, p_brand string"))
    got = {r.c_custkey: r.n for r in catalog.QUERIES["q_conditional_join"](spark, d).collect()}
    assert got == {k: 1 if k % 2 == 0 else sum(p % 9 == k % 9 for p in range(1, 21)) for k in range(1, 21)}


def test_artist_releases_hold_all_artists(spark, tmp_path):
    d = tables(spark, tmp_path, credits=([("release", 194, 1, "Bass"), ("release", 194, 1, "Bass"), ("release", 200, 2, " "), ("master", 7, 3, "Bass"), ("release", None, 4, "Bass")], "owner_type string, discogs_artist_id bigint, owner_id bigint, role string"))
    assert {tuple(r) for r in catalog.QUERIES["q_artist_releases"](spark, d).collect()} == {(194, 1, "Bass"), (200, 2, "Main artist")}


def test_each_batch_meets_the_library_s_batch_before(spark, tmp_path):
    """Library 2 misses February; its March meets January."""
    rows = [(1, "01", 1, "a", "x"), (1, "02", 1, "a", "x"), (1, "02", 2, "b", "y"), (1, "03", 1, "b", "z"), (2, "01", 1, "a", "x"), (2, "03", 5, "a", "x")]
    d = tables(spark, tmp_path, parsed_rows=(rows, "library_id bigint, batch_date string, row_number bigint, identity_key string, content_hash string"))
    got = {tuple(r) for r in catalog.QUERIES["q_multiset_reconcile"](spark, d).collect()}
    first, second = 1_000_000, 2_000_000
    assert got == {("01", first + 1, "new", None, 0), ("02", first + 1, "existing", first + 1, 0), ("02", first + 2, "new", None, 0), ("03", first + 1, "ambiguous", None, 1), ("01", second + 1, "new", None, 0), ("03", second + 5, "existing", second + 1, 0)}
    assert {tuple(r) for r in catalog.QUERIES["q_missing"](spark, d).collect()} == {("03", first + 1), ("03", first + 2)}


def test_census_takes_nodes_of_any_depth(spark, tmp_path):
    node = '{"name":"n","text":"t"}'
    for _ in range(34):
        node = f'{{"name":"n","text":"t","children":[{node}]}}'
    d = tables(spark, tmp_path, xnode_records=([(1, node)], "rec_id bigint, node_json string"))
    assert catalog.QUERIES["q_census"](spark, d).count() == 35


def test_paths_raise_below_the_deepest_level(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, str(i)) for i in range(5)], "k int, p int, name string")
    assert relational.paths(nodes, "k", "p", "name", deepest=4).count() == 5
    with pytest.raises(ValueError):
        relational.paths(nodes, "k", "p", "name", deepest=3)
