import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.llm import packing as pk


def fewest(sizes, capacity):
    """Fewest bins by trying all assignments."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                rooms[j] -= sizes[i]
                place(i + 1, rooms)
                rooms[j] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(20, 30))
def test_small_packings_are_optimal(sizes, capacity):
    sizes.sort(reverse=True)
    bins, bound, proven = pk.complete_bins(sizes, capacity, 50_000)
    assert bound <= len(bins) and (not proven or len(bins) == fewest(sizes, capacity))
    assert sorted(itertools.chain(*bins)) == sorted(sizes)
    assert all(sum(b) <= capacity for b in bins)
    assert len(bins) == fewest(sizes, capacity) >= pk.least_bins(sizes, capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=8), st.integers(24, 40))
def test_bounds_never_exceed_the_optimum(sizes, capacity):
    assert pk.least_bins(sizes, capacity) <= fewest(sizes, capacity)


def test_bound_of_items_in_pairs():
    """Items over a third of the container stand in pairs at most."""
    assert pk.least_bins([400] * 100, 1024) == 50
    bins, bound, proven = pk.complete_bins([400] * 100, 1024)
    assert len(bins) == bound == 50 and proven


def test_more_containers_than_least_nodes():
    """The search reaches a leaf however many containers a chunk needs."""
    rnd = random.Random(7)
    sizes = [rnd.randint(300, 700) for _ in range(9000)]
    bins, bound, _ = pk.complete_bins(sizes, 1000)
    assert sorted(itertools.chain(*bins)) == sorted(sizes) and len(bins) > pk.LEAST_NODES
    assert bound <= len(bins) <= len(pk.best_fit(sizes, 1000))


@pytest.mark.parametrize("capacity", [256, 1024])
def test_large_packings_are_near_the_bound(capacity):
    rnd = random.Random(2)
    sizes = [min(capacity - 1, max(5, int(rnd.lognormvariate(4.8, 0.8)))) for _ in range(1500)]
    bins, *_ = pk.complete_bins(sizes, capacity)
    assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
    assert len(bins) <= pk.least_bins(sizes, capacity) * 1.005 + 1


def test_containers_are_valid(spark):
    rnd = random.Random(3)
    counts = [(i, rnd.choice([3, 10, 50, 100, 101, 250, 1000])) for i in range(300)]
    df = spark.createDataFrame(counts, "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(1, 100), (2, 256), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    for chunk in (4000, 40):
        rows = pk.containers(df, specs, chunk).collect()
        for spec, cap in ((1, 100), (2, 256)):
            mine = [r for r in rows if r.spec_id == spec]
            by_doc, by_bin = {}, {}
            for r in mine:
                by_doc.setdefault(r.doc_id, []).append(r)
                by_bin[r.container] = by_bin.get(r.container, 0) + r.n_tokens
            assert max(by_bin.values()) <= cap
            for d, n in counts:
                parts = sorted(by_doc[d], key=lambda r: r.piece)
                assert sum(p.n_tokens for p in parts) == n and (len(parts) == 1 or n > cap)
                assert [p.first_token for p in parts] == [i * cap for i in range(len(parts))]
            assert sum(by_bin.values()) / (len(by_bin) * cap) > 0.97
        assert {r.spec_id for r in rows} == {1, 2}


def test_tokens_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "x" * 100_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in pk.token_counts(df).collect()}
    assert set(got) == {1, 4, 5} and got[1] == 3 and got[4] > 1
    other = {r.doc_id: r.n_tokens for r in pk.token_counts(df, pk.TOKENIZER.replace(".tiktoken", ".json")).collect()}
    assert other == got  # one vocabulary in two forms
    specs = spark.createDataFrame([(1, 100)], "spec_id int, capacity_tokens int")
    assert pk.containers(pk.token_counts(df.limit(0)), specs).count() == 0
    assert pk.containers(pk.token_counts(df), specs.limit(0)).count() == 0


def test_many_capacities_and_report(spark, monkeypatch):
    monkeypatch.setattr(pk, "MOST_SPECS", 2)
    df = spark.createDataFrame([(i, 10 + i) for i in range(40)], "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(i, 60 + i) for i in range(5)], "spec_id int, capacity_tokens int")
    assert {r.spec_id: r.n for r in pk.containers(df, specs).groupBy("spec_id").count().withColumnRenamed("count", "n").collect()} == {i: 40 for i in range(5)}
    report = pk.search_report(df, specs).collect()
    assert {r.spec_id for r in report} == set(range(5)) and all(r.bound <= r.containers and 0 <= r.proven <= r.chunks for r in report)
    assert pk.search_report(df, specs.limit(0)).count() == 0
