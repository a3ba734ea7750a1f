import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.llm import leaks as lk


def test_words():
    assert lk.words_of("Eng­raved lac​quers: KT-286,<br/>Œuvre Søren <b>bo</b>ld É!") == ["engraved", "lacquers", "kt", "286", "oeuvre", "soren", "bold", "e"]
    assert lk.words_of(None) == lk.words_of("") == lk.words_of(" .,") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 5), min_size=3, max_size=3), min_size=1, max_size=6))
def test_index_finds_every_occurrence(seq, patterns):
    index = lk.FMIndex(np.array(seq), 6)
    lo, hi = index.search(np.array(patterns))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(seq) - 2) if seq[i : i + 3] == p]


def brute(docs, items, least):
    shingles = {}
    for i, p in items:
        w = lk.words_of(p)
        for k in range(len(w) - least + 1):
            shingles.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {(d, i) for d, t in docs for w in [lk.words_of(t)] for k in range(len(w) - least + 1) for i in shingles.get(tuple(w[k : k + least]), ())}


def test_leaks_equal_brute_force_at_any_shard_and_block(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(3, 30)))) for i in range(20)] + [(90, None), (91, "")]
    items.append((92, items[0][1]))
    docs = []
    for d in range(60):
        ws = rnd.choices([*vocab, "other", "ÉTÉ"], k=rnd.randint(0, 60))
        if d % 3 == 0:
            p = items[rnd.randrange(20)][1].split()
            a = rnd.randrange(len(p))
            ws[5:5] = p[a : a + rnd.randint(1, 20)]
        docs.append((d, " ".join(ws)))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    want = brute(docs, [x for x in items if x[1]], 5)
    assert want
    for sizes in ({}, {"shard_words": 40}, {"block_words": 50}):
        assert {tuple(r) for r in lk.leaked_items(df, it, least=5, **sizes).collect()} == want
    assert lk.leaked_items(df.limit(0), it).count() == 0
    assert lk.leaked_items(df, it.limit(0)).count() == 0


def test_spans_merge(spark):
    df = spark.createDataFrame([(1, "a b c d e f g x x a b c d")], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, "a b c d e f g")], "item_id bigint, passage string")
    assert sorted((r.first_word, r.end_word) for r in lk.leaked_spans(df, it, least=3).collect()) == [(0, 7), (9, 13)]


def test_queries_equal_sql(spark):
    from oracle import DATA, rows_of, sql_rows

    from gramoflow.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert rows_of(queries.queries()[name](spark, DATA)) == sql_rows(sql), name
