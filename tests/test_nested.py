import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.operators import nested

names = st.sampled_from(["a", 'q"uote', "back\\slash", "über", "{[,:]}", "", "name", "children", "line\nbreak"])


def _node(children):
    kids = st.one_of(st.none(), st.lists(st.one_of(children, st.none()), max_size=3), children)
    return st.builds(lambda n, k, a, t, how: {x: y for x, y in ({"name": n, "attrs": a, "children": k, "text": t}).items() if x == "name" or x not in how}, names, kids, st.dictionaries(names, names, max_size=2), names, st.sets(st.sampled_from(["attrs", "children", "text"])))


trees = st.recursive(st.builds(lambda n: {"name": n}, names), _node, max_leaves=12)


def brute(node):
    out = []

    def walk(n, path):
        kids = n.get("children")
        kids = [kids] if isinstance(kids, dict) else kids if isinstance(kids, list) else []
        for i, k in enumerate(kids, 1):
            if isinstance(k, dict):
                p = f"{path}/{i}" if path else str(i)
                out.append((p, path, k.get("name")))
                walk(k, p)

    walk(node, "")
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(trees, min_size=1, max_size=4), st.booleans(), st.booleans())
def test_index_equals_recursive_parse(nodes, ascii_only, spaced):
    texts = [json.dumps(n, ensure_ascii=ascii_only, indent=1 if spaced else None).encode() for n in nodes]
    got, good = nested.index_trees(texts)
    assert all(good)
    assert [sorted(g) for g in got] == [brute(n) for n in nodes]


def test_broken_texts_do_not_spoil_their_neighbours():
    good = {"name": "r", "children": [{"name": "x"}, None, 3, "s", {"name": "y", "children": {"name": "z"}}]}
    broken = [b"", b"null", b"[1]", b'{"name": "a', b'{"name": "a", "children": [', b"}}", b'{"a": "\\"}']
    texts = []
    for b in broken:
        texts += [b, json.dumps(good).encode()]
    got, ok = nested.index_trees(texts)
    assert ok[1::2] == [True] * len(broken) and not any(ok[0::2])
    assert all(sorted(g) == brute(good) for g in got[1::2]) and not any(got[0::2])


def test_deep_tree():
    n = {"name": "leaf"}
    for _ in range(300):
        n = {"name": "n", "children": [n]}
    got, ok = nested.index_trees([json.dumps(n).encode()])
    assert ok == [True] and len(got[0]) == 300 and max(len(p.split("/")) for p, _, _ in got[0]) == 300


def test_frames(spark):
    random.seed(2)
    good = json.dumps({"name": "r", "children": [{"name": "x"}]})
    df = spark.createDataFrame([(1, good, 1), (1, good, 2), (2, None, 1), (3, "{", 1), (None, good, 1)], "rec_id bigint, tree string, path int")
    assert [tuple(r) for r in nested.flatten_trees(df, "rec_id", "tree").collect()] == [(1, "1", "", "x")]
    assert sorted(r.rec_id for r in nested.broken_trees(df.filter("rec_id IS NOT NULL"), "rec_id", "tree").collect()) == [2, 3]
    assert nested.flatten_trees(df.limit(0), "rec_id", "tree").count() == 0
    lists = spark.createDataFrame([(1, [("a",), None, (None,)]), (2, []), (3, None)], "id bigint, x array<struct<n:string>>")
    from pyspark.sql import functions as F

    assert sorted(tuple(r) for r in nested.flatten_list(lists, "id", F.col("x"), "items", "n").collect()) == [(1, "items/1", "", "a"), (1, "items/3", "", None)]
