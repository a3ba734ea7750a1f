import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.operators import error_parse as ep


def brute(text, width):
    """Least (quote, delimiter) edits by uniform-cost search over all edits, for short texts."""
    import heapq

    todo, seen = [(0, 0, 0, "S", 0)], set()
    while todo:
        q, d, p, s, k = heapq.heappop(todo)
        if (p, s, k) in seen:
            continue
        seen.add((p, s, k))
        c = text[p] if p < len(text) else None
        if c is None and s != "Q" and k == width - 1:
            return q, d
        step = lambda q, d, p, s, k: heapq.heappush(todo, (q, d, p, s, k))
        if c == '"':
            step(q + 1, d, p + 1, s, k)
            if s in "SEQ":
                step(q, d, p + 1, {"S": "Q", "E": "Q", "Q": "E"}[s], k)
        elif c == ",":
            if s == "Q":
                step(q, d, p + 1, s, k)
            else:
                step(q, d + 1, p + 1, s, k)
                if k < width - 1:
                    step(q, d, p + 1, "S", k + 1)
        elif c is not None and s != "E":
            step(q, d, p + 1, "U" if s == "S" else s, k)
        for a, b in (("S", "Q"), ("Q", "E"), ("E", "Q")):
            if s == a:
                step(q + 1, d, p, b, k)
        if s in "SUE" and k < width - 1:
            touches = (s == "E" and c is not None and c != ",") or (s == "U" and c == '"')
            step(q + touches, d + (not touches), p, "S", k + 1)
    return None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab,"', max_size=9), st.integers(1, 4))
def test_repair_is_cheapest(text, width):
    q, d, cells, _ = ep.repair([text], [width])[0]
    assert (q, d) == brute(text, width)
    assert len(cells) == width


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n é', max_size=6), min_size=1, max_size=5))
def test_round_trip_of_well_formed_records(cells):
    text = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c for c in cells)
    assert ep.split_well_formed(text) == cells
    assert ep.repair([text], [len(cells)])[0][:3] == (0, 0, cells)


HEAD = "﻿Artist,Title,release id,Date Added,RELEASED\r\n"


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("A,T,1,2024-02-29 10:00:00,1999-03-00", None),
        ('"A, B","T ""x""",,,', None),
        ("A,T,1,2023-02-29,1999", "value"),
        ("A,T,0123456789012,,", "value"),
        ("A,T,1,2024-01-01 24:00,", "value"),
        ("A, ,1,,", "value"),
        ("A,T,1,,unknown", "value"),
        ("A,T,1,", "columns"),
        ("A,T,1,,,", "columns"),
        ('A,"T,1,,', "quoting"),
        ('A,"T" x,1,,', "quoting"),
        ('A,T 12" mix,1,,', "quoting"),
        (None, "columns"),
        ("", "columns"),
    ],
)
def test_reasons(spark, text, reason):
    rows = spark.createDataFrame([(1, 0, HEAD, "x"), (1, 1, text, "x"), (1, 1, text, "y"), (2, 1, "A,T", "z"), (None, 1, "A", "z")], "file_id bigint, row_number int, raw_text string, cells string")
    got = {(r.file_id, r.row_number): r.reason for r in ep.error_parse(rows).collect()}
    assert got == {(1, 1): reason, (2, 1): "columns"}


def test_long_text_and_empty_table(spark):
    long = 'A,"' + "x," * 20_000 + ",1,,"
    rows = spark.createDataFrame([(1, 0, HEAD), (1, 1, long)], "file_id bigint, row_number int, raw_text string")
    r = ep.rejected(rows).collect()[0]
    assert r.reason == "quoting"
    assert len(r.cells) == 5
    assert ep.rejected(rows.limit(0)).count() == 0


def test_valid_rows_load_typed(spark):
    rows = spark.createDataFrame([(1, 0, HEAD), (1, 1, "A,T,12,2024-01-02 03:04,1999-00-00")], "file_id bigint, row_number int, raw_text string")
    r = ep.load_valid(rows).collect()[0]
    assert (r.artist, r.release_id, str(r.date_added), r.released) == ("A", 12, "2024-01-02 03:04:00", 1999)


def test_many_headers_join_without_broadcast(spark, monkeypatch):
    from gramoflow.operators import scale

    monkeypatch.setattr(ep, "sized_join", lambda *a, **k: scale.sized_join(*a, **(k | {"rows": 0, "salt": 3})))
    random.seed(1)
    data = [(f, n, HEAD if n == 0 else "A,T,1,," if n % 2 else "A,T") for f in range(5) for n in range(7)]
    got = ep.error_parse(spark.createDataFrame(data, "file_id bigint, row_number int, raw_text string")).collect()
    assert sorted((r.file_id, r.row_number, r.reason) for r in got) == sorted((f, n, None if n % 2 else "columns") for f in range(5) for n in range(1, 7))
