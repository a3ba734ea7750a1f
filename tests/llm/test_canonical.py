import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.llm import canonical as ca

words = st.text(alphabet="abcd", max_size=7)
CANON = [
    ("media_condition", "M", "Mint (M)", 1), ("media_condition", "NM", "Near Mint (NM or M-)", 2), ("media_condition", "VG+", "Very Good Plus (VG+)", 3), ("media_condition", "VG", "Very Good (VG)", 4),
    ("media_condition", "G+", "Good Plus (G+)", 5), ("media_condition", "G", "Good (G)", 6), ("media_condition", "F", "Fair (F)", 7), ("media_condition", "P", "Poor (P)", 8), ("media_condition", "NG", "Not Graded", 9),
    ("format_raw", "Vinyl", "Vinyl", 1), ("format_raw", "CD", "CD", 2), ("format_raw", "CDr", "CDr", 3), ("format_raw", "Cassette", "Cassette", 4), ("format_raw", "Reel-To-Reel", "Reel-To-Reel", 7), ("format_raw", "Acetate", "Acetate", 12),
]


@settings(max_examples=200, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    assert ca.distance(a, b) == ca.distance(b, a)
    assert (ca.distance(a, b) == 0) == (a == b)
    assert ca.distance(a, c) <= ca.distance(a, b) + ca.distance(b, c)


@settings(max_examples=100, deadline=None)
@given(st.lists(words, max_size=25), words, st.integers(0, 3))
def test_tree_finds_every_word_in_the_radius(held, word, r):
    t = ca.BKTree()
    for i, w in enumerate(held):
        t.add(w, i)
    got = sorted(i for _, _, ps in t.search(word, r) for i in ps)
    assert got == [i for i, w in enumerate(held) if ca.distance(w, word) <= r]


@pytest.mark.parametrize(
    ("field", "value", "entry"),
    [
        ("media_condition", " VG plus", "VG+"), ("media_condition", "V.G.+", "VG+"), ("media_condition", "Very oGod Plus", "VG+"), ("media_condition", "Very Godo", "VG"), ("media_condition", "[good +]", "G+"),
        ("media_condition", "nm/m-", "NM"), ("media_condition", "M-", "NM"), ("media_condition", "MINT!", "M"), ("media_condition", "sealed, mint", "M"), ("media_condition", "mint (my grading)", "M"),
        ("media_condition", "poor - scratched", "P"), ("media_condition", "Fiar (F)!", "F"), ("media_condition", "n/g", "NG"), ("media_condition", "7/10", None), ("media_condition", "blue", None), ("media_condition", "???", None),
        ("format_raw", "Vynil", "Vinyl"), ("format_raw", '12"', "Vinyl"), ("format_raw", "12''", "Vinyl"), ("format_raw", "L.P.", "Vinyl"), ("format_raw", "CD-R", "CDr"), ("format_raw", "C.D.", "CD"), ("format_raw", "compact disk", "CD"),
        ("format_raw", "Reel-2-Reel", "Reel-To-Reel"), ("format_raw", "dub plate acetate", "Acetate"), ("format_raw", "tote bag", None), ("format_raw", "x" * 50_000, None),
    ],
)
def test_values(field, value, entry):
    best = ca.closest(value, ca.trees(CANON)[field])
    assert (best and best[3]) == entry


def test_rows_nulls_ties_and_shards(spark):
    ref = spark.createDataFrame(CANON, "field string, entry string, entry_label string, pos int")
    rows = spark.createDataFrame([(1, "media_condition", "vg"), (1, "media_condition", "vg"), (2, "media_condition", "VG"), (3, "media_condition", None), (4, "media_condition", "  "), (5, "media_condition", "zzz"), (6, "other", "vg")], "row_id bigint, field string, text string")
    vals = rows.filter("text IS NOT NULL").selectExpr("field", "text", "text AS value").distinct()
    want = [(1, "media_condition", "VG"), (5, "media_condition", "(unmatched)"), (6, "other", "(unmatched)")]
    for size in (100, 4):
        assert sorted(tuple(r) for r in ca.map_rows(rows, vals, ref, size).collect()) == want
    assert ca.map_rows(rows.limit(0), vals.limit(0), ref).count() == 0
    assert {r.entry for r in ca.map_values(vals, ref.limit(0)).collect()} == {"(unmatched)"}


def test_other_names_are_a_parameter(spark):
    """Another reference list: typing slips are found by the tree, other names only if they are given."""
    ref = spark.createDataFrame([("city", "Lisbon", None, 1), ("city", "Porto", None, 2)], "field string, entry string, entry_label string, pos int")
    values = spark.createDataFrame([("city", v) for v in ("lisbno", "Lisboa", "PORTO ", "Oporto", "Ghent")], "field string, value string")
    got = lambda **k: {r.value.strip(): r.entry for r in ca.map_values(values, ref, **k).collect()}
    assert got(names={}) == {"lisbno": "Lisbon", "Lisboa": "Lisbon", "PORTO": "Porto", "Oporto": "Porto", "Ghent": ca.UNMATCHED}
    assert got(names={"Porto": ("Ghent",)})["Ghent"] == "Porto"
