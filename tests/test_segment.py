import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.operators import segment as sg

KNOWN = sg.automaton(["Stereo/Mono", "33 1/3 RPM", "Tin Music, Inc.", "Tin/Yarrow Discs"])
PLAIN = frozenset(v.lower() for v in sg.FORMAT_VALUES)


def cut(text):
    return sg.segment(text, sg.known_spans(text, KNOWN) if text else [], PLAIN)


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []), ("", []), ("  ", []), (",;|", []), ("Vinyl", ["Vinyl"]),
        ('12", Numbered', ['12"', "Numbered"]), ('"10""","LP"', ['10"', "LP"]), ('"Vinyl" | "7"""', ["Vinyl", '7"']),
        ("2 x Vinyl, LP", ["2 x Vinyl", "LP"]), ("CD;; LP;", ["CD", "LP"]), ("LP, LP", ["LP", "LP"]),
        ("Vinyl,Stereo/Mono", ["Vinyl", "Stereo/Mono"]), ("LP / Stereo/Mono / 33 1/3 RPM", ["LP", "Stereo/Mono", "33 1/3 RPM"]),
        ("LP/EP", ["LP", "EP"]), ("Foo/Bar Discs", ["Foo/Bar Discs"]), ("Tin/Yarrow Discs, Rook", ["Tin/Yarrow Discs", "Rook"]),
        ("Rook, Tin Music, Inc., Wick", ["Rook", "Tin Music, Inc.", "Wick"]), ("Tin Music, Inc.", ["Tin Music, Inc."]),
        ('Rook, "Oak, Ash & Co.", Wick', ["Rook", "Oak, Ash & Co.", "Wick"]), ('"Red, Marbled', ['"Red', "Marbled"]),
        ("a\nb\tc · d + e", ["a", "b", "c", "d", "e"]), ("Mast & Night, Umber", ["Mast & Night", "Umber"]), ("STEREO/MONO, x", ["STEREO/MONO", "x"]),
        ("  CD  ,  7\"", ["CD", '7"']),
    ],
)
def test_segments(text, values):
    assert cut(text) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab"c', min_size=1, max_size=5).filter(lambda s: s.strip()), min_size=1, max_size=6), st.sampled_from([",", ", ", ";", " | ", "\n", " / ", " + "]))
def test_quoted_values_round_trip(values, sep):
    text = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert sg.segment(text, []) == values


def test_long_fields_are_quick():
    assert len(sg.segment(",".join(["x"] * 50_000), [])) == 50_000
    assert sg.segment("x/" * 20_000 + "x", []) == ["x/" * 20_000 + "x"]


def test_frames_and_shards(spark):
    rows = [(1, "Tin Music, Inc., Rook", 9), (1, "Tin Music, Inc., Rook", 9), (2, None, 9), (3, "A, Oak/Elm", 9), (4, "B | Tin/Yarrow Discs", 9), (5, "", 9)]
    df = spark.createDataFrame(rows, "k bigint, text string, vals int").select("k", "text")
    names = spark.createDataFrame([("Tin Music, Inc.",), ("Tin/Yarrow Discs",), ("Elm, Inc.",), (None,)], "v string").filter("v IS NOT NULL")
    one = sorted((r.k, r.vals) for r in sg.segment_fields(df, names).collect())
    cut_up = sorted((r.k, r.vals) for r in sg.segment_fields(df, names, shard_values=1).collect())
    assert one == cut_up == [(1, ["Tin Music, Inc.", "Rook"]), (3, ["A", "Oak/Elm"]), (4, ["B", "Tin/Yarrow Discs"]), (5, [])]
    assert sorted(tuple(r) for r in sg.values(sg.segment_fields(df, names), 2).collect())[0] == (1, 1, "Tin Music, Inc.")
    assert sg.segment_fields(df.limit(0), names).count() == 0


def test_quantities():
    assert [sg.without_quantity(v) for v in ("2 x Vinyl", "3×CD", "10XLP", '12"', "2×", "8-Track")] == ["Vinyl", "CD", "LP", '12"', "2×", "8-Track"]


def test_letters_that_grow_in_lower_case():
    """A known value keeps its delimiter where lower-casing another letter of the text changes its length."""
    known = sg.automaton(["Tin Music, Inc.", "\u0130ris, Ltd"])
    text = "\u0130stanbul, Tin Music, Inc., \u0130ris, Ltd"
    assert sg.segment(text, sg.known_spans(text, known)) == ["\u0130stanbul", "Tin Music, Inc.", "\u0130ris, Ltd"]
