import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramoflow.functions import ordering, parsing, text


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (text.normalize_name, ["Zoë Ñandúvar", "Mokalur (7)", "The Rivets", "木村 ゆき", "QX+RZ", "¿?", None], ["zoe nanduvar", "mokalur", "the rivets", "木村 ゆき", "qx rz", None, None]),
    (text.normalize_code, ["qt-77/b 3", "none", "ü 9", "..", None], ["QT77B3", None, "U9", None, None]),
    (text.norm_key, ["Ab C#1é", "Ｆull", None], ["abc#1", "full", ""]),
    (text.ascii_fold, ["ÁBc", None], ["Ábc", None]),
    (text.squeeze, [" a  b\tc "], ["a b c"]),
    (text.tag_list, ["Jazz, Deep  House,jazz,, x" + "y" * 50, None], [["jazz", "deep-house", "x" + "y" * 39], []]),
    (parsing.duration_seconds, ["9:07", "2:10:05", "y", "4:3:2:1", "", None, "0:75"], [547, 7805, None, None, None, None, 75]),
    (lambda c: parsing.year_in(c, 1850, 2100, True), ["1981-00-00", "19810510", "1800", "c. 1981", None], [1981, 1981, None, None, None]),
    (lambda c: parsing.year_in(c, 1900, 2100), ["c. 1981", "1066", ""], [1981, None, None]),
    (parsing.format_group, ["Vinyl", "CDr", "File", "LP", None], ["Vinyl", "CD", "Digital", "Other", "Other"]),
    (parsing.typed_format_group, ["2xVinyl, LP", "LP", "3 × CD + DVD", "Cass, C60", "File, FLAC", "DVD", ""], ["Vinyl", "Vinyl", "CD", "Cassette", "Digital", "Other", "Other"]),
    (parsing.grade, ["Mint (M)", "Near Mint (NM or M-)", "Very Good Plus (VG+)", "Very Good (VG)", "Good Plus (G+)", "Good (G)", "Fair (F)", "Poor (P)", "Generic", "No Cover", "Not Graded", "", "odd", None], ["M", "NM", "VG+", "VG", "G+", "G", "F", "P", "GENERIC", "NONE", "NG", "NG", "NG", "NG"]),
    (parsing.grade_rank, ["M", "VG", "NG", "x"], [0, 3, 8, 99]),
    (parsing.display_artist, ["Nirvana (2)", "A (3) & B (4)", "A (3)x"], ["Nirvana", "A & B", "A (3)x"]),
    (parsing.external_id, ["12", "0", " 7 ", "abc", "1234567890123", None], [12, None, 7, None, None, None]),
    (parsing.whole_number, ["2.5", "-1", "x", "", None, "nan"], [3, -1, None, None, None, None]),
    (parsing.stars, ["0", "51", "255", "300", "130"], [0, 1, 5, 5, 3]),
    (parsing.location_path, ["file://localhost/a%20b+c.mp3", "file:///x", "bad%zz", None], ["/a b+c.mp3", "/x", "bad%zz", None]),
    (parsing.join_text, [",", "&", "", None, " Feat. "], [", ", " & ", "", "", " Feat. "]),
    (parsing.display_date, ["1981-05-10", "1981-05-00", "1981", "x", None], ["10 May 1981", "May 1981", "1981", "Unknown", "Unknown"]),
    (parsing.video_id, ["https://youtu.be/Qz7_xK-92Lm", "https://www.youtube.com/watch?x=1&v=Qz7_xK-92Lm", "http://m.youtube.com/shorts/Qz7_xK-92Lm", "https://evil.com/watch?v=Qz7_xK-92Lm", "https://youtu.be/short", None], ["Qz7_xK-92Lm", "Qz7_xK-92Lm", "Qz7_xK-92Lm", None, None, None]),
    (parsing.bpm_x100, ["124.50", "19.99", "300", "300.01", "x", "90.123"], [12450, None, 30000, None, None, None]),
]


@pytest.mark.parametrize(("f", "inputs", "expected"), CASES)
def test_scalar(spark, f, inputs, expected):
    assert values(spark, f, inputs) == expected


def test_structs(spark):
    assert [tuple(x) if x else None for x in values(spark, parsing.item_ref, ["p:12", "d:7", "x:1", None])] == [("physical", 12), ("digital", 7), None, None]
    assert [tuple(x) for x in values(spark, parsing.date_parts, ["1997-03-00", "1997", None])] == [(1997, 3, None), (1997, None, None), (None, None, None)]
    lines = values(spark, parsing.track_lines, ["A1 | One // X | 6:12\r\n\nA2 | Two\nbad"])[0]
    assert [(x.line, x.position, x.title, x.artist, x.seconds, x.error) for x in lines] == [(1, "A1", "One", "X", 372, None), (3, "A2", "Two", None, None, None), (4, "bad", "", None, None, "position and title needed")]
    ids = values(spark, parsing.identifier_lines, ["Barcode: 5 01 — text\nnope"])[0]
    assert [(x.type, x.value, x.description, x.error) for x in ids] == [("Barcode", "5 01", "text", None), (None, None, None, "use Type: value")]
    media = values(spark, parsing.media_lines, ["A1 | https://youtu.be/Qz7_xK-92Lm\nhttps://x.y"])[0]
    assert [(x.position, x.video, x.error) for x in media] == [("A1", "Qz7_xK-92Lm", None), (None, None, "no video link")]
    assert values(spark, parsing.date_added, ["2019-03-02 14:22:10", "2019-03-02", "2019-02-30", "x"]) == [datetime.datetime(2019, 3, 2, 14, 22, 10), datetime.datetime(2019, 3, 2), None, None]


def test_two_columns(spark):
    df = spark.createDataFrame([("MP3 File", None), ("", "/a/b.flac"), ("Long kind that goes on", None), (None, None)], "k string, l string")
    assert [r[0] for r in df.select(parsing.file_format(F.col("k"), F.col("l"))).collect()] == ["MP3", "FLAC", "Long kind that goes ", None]
    assert spark.range(1).select(text.identity_key(F.lit(None), F.lit("Ä B"), F.lit("T!"), F.lit("C-1"))).first()[0] == "t:b|t|c1"
    assert spark.range(1).select(parsing.join_date(F.lit(1981), F.lit(5), F.lit(None).cast("int"))).first()[0] == "1981-05"
    assert spark.range(1).select(parsing.display_duration(F.lit(372))).first()[0] == "6:12"
    assert spark.range(1).select(parsing.errors_of(a=F.lit(True), b=F.lit(False), c=F.lit(None).cast("boolean"))).first()[0] == ["b"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1000, 2999), st.integers(1, 12), st.integers(1, 28)), min_size=1, max_size=20))
def test_dates_round_trip(spark, dates):
    texts = [f"{y}-{m:02}-{d:02}" for y, m, d in dates]
    assert values(spark, lambda c: parsing.join_date(parsing.date_parts(c)["y"], parsing.date_parts(c)["m"], parsing.date_parts(c)["d"]), texts) == texts


def test_ordering(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "B"), (4, "á"), (5, "a")], "i int, s string")
    assert [r.i for r in df.orderBy(ordering.nulls_last(F.col("s")), "i").collect()][-1] == 2
    assert [r.i for r in df.orderBy(ordering.folded(F.col("s")), "i").collect()] == [2, 5, 1, 3, 4]
    assert [r.r for r in df.orderBy("i").select(ordering.ranked(F.col("s"), ["b", "B"]).cast("int").alias("r")).collect()] == [0, 99, 1, 99, 99]
    assert [r.i for r in ordering.page(df, [F.col("i")], 2, 2).collect()] == [3, 4]
    assert [r.i for r in ordering.keyset_page(df, "i", 3, 1).collect()] == [4]
