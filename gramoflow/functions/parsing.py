"""Parsers of the formats found in dumps and exports (SCL-03..08, 11..18, 21, 26, 27, 29, 30, 32)."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format names by group.
FORMAT_GROUPS = {
    "Vinyl": ("vinyl", "lathe cut", "acetate", "flexi-disc", "shellac"),
    "CD": ("cd", "cdr", "sacd", "hybrid", "cdv", "minidisc"),
    "Cassette": ("cassette", "microcassette"),
    "Digital": ("file",),
}
# How the first part of a typed format may begin, by group.
FORMAT_BEGINNINGS = {
    "Vinyl": ("vinyl", "lp", '12"', '10"', '7"', "lathe cut", "acetate", "flexi-disc", "flexidisc", "shellac"),
    "CD": ("cd", "sacd", "hybrid", "minidisc"),
    "Cassette": ("cass", "microcassette"),
    "Digital": ("file",),
}
# Patterns of typed grades in the order in which they apply.
GRADE_PATTERNS = (
    ("M", r"^mint\b|\(m\)$"),
    ("NM", r"near mint|\(nm|m-\)"),
    ("VG+", r"very good plus|\(vg\+\)"),
    ("VG", r"very good|\(vg\)"),
    ("G+", r"good plus|\(g\+\)"),
    ("G", r"^good\b|\(g\)"),
    ("F", r"fair|\(f\)"),
    ("P", r"poor|\(p\)"),
    ("GENERIC", r"generic"),
    ("NONE", r"no cover|no sleeve"),
    ("NG", r"not graded"),
)
# Grades from best to worst.
GRADE_ORDER = ("M", "NM", "VG+", "VG", "G+", "G", "F", "P", "NG")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _chain(cases: list[tuple[Column, object]], default: object) -> Column:
    out = None
    for when, value in cases:
        out = F.when(when, F.lit(value)) if out is None else out.when(when, F.lit(value))
    return out.otherwise(F.lit(default))


def format_group(c: Column) -> Column:
    """Group of an exact format name (SCL-05)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return _chain([(low.isin(*names), group) for group, names in FORMAT_GROUPS.items()], "Other")


def typed_format_group(c: Column) -> Column:
    """Group by the first part of a typed format, without a quantity (SCL-06)."""
    first = F.regexp_replace(F.trim(F.split(F.coalesce(c, F.lit("")), "[,+]").getItem(0)), r"(?i)^\d+\s*[x×]\s*", "")
    low = F.lower(first)
    cases = [(functools.reduce(lambda a, b: a | b, [low.startswith(p) for p in beginnings]), group) for group, beginnings in FORMAT_BEGINNINGS.items()]
    return _chain(cases, "Other")


def grade(c: Column) -> Column:
    """First grade whose pattern occurs; blank and unknown are NG (SCL-07)."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return _chain([(low.rlike(p), code) for code, p in GRADE_PATTERNS], "NG")


def grade_is_known(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (low == "") | functools.reduce(lambda a, b: a | b, [low.rlike(p) for _, p in GRADE_PATTERNS])


def grade_rank(c: Column) -> Column:
    """Place in the order of grades, 99 for others (SRT-05)."""
    return _chain([(c == g, i) for i, g in enumerate(GRADE_ORDER)], 99)


def year_in(c: Column, least: int, most: int, at_start: bool = False) -> Column:
    """First four digits (of the text, or at its start) within a range (SCL-04, SCL-08)."""
    y = F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})" if at_start else r"(\d{4})", 1).try_cast("int")
    return F.when(y.between(least, most), y)


def duration_seconds(c: Column) -> Column:
    """m:ss or h:mm:ss, one to three digits each; else null (SCL-03)."""
    t = F.trim(c)
    fold = F.aggregate(F.split(t, ":"), F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p.try_cast("bigint"))
    return F.when(t.rlike(r"\A\d{1,3}(:\d{1,3}){1,2}\z"), fold)


def date_added(c: Column) -> Column:
    """YYYY-MM-DD[ HH:MM[:SS]] at the start of the text as a timestamp; months and days out of range roll over to null (SCL-08)."""
    part = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)", 1)
    text = F.replace(part, F.lit("T"), F.lit(" "))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])


def display_artist(c: Column) -> Column:
    """Without the number in parentheses at the end or before a separator (SCL-08)."""
    return F.trim(F.regexp_replace(c, r"\s+\(\d+\)(?=$|\s*[,&/])", ""))


def external_id(c: Column) -> Column:
    """1 to 12 digits as a number; 0, blank and anything else are null (SCL-17)."""
    return F.nullif(F.when(F.trim(c).rlike(r"\A\d{1,12}\z"), F.trim(c).try_cast("bigint")), F.lit(0))


def external_id_error(c: Column) -> Column:
    """Message for an id that is given but is none."""
    return F.when((F.trim(c) != "") & ~F.trim(c).rlike(r"\A\d{1,12}\z"), F.concat(F.lit("not a numeric id: "), F.substring(c, 1, 40)))


def whole_number(c: Column) -> Column:
    """Numbers rounded half up; null for what is none (SCL-13)."""
    n = F.trim(c).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 9e18), F.floor(n + 0.5).cast("bigint"))


def stars(c: Column) -> Column:
    """0, 51, .. 255 as 0 to 5 (SCL-11)."""
    n = whole_number(c)
    return F.greatest(F.lit(0), F.least(F.lit(5), F.floor(n / 51 + 0.5))).cast("int")


def stars_off_grid(c: Column) -> Column:
    """True for a number that is no multiple of 51 from 0 to 255 and so was rounded."""
    n = whole_number(c)
    return n.isNotNull() & ~((n % 51 == 0) & n.between(0, 255))


def named(c: Column, names: dict[str, str]) -> Column:
    """The name of a code; an unknown code as it is (SCL-24)."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def format_text(name: Column, quantity: Column, note: Column, descriptions: Column) -> Column:
    """``2×Vinyl, LP, Album (red)``: the quantity if over 1, name, descriptions and note (SCL-14)."""
    listed = F.array_compact(F.coalesce(descriptions, F.array().cast("array<string>")))
    return F.concat(
        F.when(quantity > 1, F.concat(quantity.cast("string"), F.lit("×"))).otherwise(""),
        F.coalesce(name, F.lit("")),
        F.when(F.size(listed) > 0, F.concat(F.lit(", "), F.array_join(listed, ", "))).otherwise(""),
        F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""),
    )


def file_format(kind: Column, location: Column) -> Column:
    """``MP3 File`` -> MP3; another kind as it is (20 characters); else the extension (SCL-12)."""
    k = F.trim(F.coalesce(kind, F.lit("")))
    named = F.regexp_extract(k, r"(?i)^([A-Za-z0-9]+)\s+File$", 1)
    ext = F.regexp_extract(F.coalesce(location, F.lit("")), r"(?i)\.([a-z0-9]{2,5})$", 1)
    return F.when(named != "", F.upper(named)).when(k != "", F.substring(k, 1, 20)).when(ext != "", F.upper(ext))


def location_path(c: Column) -> Column:
    """Path of a file URL, percent-decoded; as it is where that fails. A plus stays a plus (SCL-12)."""
    raw = F.regexp_replace(c, r"(?i)^file://(localhost)?", "")
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def join_text(c: Column) -> Column:
    """How two credits are joined: a comma sticks to the first, all else stands between spaces (SCL-14)."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").when(t == ",", ", ").otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def track_type(has_sub: Column, is_sub: Column, position: Column, duration: Column) -> Column:
    """index, subtrack, heading or track (SCL-15)."""
    nothing = (F.coalesce(position, F.lit("")) == "") & (F.coalesce(duration, F.lit("")) == "")
    return F.when(has_sub, "index").when(is_sub, "subtrack").when(nothing, "heading").otherwise("track")


def date_parts(c: Column) -> Column:
    """struct(y, m, d) of a partial date; 00 is null (SCL-27)."""
    part = lambda i: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", i).try_cast("int"), F.lit(0))
    year = F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4})", 1).try_cast("int")
    return F.struct(year.alias("y"), F.when(year.isNotNull(), part(2)).alias("m"), F.when(year.isNotNull(), part(3)).alias("d"))


def join_date(y: Column, m: Column, d: Column) -> Column:
    """The partial date as text; a day without a month is dropped."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(F.coalesce(y, F.lit(0)) != 0, F.when(m.isNull(), y.cast("string")).when(d.isNull(), F.concat_ws("-", y.cast("string"), two(m))).otherwise(F.concat_ws("-", y.cast("string"), two(m), two(d))))


def display_date(c: Column) -> Column:
    """10 May 1981, May 1981, 1981 or Unknown (SCL-21)."""
    p = date_parts(c)
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), p["m"] - 1)
    return F.when(p["y"].isNull(), "Unknown").when(month.isNull(), p["y"].cast("string")).when(p["d"].isNull(), F.concat_ws(" ", month, p["y"])).otherwise(F.concat_ws(" ", p["d"], month, p["y"]))


def display_duration(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")))


def video_id(c: Column) -> Column:
    """Id of a link to a video host's watch, embed, shorts, live or short address (SCL-18)."""
    u = F.trim(c)
    short = F.regexp_extract(u, r"(?i)^https?://(?:www\.|m\.|music\.)?youtu\.be/([^/?#]+)", 1)
    path = F.regexp_extract(u, r"(?i)^https?://(?:www\.|m\.|music\.)?youtube(?:-nocookie)?\.com/(?:embed|shorts|live|v)/([^/?#]+)", 1)
    watch = F.regexp_extract(u, r"(?i)^https?://(?:www\.|m\.|music\.)?youtube(?:-nocookie)?\.com/watch\?(?:[^#]*&)?v=([^&#]+)", 1)
    found = F.concat(short, path, watch)
    return F.when(found.rlike(r"\A[A-Za-z0-9_-]{11}\z"), found)


def bpm_x100(c: Column) -> Column:
    """20 to 300 with up to two decimals, times 100 (SCL-30)."""
    t = F.trim(c)
    value = F.when(t.rlike(r"\A\d{1,3}(\.\d{1,2})?\z"), F.round(t.try_cast("decimal(6,2)") * 100, 0).cast("int"))
    return F.when(value.between(2000, 30000), value)


def item_ref(c: Column) -> Column:
    """``p:12`` and ``d:7`` as struct(item_type, item_id) (SCL-29)."""
    kind, number = F.regexp_extract(c, r"\A([pd]):(\d{1,12})\z", 1), F.regexp_extract(c, r"\A([pd]):(\d{1,12})\z", 2)
    return F.when(kind != "", F.struct(F.when(kind == "p", "physical").otherwise("digital").alias("item_type"), number.try_cast("bigint").alias("item_id")))


def track_lines(c: Column) -> Column:
    """Lines ``position | title // artist | m:ss`` as array of struct(line, position, title, artist, seconds, error) (SCL-26)."""

    def one(x: Column, i: Column) -> Column:
        parts = F.transform(F.split(x, r"\|"), lambda p: F.trim(p))
        names = F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), " // "), lambda p: F.trim(p))
        length = F.nullif(F.get(parts, F.lit(2)), F.lit(""))
        missing = (F.coalesce(F.get(parts, F.lit(0)), F.lit("")) == "") | (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) == "")
        bad_time = length.isNotNull() & ~F.coalesce(length.rlike(r"\A\d{1,2}:\d{2}\z"), F.lit(False))
        return F.struct(
            (i + 1).alias("line"),
            F.substring(F.get(parts, F.lit(0)), 1, 10).alias("position"),
            F.substring(F.get(names, F.lit(0)), 1, 200).alias("title"),
            F.substring(F.nullif(F.get(names, F.lit(1)), F.lit("")), 1, 200).alias("artist"),
            duration_seconds(length).alias("seconds"),
            F.when(missing, "position and title needed").when(bad_time, "duration must be m:ss").alias("error"),
            x.alias("raw"),
        )

    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), one)
    return F.filter(lines, lambda s: F.trim(s["raw"]) != "")


def track_text(lines: Column) -> Column:
    """Lines of struct(position, title, artist, seconds) as text that ``track_lines`` reads (SCL-26)."""

    def one(t: Column) -> Column:
        title = F.concat(F.coalesce(t["title"], F.lit("")), F.when(t["artist"].isNotNull(), F.concat(F.lit(" // "), t["artist"])).otherwise(""))
        return F.concat_ws(" | ", F.coalesce(t["position"], F.lit("")), title, display_duration(t["seconds"]))

    return F.array_join(F.transform(lines, one), "\n")


def identifier_text(lines: Column) -> Column:
    """Lines of struct(type, value, description) as text that ``identifier_lines`` reads (SCL-26)."""
    return F.array_join(F.transform(lines, lambda i: F.concat(i["type"], F.lit(": "), i["value"], F.when(i["description"].isNotNull(), F.concat(F.lit(" — "), i["description"])).otherwise(""))), "\n")


def identifier_lines(c: Column) -> Column:
    """Lines ``Type: value — description`` as array of struct(line, type, value, description, error) (SCL-26)."""

    def one(x: Column, i: Column) -> Column:
        t = F.trim(x)
        kind, rest = F.regexp_extract(t, r"^([^:]{2,40}):\s*(.+)$", 1), F.regexp_extract(t, r"^([^:]{2,40}):\s*(.+)$", 2)
        parts = F.transform(F.split(rest, " — "), lambda p: F.trim(p))
        return F.struct(
            (i + 1).alias("line"),
            F.substring(F.nullif(F.trim(kind), F.lit("")), 1, 40).alias("type"),
            F.substring(F.nullif(F.get(parts, F.lit(0)), F.lit("")), 1, 200).alias("value"),
            F.substring(F.nullif(F.get(parts, F.lit(1)), F.lit("")), 1, 200).alias("description"),
            F.when(kind == "", "use Type: value").alias("error"),
            x.alias("raw"),
        )

    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), one), lambda s: F.trim(s["raw"]) != "")


def media_lines(c: Column) -> Column:
    """Lines ``[position |] link`` as array of struct(line, position, video, error) (SCL-26)."""

    def one(x: Column, i: Column) -> Column:
        parts = F.transform(F.split(x, r"\|"), lambda p: F.trim(p))
        link = F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
        position = F.when(F.size(parts) >= 2, F.substring(F.nullif(F.get(parts, F.lit(0)), F.lit("")), 1, 10))
        return F.struct((i + 1).alias("line"), position.alias("position"), video_id(link).alias("video"), F.when(video_id(link).isNull(), "no video link").alias("error"), x.alias("raw"))

    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), one), lambda s: F.trim(s["raw"]) != "")


def errors_of(**checks: Column) -> Column:
    """Names of the failed checks as an array (SCL-32): each check is true where the value is fine, null counts as fine."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in checks.items()]))


def text_check(c: Column, least: int, most: int) -> Column:
    return F.length(F.trim(c)).between(least, most)


def number_check(c: Column, least: int, most: int) -> Column:
    return F.coalesce(F.trim(c).try_cast("bigint").between(least, most), c.isNull())
