"""Queries of the column functions and filters over whole test tables, each beside its SQL.

Where no table holds a format (durations, file locations, links, line texts), the texts are spelled from the table's own
columns by one expression that both sides share; it makes good and bad ones of every kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramoflow.functions import ordering, parsing, text
from gramoflow.operators import reconcile, relational
from gramoflow.plans.catalog import query
from gramoflow.session import table
from gramoflow.sources import dumps

_TWO = "lpad(cast({} AS STRING), 2, '0')"
_DURATION = f"CASE o_orderkey % 6 WHEN 0 THEN concat(o_orderkey % 90, ':', {_TWO.format('o_custkey % 60')}) WHEN 1 THEN concat(o_custkey % 5, ':', {_TWO.format('o_orderkey % 60')}, ':', {_TWO.format('o_custkey % 60')}) WHEN 2 THEN concat(' ', o_orderkey % 9, ':5 ') WHEN 3 THEN 'n/a' WHEN 4 THEN concat(o_orderkey, '1234:00') ELSE NULL END"
_SECONDS = r"CASE WHEN regexp_full_match(trim({0}), '[0-9]{{1,3}}(:[0-9]{{1,3}}){{1,2}}') THEN list_reduce(list_transform(string_split(trim({0}), ':'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 60 + b) END"
_CLOCK = "CASE WHEN {0} IS NOT NULL THEN concat({0} // 60, ':', lpad(CAST({0} % 60 AS VARCHAR), 2, '0')) END"


@query(f"WITH t AS (SELECT o_orderkey, {_DURATION} AS t FROM orders), s AS (SELECT o_orderkey, t, {_SECONDS.format('t')} AS seconds FROM t) SELECT o_orderkey, t, seconds, {_CLOCK.format('seconds')} AS shown FROM s")
def q_durations(spark: SparkSession, d: str) -> DataFrame:  # SCL-03, SCL-21
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_DURATION).alias("t")).withColumn("seconds", parsing.duration_seconds(F.col("t")))
    return o.withColumn("shown", parsing.display_duration(F.col("seconds")))


_NUMBER = "CASE l_linenumber % 5 WHEN 0 THEN concat(' ', cast(l_extendedprice AS STRING)) WHEN 1 THEN 'x1' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE cast(l_partkey AS STRING) END"
_STARS = "CASE WHEN l_linenumber % 2 = 0 THEN cast((l_suppkey % 7) * 51 AS STRING) ELSE cast(cast(l_quantity * 6 AS INT) AS STRING) END"
_BPM = "concat(l_partkey % 400, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.75' ELSE '.255' END)"
_REF = "concat(CASE l_linenumber % 3 WHEN 0 THEN 'p:' WHEN 1 THEN 'd:' ELSE 'x:' END, l_partkey)"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_NUMBER} AS n, {_STARS} AS r, {_BPM} AS b, {_REF} AS i FROM lineitem),
v AS (SELECT *, CAST(floor(TRY_CAST(trim(n) AS DOUBLE) + 0.5) AS BIGINT) AS whole, TRY_CAST(r AS BIGINT) AS rated, CASE WHEN regexp_full_match(b, '[0-9]{{1,3}}([.][0-9]{{1,2}})?') THEN CAST(round(CAST(b AS DECIMAL(8, 2)) * 100) AS INT) END AS beats FROM t)
SELECT l_orderkey, l_linenumber, whole, CAST(greatest(0, least(5, floor(rated / 51 + 0.5))) AS INT) AS stars, NOT (rated % 51 = 0 AND rated BETWEEN 0 AND 255) AS off_grid, CASE WHEN beats BETWEEN 2000 AND 30000 THEN beats END AS bpm,
CASE WHEN i LIKE 'p:%' THEN 'physical' WHEN i LIKE 'd:%' THEN 'digital' END AS item_type, CASE WHEN i NOT LIKE 'x:%' THEN CAST(substr(i, 3) AS BIGINT) END AS item_id FROM v""")
def q_numbers(spark: SparkSession, d: str) -> DataFrame:  # SCL-11, SCL-13, SCL-29, SCL-30
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(n) for n, e in (("n", _NUMBER), ("r", _STARS), ("b", _BPM), ("i", _REF))])
    ref = parsing.item_ref(F.col("i"))
    return t.select("l_orderkey", "l_linenumber", parsing.whole_number(F.col("n")).alias("whole"), parsing.stars(F.col("r")).alias("stars"), parsing.stars_off_grid(F.col("r")).alias("off_grid"), parsing.bpm_x100(F.col("b")).alias("bpm"), ref["item_type"].alias("item_type"), ref["item_id"].alias("item_id"))


@query("SELECT row_id, release_id, nullif(CASE WHEN regexp_full_match(trim(release_id), '[0-9]{1,12}') THEN CAST(trim(release_id) AS BIGINT) END, 0) AS id, CASE WHEN trim(release_id) <> '' AND NOT regexp_full_match(trim(release_id), '[0-9]{1,12}') THEN 'not a numeric id: ' || substr(release_id, 1, 40) END AS error, regexp_replace(lower(rating), '[^a-z0-9#]', '', 'g') AS rating_key FROM collection_rows")
def q_external_ids(spark: SparkSession, d: str) -> DataFrame:  # SCL-09, SCL-17
    r = table(spark, d, "collection_rows").select("row_id", "release_id", "rating")
    return r.select("row_id", "release_id", parsing.external_id(F.col("release_id")).alias("id"), parsing.external_id_error(F.col("release_id")).alias("error"), F.when(F.col("rating").isNotNull(), text.norm_key(F.col("rating"))).alias("rating_key"))


_KIND = "CASE p_partkey % 3 WHEN 0 THEN concat(p_type, ' File') WHEN 1 THEN '' ELSE p_type END"
_LOCATION = "concat('file://localhost/C:/', replace(p_name, ' ', '%20'), '+%C3%A9', CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '' ELSE '%zz' END)"


@query(f"""WITH t AS (SELECT p_partkey, {_KIND} AS kind, {_LOCATION} AS url FROM part), p AS (SELECT *, regexp_replace(url, '^file://(localhost)?', '') AS raw FROM t), q AS (SELECT *, CASE WHEN contains(raw, '%zz') THEN raw ELSE url_decode(raw) END AS path FROM p)
SELECT p_partkey, path, CASE WHEN regexp_full_match(kind, '[A-Za-z0-9]+ File') THEN upper(regexp_extract(kind, '^([A-Za-z0-9]+)', 1)) WHEN kind <> '' THEN substr(kind, 1, 20) WHEN regexp_matches(path, '[.][A-Za-z0-9]{{2,5}}$') THEN upper(regexp_extract(path, '[.]([A-Za-z0-9]{{2,5}})$', 1)) END AS file_format FROM q""")
def q_files(spark: SparkSession, d: str) -> DataFrame:  # SCL-12
    t = table(spark, d, "part").select("p_partkey", F.expr(_KIND).alias("kind"), parsing.location_path(F.expr(_LOCATION)).alias("path"))
    return t.select("p_partkey", "path", parsing.file_format(F.col("kind"), F.col("path")).alias("file_format"))


_NORM = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9#]', '', 'g')"


@query(f"""SELECT DISTINCT library_id, batch_date, row_number, CASE WHEN external_id IS NOT NULL THEN 'r:' || external_id ELSE 't:' || {_NORM.format('artist_text')} || '|' || {_NORM.format('title_text')} || '|' || {_NORM.format('catno_text')} END AS ident,
sha256(CAST(to_json(struct_pack(artist_text := artist_text, catno_text := catno_text, notes := notes, title_text := title_text)) AS VARCHAR)) AS hash,
CASE WHEN source_folder IS NOT NULL THEN 'loc:' || source_folder || '|' || row_number END AS loc, 'meta:' || {_NORM.format('artist_text')} || '|' || {_NORM.format('title_text')} || '|' || {_NORM.format('notes')} || '|' || library_id AS meta FROM parsed_rows""")
def q_identity(spark: SparkSession, d: str) -> DataFrame:  # SCL-09, SCL-10, REC-03, REC-04
    p = table(spark, d, "parsed_rows").select("library_id", "batch_date", "row_number", "external_id", "artist_text", "title_text", "catno_text", "notes", "source_folder").distinct()
    h = reconcile.hints(F.col("source_folder"), F.col("row_number"), F.col("artist_text"), F.col("title_text"), F.col("notes"), F.col("library_id"))
    starts = lambda s: F.element_at(F.concat(F.filter(h, lambda x: x.startswith(s)), F.array(F.lit(None).cast("string"))), 1)
    ident = text.identity_key(F.col("external_id"), F.col("artist_text"), F.col("title_text"), F.col("catno_text"))
    return p.select("library_id", "batch_date", "row_number", ident.alias("ident"), text.content_hash("artist_text", "catno_text", "notes", "title_text").alias("hash"), starts("loc:").alias("loc"), starts("meta:").alias("meta")).distinct()


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'index' WHEN l_returnflag = 'R' THEN 'subtrack' WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN 'heading' ELSE 'track' END AS kind,
CASE WHEN l_quantity > 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '×' ELSE '' END || l_returnflag || CASE WHEN l_linenumber > 2 THEN ', ' || l_linestatus || ', ' || CAST(l_suppkey AS VARCHAR) ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN ' (' || CAST(l_partkey AS VARCHAR) || ')' ELSE '' END AS format_text FROM lineitem""")
def q_track_types(spark: SparkSession, d: str) -> DataFrame:  # SCL-14, SCL-15
    l = table(spark, d, "lineitem")  # noqa: E741
    kind = parsing.track_type(F.col("l_linenumber") == 1, F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") != "O", "A1"), F.when(F.col("l_discount") <= 0.05, "3:00"))
    listed = F.when(F.col("l_linenumber") > 2, F.array(F.col("l_linestatus"), F.lit(None).cast("string"), F.col("l_suppkey").cast("string")))
    shown = parsing.format_text(F.col("l_returnflag"), F.col("l_quantity").cast("int"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")), listed)
    return l.select("l_orderkey", "l_linenumber", kind.alias("kind"), shown.alias("format_text"))


@query("SELECT DISTINCT discogs_id, substr(title, 1, 12) AS short, array_to_string(list_slice(genres.genre, 1, 2), '|') AS first_genres, len(title) > 12 AS cut FROM master_records")
def q_clip(spark: SparkSession, d: str) -> DataFrame:  # SCL-16, SRC-07
    from gramoflow.sources.guards import clipped

    c = clipped(F.col("title"), 12)
    return table(spark, d, "master_records").select("discogs_id", c["text"].alias("short"), F.array_join(text.capped(F.col("genres.genre"), 2), "|").alias("first_genres"), c["cut"].alias("cut")).distinct()


_LINK = "concat(CASE o_orderkey % 6 WHEN 0 THEN 'https://www.youtube.com/watch?t=1&v=' WHEN 1 THEN 'http://youtu.be/' WHEN 2 THEN 'https://m.youtube.com/shorts/' WHEN 3 THEN 'https://www.youtube-nocookie.com/embed/' WHEN 4 THEN 'https://example.org/watch?v=' ELSE 'https://youtube.com/live/' END, 'Q', lpad(cast(o_orderkey AS STRING), CASE WHEN o_custkey % 10 = 0 THEN 9 ELSE 10 END, '_'), CASE WHEN o_custkey % 3 = 0 THEN '#x' ELSE '' END)"


@query(f"""WITH t AS (SELECT o_orderkey, {_LINK} AS u FROM orders), v AS (SELECT o_orderkey, regexp_extract(u, '^https?://(?:(?:www[.]|m[.]|music[.])?youtube(?:-nocookie)?[.]com/(?:watch[?](?:[^#]*&)?v=|embed/|shorts/|live/|v/)|youtu[.]be/)([^/?#&]+)', 1) AS id FROM t)
SELECT o_orderkey, CASE WHEN regexp_full_match(id, '[A-Za-z0-9_-]{{11}}') THEN id END AS video FROM v""")
def q_video_ids(spark: SparkSession, d: str) -> DataFrame:  # SCL-18
    return table(spark, d, "orders").select("o_orderkey", parsing.video_id(F.expr(_LINK)).alias("video"))


_LINES = "concat('A', o_orderkey % 20, ' | Song ', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN concat(' // Guest ', o_custkey % 7) ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN ' | 3:7' ELSE ' | 3:07' END, chr(10), chr(10), CASE WHEN o_orderkey % 5 = 0 THEN ' | ' ELSE 'B1 | ' END, 'Last')"
_IDS = "concat('Barcode: ', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' — side A' ELSE '' END, chr(10), CASE WHEN o_orderkey % 3 = 0 THEN 'no colon here' ELSE concat('Matrix: M-', o_custkey) END)"


@query(f"""WITH t AS (SELECT o_orderkey, {_LINES} AS t FROM orders), x AS (SELECT o_orderkey, unnest(string_split(t, chr(10))) AS raw, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line FROM t),
p AS (SELECT o_orderkey, line, trim(split_part(raw, '|', 1)) AS position, trim(split_part(split_part(raw, '|', 2), ' // ', 1)) AS title, nullif(trim(split_part(split_part(raw, '|', 2), ' // ', 2)), '') AS artist, nullif(trim(split_part(raw, '|', 3)), '') AS length FROM x WHERE trim(raw) <> '')
SELECT o_orderkey, line, position, title, artist, {_SECONDS.format('length')} AS seconds, CASE WHEN position = '' OR title = '' THEN 'position and title needed' WHEN length IS NOT NULL AND NOT regexp_full_match(length, '[0-9]{{1,2}}:[0-9]{{2}}') THEN 'duration must be m:ss' END AS error FROM p""")
def q_track_lines(spark: SparkSession, d: str) -> DataFrame:  # SCL-26
    t = table(spark, d, "orders").select("o_orderkey", F.explode(parsing.track_lines(F.expr(_LINES))).alias("x"))
    return t.select("o_orderkey", F.col("x.line").cast("bigint").alias("line"), "x.position", "x.title", "x.artist", "x.seconds", "x.error")


@query(f"""SELECT o_orderkey, concat('A', o_orderkey % 20, ' | Song ', o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN concat(' // Guest ', o_custkey % 7) ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' | 3:07' END, chr(10), CASE WHEN o_orderkey % 5 = 0 THEN ' | ' ELSE 'B1 | ' END, 'Last') AS tracks,
concat('Barcode: ', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' — side A' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(chr(10), 'Matrix: M-', o_custkey) END) AS ids, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS bad_ids FROM orders""")
def q_line_texts(spark: SparkSession, d: str) -> DataFrame:  # SCL-26: read and written again
    o = table(spark, d, "orders").select("o_orderkey", parsing.track_lines(F.expr(_LINES)).alias("t"), parsing.identifier_lines(F.expr(_IDS)).alias("i"))
    good = F.filter("i", lambda x: x["error"].isNull())
    return o.select("o_orderkey", parsing.track_text(F.col("t")).alias("tracks"), parsing.identifier_text(good).alias("ids"), (F.size("i") - F.size(good)).cast("bigint").alias("bad_ids"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT (length(trim(p_name)) BETWEEN 5 AND 11) THEN 'name' END, CASE WHEN NOT (p_size BETWEEN 1 AND 30) THEN 'size' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#13', 'Brand#21') THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS errors FROM part")
def q_validators(spark: SparkSession, d: str) -> DataFrame:  # SCL-32
    checks = parsing.errors_of(name=parsing.text_check(F.col("p_name"), 5, 11), size=parsing.number_check(F.col("p_size").cast("string"), 1, 30), brand=F.col("p_brand").isin("Brand#11", "Brand#13", "Brand#21"))
    return table(spark, d, "part").select("p_partkey", F.array_join(checks, ",").alias("errors"))


@query("SELECT DISTINCT load_id, CASE lower(format_name) WHEN 'vinyl' THEN 'Vinyl' WHEN 'lathe cut' THEN 'Vinyl' WHEN 'acetate' THEN 'Vinyl' WHEN 'flexi-disc' THEN 'Vinyl' WHEN 'shellac' THEN 'Vinyl' WHEN 'cd' THEN 'CD' WHEN 'cdr' THEN 'CD' WHEN 'sacd' THEN 'CD' WHEN 'hybrid' THEN 'CD' WHEN 'cdv' THEN 'CD' WHEN 'minidisc' THEN 'CD' WHEN 'cassette' THEN 'Cassette' WHEN 'microcassette' THEN 'Cassette' WHEN 'file' THEN 'Digital' ELSE 'Other' END AS format_group, CASE country WHEN 'UK' THEN 'United Kingdom' WHEN 'US' THEN 'United States' ELSE country END AS country FROM release_records")
def q_format_groups(spark: SparkSession, d: str) -> DataFrame:  # SCL-05, SCL-24
    r = table(spark, d, "release_records")
    return r.select("load_id", parsing.format_group(F.col("format_name")).alias("format_group"), parsing.named(F.col("country"), {"UK": "United Kingdom", "US": "United States"}).alias("country")).distinct()


@query("SELECT row_number, library_id, batch_date, media_condition, CASE media_condition WHEN 'M' THEN 0 WHEN 'NM' THEN 1 WHEN 'VG+' THEN 2 WHEN 'VG' THEN 3 WHEN 'G+' THEN 4 WHEN 'G' THEN 5 WHEN 'F' THEN 6 WHEN 'P' THEN 7 WHEN 'NG' THEN 8 ELSE 99 END AS grade_rank, CASE format_group WHEN 'Vinyl' THEN 0 WHEN 'CD' THEN 1 WHEN 'Digital' THEN 2 ELSE 99 END AS group_rank FROM parsed_rows")
def q_ranks(spark: SparkSession, d: str) -> DataFrame:  # SRT-05, SCL-24
    return table(spark, d, "parsed_rows").select("row_number", "library_id", "batch_date", "media_condition", parsing.grade_rank(F.col("media_condition")).alias("grade_rank"), ordering.ranked(F.col("format_group"), ["Vinyl", "CD", "Digital"]).alias("group_rank"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, lower(nullif(c_mktsegment, 'FURNITURE')) ASC NULLS FIRST, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(nullif(c_mktsegment, 'FURNITURE')) DESC NULLS LAST, c_custkey) AS z FROM customer")
def q_sorts(spark: SparkSession, d: str) -> DataFrame:  # SRT-03, SRT-04
    w, seg = Window.partitionBy("c_nationkey"), F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE"))
    a = F.row_number().over(w.orderBy(ordering.true_first(F.col("c_mktsegment") == "BUILDING"), ordering.folded(seg), "c_custkey"))
    z = F.row_number().over(w.orderBy(ordering.folded(seg, descending=True), "c_custkey"))
    return table(spark, d, "customer").select("c_custkey", a.cast("bigint").alias("a"), z.cast("bigint").alias("z"))


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rich, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), f AS (SELECT *, max(CASE WHEN rich = 1 THEN pos END) OVER (PARTITION BY o_custkey) AS old, least(3, n) AS dest FROM p) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN pos = old THEN dest WHEN old < dest AND pos <= dest THEN pos - 1 WHEN old > dest AND pos >= dest THEN pos + 1 ELSE pos END, pos) AS position FROM f")
def q_move_to_place(spark: SparkSession, d: str) -> DataFrame:  # WIN-03: each customer's dearest order to the third place
    p = relational.positions(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    rich = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")) == 1
    return relational.move(p.withColumn("_rich", rich), ["o_custkey"], F.col("_rich"), 3).select("o_custkey", "o_orderkey", "position")


@query("WITH old AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'F') SELECT o.o_custkey, o.o_orderkey, coalesce(last, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS position FROM orders o LEFT JOIN (SELECT o_custkey, max(position) AS last FROM old GROUP BY o_custkey) USING (o_custkey) WHERE o_orderstatus <> 'F'")
def q_append(spark: SparkSession, d: str) -> DataFrame:  # AGG-20
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = relational.positions(o.filter("o_orderstatus = 'F'"), ["o_custkey"], ["o_orderkey"])
    return relational.append_positions(old, o.filter("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


@query("SELECT library_id, batch_date, external_id, row_number, row_number() OVER (PARTITION BY library_id, batch_date, external_id ORDER BY row_number) > 1 AS duplicate FROM (SELECT DISTINCT library_id, batch_date, external_id, row_number FROM parsed_rows WHERE external_id IS NOT NULL)")
def q_first_wins(spark: SparkSession, d: str) -> DataFrame:  # WIN-06
    p = table(spark, d, "parsed_rows").filter("external_id IS NOT NULL").select("library_id", "batch_date", "external_id", "row_number").distinct()
    return relational.first_wins(p, ["library_id", "batch_date", "external_id"], ["row_number"])


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS ext_id, l_linenumber AS n, l_partkey AS part, l_returnflag AS flag, CASE WHEN l_discount > 0.05 THEN '3:0' || l_linenumber END AS dur FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY n, part, flag, dur) AS p FROM l), x AS (SELECT ext_id, p, 0 AS s, 'T' || part AS title, dur, flag = 'R' AS has FROM t UNION ALL SELECT ext_id, p, 1, 'Sub a', '1:00', true FROM t WHERE flag = 'R' UNION ALL SELECT ext_id, p, 2, 'Sub b', '', true FROM t WHERE flag = 'R'),
o AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY p, s) AS sequence FROM x)
SELECT ext_id, sequence, CASE WHEN s > 0 THEN max(CASE WHEN s = 0 THEN sequence END) OVER (PARTITION BY ext_id, p) END AS parent_sequence, title, CASE WHEN has AND s = 0 THEN 'index' WHEN s > 0 THEN 'subtrack' WHEN coalesce(dur, '') = '' THEN 'heading' ELSE 'track' END AS track_type FROM o""")
def q_preorder(spark: SparkSession, d: str) -> DataFrame:  # WIN-08, SCL-15
    no = F.lit(None).cast("string")
    track = lambda title, dur: [no.alias("position"), title.alias("title"), dur.alias("duration")]
    subs = F.when(F.col("l_returnflag") == "R", F.array(F.struct(*track(F.lit("Sub a"), F.lit("1:00"))), F.struct(*track(F.lit("Sub b"), F.lit("")))))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ext_id"), "l_linenumber", "l_partkey", "l_returnflag", F.when(F.col("l_discount") > 0.05, F.concat(F.lit("3:0"), "l_linenumber")).alias("dur")).distinct()  # noqa: E741
    one = F.struct("l_linenumber", "l_partkey", "l_returnflag", F.coalesce("dur", F.lit("~")).alias("k"), F.struct(*track(F.concat(F.lit("T"), "l_partkey"), F.col("dur")), F.struct(subs.alias("track")).alias("sub_tracks")).alias("t"))
    r = l.groupBy("ext_id").agg(F.array_sort(F.collect_list(one)).alias("x")).select("ext_id", F.struct(F.transform("x", lambda e: e["t"]).alias("track")).alias("tracklist"))
    return dumps.tracks(r).select("ext_id", F.col("sequence").cast("bigint").alias("sequence"), F.col("parent_sequence").cast("bigint").alias("parent_sequence"), "title", "track_type")


@query("SELECT discogs_id, arg_max(title, (dump_date, load_id)) AS title FROM (SELECT DISTINCT discogs_id, dump_date, load_id, title FROM release_records) GROUP BY discogs_id")
def q_union_last(spark: SparkSession, d: str) -> DataFrame:  # SET-04: the dumps in order, the later row of a record stays
    r = table(spark, d, "release_records").select("discogs_id", "dump_date", "load_id", "title").distinct()
    days = ("2025-03-01", "2025-04-01", "2025-05-01", "2025-06-01")
    parts = [relational.last_wins(r.filter(F.col("dump_date") == day), ["discogs_id"], ["load_id"]).select("discogs_id", "title") for day in days]
    return relational.union_last(parts, ["discogs_id"])


@query("SELECT row_id, format_raw, media_condition FROM collection_rows WHERE list_contains(string_split(lower(coalesce(format_raw, '')), ', '), 'lp') AND storage_box IS NULL AND lower(media_condition) = 'not graded'")
def q_member_filter(spark: SparkSession, d: str) -> DataFrame:  # FLT-06, FLT-07, FLT-11
    c = table(spark, d, "collection_rows").select("row_id", "format_raw", "media_condition", "storage_box")
    c = c.filter(relational.list_member(F.col("format_raw"), ", ", "LP") & relational.in_group(F.col("storage_box"), "(none)") & relational.same_text(F.col("media_condition"), F.lit("NOT graded")))
    return relational.public(c, ["row_id", "format_raw", "media_condition"], frozenset({"storage_box"}))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def q_optional_filter(spark: SparkSession, d: str) -> DataFrame:  # FLT-08, PRJ-05: a status is asked for, a priority is not
    return relational.public(relational.optional(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None), ["o_orderkey", "o_orderpriority"], frozenset({"o_totalprice"}))


@query("SELECT DISTINCT load_id, format_name || coalesce(', ' || format_details, '') AS shown FROM release_records")
def q_null_concat(spark: SparkSession, d: str) -> DataFrame:  # PRJ-03
    return table(spark, d, "release_records").select("load_id", F.concat("format_name", F.coalesce(F.concat(F.lit(", "), "format_details"), F.lit(""))).alias("shown")).distinct()


@query("WITH n AS (SELECT DISTINCT discogs_id, name FROM (SELECT *, row_number() OVER (PARTITION BY discogs_id ORDER BY dump_date DESC, load_id DESC) AS rn FROM label_records) WHERE rn = 1 AND NOT coalesce(deleted, false)) SELECT discogs_id, name, (SELECT count(*) > 100 FROM n) AS truncated FROM n ORDER BY lower(name), discogs_id LIMIT 100")
def q_label_list(spark: SparkSession, d: str) -> DataFrame:  # QRY-06, SRT-10: the first hundred by name, and whether there are more
    l = relational.last_wins(table(spark, d, "label_records").select("discogs_id", "name", "deleted", "dump_date", "load_id"), ["discogs_id"], ["dump_date", "load_id"])  # noqa: E741
    first, more = relational.capped_candidates(l.filter("NOT coalesce(deleted, false)").select("discogs_id", "name"), [ordering.folded(F.col("name")), F.col("discogs_id")], 100)
    return first.withColumn("truncated", F.lit(more))
