"""Queries of the operator families over the test tables, each beside its SQL.

Comments name the operators of the survey. A limit stands where paging or a top-k is the operator itself. Queries that
filter their input ask for certain ids or owners.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramoflow.functions import ordering, parsing, text
from gramoflow.operators import duplicates, entities, quality, reconcile, relational, search, upsert
from gramoflow.operators.scale import shared_dir, stage
from gramoflow.session import table
from gramoflow.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def releases(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """discogs_id and the columns of the newest row of each release that is not deleted; only they are read and shuffled."""
    r = relational.last_wins(table(spark, d, "release_records").select("discogs_id", "dump_date", "load_id", "status", *columns), ["discogs_id"], ["dump_date", "load_id"])
    return r.filter("status IS DISTINCT FROM 'Deleted'").select("discogs_id", *columns)


_LIVE = """live AS (
  SELECT discogs_id, status, title, released, country, master_discogs_id, format_name, format_details, label_name, catalog_number FROM (
    SELECT *, row_number() OVER (PARTITION BY discogs_id ORDER BY dump_date DESC, load_id DESC) AS rn FROM release_records)
  WHERE rn = 1 AND status IS DISTINCT FROM 'Deleted')"""


@query(f"""
WITH {_LIVE}, keyed AS (
  SELECT coalesce('m' || master_discogs_id, 'r' || discogs_id) AS work, discogs_id,
         CASE WHEN regexp_matches(released, '^[0-9]{{4}}') AND CAST(substr(released, 1, 4) AS INT) BETWEEN 1850 AND 2100 THEN CAST(substr(released, 1, 4) AS INT) END AS y FROM live)
SELECT work, count(*) AS n, min(discogs_id) AS first_id, string_agg(CAST(discogs_id AS VARCHAR), ',' ORDER BY discogs_id) AS ids, CAST(min(y) AS INT) AS year
FROM keyed GROUP BY work ORDER BY year ASC NULLS LAST, work LIMIT 24 OFFSET 24""")
def q_browse_works(spark: SparkSession, d: str) -> DataFrame:  # AGG-04, AGG-05, JOI-11, SRT-01, SRT-07, QRY-01
    work = F.coalesce(F.concat(F.lit("m"), F.col("master_discogs_id")), F.concat(F.lit("r"), F.col("discogs_id")))
    year = parsing.year_in(F.col("released"), 1850, 2100, at_start=True)
    g = releases(spark, d, "master_discogs_id", "released").groupBy(work.alias("work")).agg(F.count("*").alias("n"), F.min("discogs_id").alias("first_id"), F.array_join(F.array_sort(F.collect_list("discogs_id")).cast("array<string>"), ",").alias("ids"), F.min(year).alias("year"))
    return ordering.page(g, [ordering.nulls_last(F.col("year")), F.col("work")], 2, 24)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "master_records")
    return relational.union_distinct(m.select("discogs_id", F.explode("genres.genre").alias("term")), m.select("discogs_id", F.explode("styles.style").alias("term")))


_TERMS = "terms AS (SELECT discogs_id, unnest(genres.genre) AS term FROM master_records UNION SELECT discogs_id, unnest(styles.style) FROM master_records)"


@query(f"WITH {_TERMS} SELECT DISTINCT discogs_id, title FROM master_records WHERE discogs_id IN (SELECT discogs_id FROM terms WHERE term IN ('Jazz', 'House'))")
def q_terms_any(spark: SparkSession, d: str) -> DataFrame:  # JOI-03, JOI-05, SET-03
    return relational.with_terms(table(spark, d, "master_records").select("discogs_id", "title").distinct(), _terms(spark, d), "discogs_id", ["Jazz", "House"], every=False)


@query(f"WITH {_TERMS} SELECT DISTINCT discogs_id, title FROM master_records WHERE discogs_id IN (SELECT discogs_id FROM terms WHERE term IN ('Pop', 'House') GROUP BY discogs_id HAVING count(DISTINCT term) = 2)")
def q_terms_all(spark: SparkSession, d: str) -> DataFrame:  # JOI-10
    return relational.with_terms(table(spark, d, "master_records").select("discogs_id", "title").distinct(), _terms(spark, d), "discogs_id", ["Pop", "House"], every=True)


@query(f"WITH {_LIVE} SELECT discogs_id, title FROM live WHERE EXISTS (SELECT 1 FROM credits c WHERE c.owner_type = 'release' AND c.owner_id = live.discogs_id AND c.role = 'Bass')")
def q_credited_semi(spark: SparkSession, d: str) -> DataFrame:  # JOI-03
    c = table(spark, d, "credits").filter("owner_type = 'release' AND role = 'Bass'").select(F.col("owner_id").alias("discogs_id"))
    return releases(spark, d, "title").join(c, "discogs_id", "left_semi").select("discogs_id", "title")


@query(f"WITH {_LIVE} SELECT DISTINCT discogs_id, title FROM master_records m WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.master_discogs_id = m.discogs_id)")
def q_no_release_anti(spark: SparkSession, d: str) -> DataFrame:  # JOI-04, SET-05
    used = releases(spark, d, "master_discogs_id").select(F.col("master_discogs_id").alias("discogs_id"))
    return table(spark, d, "master_records").select("discogs_id", "title").distinct().join(used, "discogs_id", "left_anti")


@query(f"WITH {_LIVE}, {_TERMS} SELECT 'country' AS kind, country AS value FROM live WHERE country IS NOT NULL UNION SELECT 'format', format_name FROM live WHERE format_name IS NOT NULL UNION SELECT 'term', term FROM terms WHERE term IS NOT NULL")
def q_facets(spark: SparkSession, d: str) -> DataFrame:  # AGG-12, QRY-02
    r = releases(spark, d, "country", "format_name")
    return relational.union_distinct(
        r.select(F.lit("country").alias("kind"), F.col("country").alias("value")), r.select(F.lit("format").alias("kind"), F.col("format_name").alias("value")), _terms(spark, d).select(F.lit("term").alias("kind"), F.col("term").alias("value"))
    ).filter("value IS NOT NULL")


@query("SELECT p_partkey, p_name, coalesce(n, 0) AS n_lines, coalesce(open_lines, 0) AS n_open, first_ship FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS open_lines, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def q_part_summary(spark: SparkSession, d: str) -> DataFrame:  # JOI-02, JOI-08, AGG-01, AGG-03, PRJ-01
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("o"), F.min("l_shipdate").alias("first_ship"))
    return table(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("o", F.lit(0)).alias("n_open"), "first_ship")


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def q_first_order(spark: SparkSession, d: str) -> DataFrame:  # JOI-09, WIN-04
    return relational.first_per_group(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT coalesce(role, '(none)') AS role, owner_type, count(*) AS n, count(DISTINCT discogs_artist_id) AS artists FROM credits GROUP BY ALL")
def q_roles_histogram(spark: SparkSession, d: str) -> DataFrame:  # AGG-02, AGG-07, AGG-14, QRY-09
    return table(spark, d, "credits").groupBy(F.coalesce("role", F.lit("(none)")).alias("role"), "owner_type").agg(F.count("*").alias("n"), F.count_distinct("discogs_artist_id").alias("artists"))


@query("SELECT owner_id, 'Main artist' AS role FROM credits WHERE owner_type = 'release' AND role IS NULL UNION SELECT owner_id, role FROM credits WHERE owner_type = 'release' AND role IS NOT NULL")
def q_contributions(spark: SparkSession, d: str) -> DataFrame:  # SET-02, QRY-07
    c = table(spark, d, "credits").filter("owner_type = 'release'")
    return relational.union_distinct(c.filter("role IS NULL").select("owner_id", F.lit("Main artist").alias("role")), c.filter("role IS NOT NULL").select("owner_id", "role"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def q_keyset_page(spark: SparkSession, d: str) -> DataFrame:  # SRT-08, PRJ-07
    return ordering.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 1000)


@query("SELECT load_id, catalog_number, regexp_replace(upper(catalog_number), '[^A-Z0-9]', '', 'g') AS code FROM release_records WHERE regexp_replace(upper(catalog_number), '[^A-Z0-9]', '', 'g') LIKE 'A%' GROUP BY ALL")
def q_code_prefix(spark: SparkSession, d: str) -> DataFrame:  # FLT-03, SCL-02
    r = table(spark, d, "release_records").select("load_id", "catalog_number").distinct().withColumn("code", text.normalize_code(F.col("catalog_number")))
    return r.filter(F.col("code").startswith("A"))


@query("WITH f AS (SELECT p_partkey, unnest(['p_brand', 'p_type', 'p_size']) AS field, unnest([p_brand, p_type, CAST(p_size AS VARCHAR)]) AS v FROM part WHERE p_partkey IN (1, 2, 3)) SELECT field, string_agg(coalesce(nullif(v, ''), '—'), '|' ORDER BY p_partkey) AS vals, count(DISTINCT coalesce(nullif(v, ''), '—')) > 1 AS differs FROM f GROUP BY field")
def q_compare_parts(spark: SparkSession, d: str) -> DataFrame:  # QRY-04
    p = table(spark, d, "part").filter(F.col("p_partkey").isin(1, 2, 3))
    return relational.compare(p, "p_partkey", ["p_brand", "p_type", "p_size"]).withColumn("vals", F.array_join("vals", "|"))


@query("WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS k, CAST(NULL AS VARCHAR) AS p, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier), w AS (SELECT k, name AS path, 0 AS depth FROM n WHERE p IS NULL UNION ALL SELECT n.k, w.path || ' / ' || n.name, w.depth + 1 FROM n JOIN w ON n.p = w.k) SELECT k, path, depth FROM w")
def q_hierarchy_path(spark: SparkSession, d: str) -> DataFrame:  # JOI-07, QRY-08, QRY-26
    r, n, s = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    nodes = (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("k"), F.lit(None).cast("string").alias("p"), F.col("r_name").alias("name"))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.concat(F.lit("r"), "n_regionkey").alias("p"), F.col("n_name").alias("name")))
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("k"), F.concat(F.lit("n"), "s_nationkey").alias("p"), F.col("s_name").alias("name")))
    )
    return relational.paths(nodes, "k", "p", "name")


_ITEMS = "items AS (SELECT DISTINCT 'physical' AS item_type, row_id AS item_id, library_id, artist, title, label, format_raw, folder, CAST(NULL AS INT) AS version FROM collection_rows UNION ALL SELECT DISTINCT 'digital', row_number, library_id, artist_text, title_text, CAST(NULL AS VARCHAR), format_group, source_folder, 1 FROM parsed_rows WHERE target = 'digital')"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Physical and digital holdings in one shape."""
    c, p = table(spark, d, "collection_rows"), table(spark, d, "parsed_rows")
    a = c.select(F.lit("physical").alias("item_type"), F.col("row_id").alias("item_id"), "library_id", "artist", "title", "label", "format_raw", "folder", F.lit(None).cast("int").alias("version")).distinct()
    b = p.filter("target = 'digital'").select(F.lit("digital").alias("item_type"), F.col("row_number").cast("bigint").alias("item_id"), "library_id", F.col("artist_text").alias("artist"), F.col("title_text").alias("title"), F.lit(None).cast("string").alias("label"), F.col("format_group").alias("format_raw"), F.col("source_folder").alias("folder"), F.lit(1).alias("version"))
    return a.unionByName(b.distinct())


@query(f"WITH {_ITEMS} SELECT item_type, library_id, count(*) AS n, count(label) AS labelled FROM items GROUP BY ALL")
def q_library_items(spark: SparkSession, d: str) -> DataFrame:  # SET-01, PRJ-04
    return items(spark, d).groupBy("item_type", "library_id").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


@query(f"WITH {_ITEMS} SELECT item_type, item_id, artist, title FROM items WHERE library_id = 1000 AND (contains(lower(coalesce(artist, '')), 'the') OR contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(label, '')), 'the')) AND (contains(lower(coalesce(artist, '')), 'vol') OR contains(lower(coalesce(title, '')), 'vol') OR contains(lower(coalesce(label, '')), 'vol')) AND NOT (item_type = 'digital' AND item_id = 7)")
def q_library_filter(spark: SparkSession, d: str) -> DataFrame:  # FLT-04, FLT-09, FLT-10, FLT-11
    i = items(spark, d).filter("library_id = 1000")
    hit = relational.contains_tokens("THE Vol", F.col("artist"), F.col("title"), F.col("label"))
    return i.filter(hit & ~((F.col("item_type") == "digital") & (F.col("item_id") == 7))).select("item_type", "item_id", "artist", "title")


@query(f"WITH {_ITEMS} SELECT coalesce(label, '(none)') AS key, count(*) AS n FROM items GROUP BY ALL")
def q_group_counts(spark: SparkSession, d: str) -> DataFrame:  # AGG-09, QRY-12
    return relational.group_counts(items(spark, d), F.col("label"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(CASE WHEN nullif(format_raw, '') IS NULL THEN ['(none)'] ELSE string_split(format_raw, ', ') END) AS key FROM collection_rows) GROUP BY key")
def q_split_group_counts(spark: SparkSession, d: str) -> DataFrame:  # AGG-08
    return relational.split_counts(table(spark, d, "collection_rows"), F.col("format_raw"), ", ")


@query("SELECT 1 AS section, coalesce(folder, '(none)') AS key, count(*) AS n FROM collection_rows GROUP BY ALL UNION ALL SELECT 2, coalesce(storage_box, '(none)'), count(*) FROM collection_rows GROUP BY ALL")
def q_group_sections(spark: SparkSession, d: str) -> DataFrame:  # AGG-10
    c = table(spark, d, "collection_rows")
    return relational.group_counts(c, F.col("folder")).withColumn("section", F.lit(1)).unionByName(relational.group_counts(c, F.col("storage_box")).withColumn("section", F.lit(2)))


@query(f"WITH {_ITEMS} SELECT count(*) AS total, count(*) FILTER (item_type = 'physical') AS physical, count(*) FILTER (item_type = 'digital') AS digital, count(DISTINCT library_id) AS libraries, count(*) FILTER (label IS NULL) AS unlabelled, count(DISTINCT artist) AS artists FROM items")
def q_library_counts(spark: SparkSession, d: str) -> DataFrame:  # AGG-01, AGG-02, AGG-11, QRY-13
    kind = F.col("item_type")
    return items(spark, d).agg(F.count("*").alias("total"), F.count_if(kind == "physical").alias("physical"), F.count_if(kind == "digital").alias("digital"), F.count_distinct("library_id").alias("libraries"), F.count_if(F.col("label").isNull()).alias("unlabelled"), F.count_distinct("artist").alias("artists"))


@query(f"WITH {_LIVE}, k AS (SELECT discogs_id, master_discogs_id AS m, CASE WHEN catalog_number <> 'none' THEN catalog_number END AS c FROM live) SELECT a.discogs_id, b.discogs_id AS other, 'm' AS reason FROM k a JOIN k b ON a.m = b.m AND a.discogs_id <> b.discogs_id WHERE a.discogs_id % 100 = 0 UNION ALL SELECT a.discogs_id, b.discogs_id, 'c' FROM k a JOIN k b ON a.c = b.c AND a.m IS NULL AND b.m IS NULL AND a.discogs_id <> b.discogs_id WHERE a.discogs_id % 100 = 0")
def q_related(spark: SparkSession, d: str) -> DataFrame:  # QRY-14: asked for the releases whose id is divisible by 100, against all
    k = releases(spark, d, "master_discogs_id", "catalog_number").select("discogs_id", F.col("master_discogs_id").alias("m"), F.when(F.col("catalog_number") != "none", F.col("catalog_number")).alias("c"))
    return relational.related(k.filter("discogs_id % 100 = 0"), k, "discogs_id", "m", "c")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def q_positions(spark: SparkSession, d: str) -> DataFrame:  # WIN-01, WIN-02
    return relational.positions(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position")


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN pos = n THEN 1 ELSE pos + 1 END AS position FROM p")
def q_move_to_top(spark: SparkSession, d: str) -> DataFrame:  # WIN-03
    p = relational.positions(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position")
    last = F.col("position") == F.max("position").over(Window.partitionBy("o_custkey"))
    return relational.move(p.withColumn("_last", last), ["o_custkey"], F.col("_last"), 1).drop("_last")


@query("WITH p AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) SELECT *, count(*) OVER (PARTITION BY o_custkey, month) = 5 AS complete FROM p WHERE position <= 5")
def q_top5_chart(spark: SparkSession, d: str) -> DataFrame:  # WIN-07, QRY-17
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_totalprice")
    return relational.top_n(o, ["o_custkey", "month"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).drop("o_totalprice")


@query("SELECT row_id, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT DISTINCT row_id, list_filter(list_transform(string_split(coalesce(format_raw, ''), ','), lambda t: substr(regexp_replace(lower(trim(t)), '\\s+', '-', 'g'), 1, 40)), lambda t: t <> '') AS l, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM collection_rows)")
def q_tag_list(spark: SparkSession, d: str) -> DataFrame:  # SCL-25, QRY-16
    return table(spark, d, "collection_rows").select("row_id", F.array_join(text.tag_list(F.col("format_raw")), ",").alias("tags")).distinct()


@query("WITH h AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS copy_id, CASE WHEN user_id % 2 = 1 THEN user_id END AS digital_id FROM events), i AS (SELECT 'physical' AS item_type, c_custkey AS item_id, c_name AS name FROM customer UNION ALL SELECT 'digital', s_suppkey, s_name FROM supplier) SELECT h.event_id, i.item_type, i.name FROM h JOIN i ON (i.item_type = 'physical' AND i.item_id = h.copy_id) OR (i.item_type = 'digital' AND i.item_id = h.digital_id)")
def q_or_join(spark: SparkSession, d: str) -> DataFrame:  # JOI-06: one equi join on the derived key
    u = F.col("user_id")
    copy, digital = F.when(u % 2 == 0, u), F.when(u % 2 == 1, u)
    h = table(spark, d, "events").select("event_id", F.when(copy.isNotNull(), "physical").otherwise("digital").alias("item_type"), F.coalesce(copy, digital).alias("item_id"))
    i = table(spark, d, "customer").select(F.lit("physical").alias("item_type"), F.col("c_custkey").alias("item_id"), F.col("c_name").alias("name")).unionByName(table(spark, d, "supplier").select(F.lit("digital").alias("item_type"), F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name")))
    return h.join(i, ["item_type", "item_id"]).select("event_id", "item_type", "name")


@query("SELECT DISTINCT artist, nullif(trim(regexp_replace(regexp_replace(lower(strip_accents(artist)), '\\s+\\([0-9]+\\)\\s*$', ''), '[^\\p{L}\\p{N}]+', ' ', 'g')), '') AS name, trim(regexp_replace(artist, '\\s+\\([0-9]+\\)(\\s*[,&/]|$)', '\\1', 'g')) AS shown, trim(regexp_replace(artist, '\\s+', ' ', 'g')) AS squeezed FROM collection_rows WHERE artist IS NOT NULL")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:  # SCL-01, SCL-08, SCL-33
    a = table(spark, d, "collection_rows").filter("artist IS NOT NULL").select("artist").distinct()
    return a.select("artist", text.normalize_name(F.col("artist")).alias("name"), parsing.display_artist(F.col("artist")).alias("shown"), text.squeeze(F.col("artist")).alias("squeezed"))


_TOKENS = "tok AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS at FROM (SELECT doc_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents))"


#: Index folders by application, directory and name: an index is written once and read by all searches.
_INDEXES: dict[tuple[str, str, str], str] = {}


def indexed(spark: SparkSession, d: str, name: str, key: str, fields: list[str], build) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the index of that name over d; build gives its documents (key and the fields)."""
    at = (spark.sparkContext.applicationId, d, name)
    path = _INDEXES.get(at)
    if path is None:
        path = f"{shared_dir(spark)}/index-{at[0]}-{name}-{len(_INDEXES)}"
        posted = stage(search.postings(build(), key, fields), "postings")
        tables.write_index(posted, search.lengths(posted, key), path, files=max(8, spark.sparkContext.defaultParallelism))
        _INDEXES[at] = path
    return tables.read_index(spark, path)


def _document_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return indexed(spark, d, "documents", "doc_id", ["extra"], lambda: table(spark, d, "documents").select("doc_id", F.col("text").alias("extra")))


def _posted(spark: SparkSession, d: str) -> DataFrame:
    return _document_index(spark, d)[0]


@query(f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE term = 'violin' INTERSECT SELECT doc_id FROM tok WHERE starts_with(term, 'har')")
def q_fts_match(spark: SparkSession, d: str) -> DataFrame:  # FTS-02..05
    return search.matching(_posted(spark, d), "doc_id", search.compile_query("Violin har"))


@query(f"WITH {_TOKENS} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.at = a.at + 1 JOIN tok c ON a.doc_id = c.doc_id AND c.at = a.at + 2 WHERE a.term = 'nothing' AND b.term = 'here' AND starts_with(c.term, 'is')")
def q_fts_phrase(spark: SparkSession, d: str) -> DataFrame:  # FTS-05
    return search.matching(_posted(spark, d), "doc_id", search.compile_query("nothing-here-is"))


@query(f"""WITH {_TOKENS}, len AS (SELECT doc_id, count(*) AS l FROM tok GROUP BY doc_id), st AS (SELECT count(*) AS docs, avg(l) AS av FROM len),
h AS (SELECT doc_id, 0 AS w, count(*) AS n FROM tok WHERE term = 'smoky' GROUP BY doc_id UNION ALL SELECT doc_id, 1, count(*) FROM tok WHERE starts_with(term, 'organ') GROUP BY doc_id),
df AS (SELECT w, count(*) AS df FROM h GROUP BY w),
s AS (SELECT h.doc_id, count(*) AS k, -sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / av))) AS score FROM h JOIN df USING (w) JOIN len USING (doc_id) CROSS JOIN st GROUP BY h.doc_id)
SELECT doc_id, round(score, 6) AS score FROM s WHERE k = 2 ORDER BY score, doc_id LIMIT 20""")
def q_bm25_top(spark: SparkSession, d: str) -> DataFrame:  # FTS-06, SRT-10: top 20
    best = search.ranked(*_document_index(spark, d), "doc_id", search.compile_query("smoky organ"), {"extra": 1.0})
    return best.withColumn("score", F.round("score", 6)).orderBy("score", "doc_id").limit(20)


@query("""WITH c AS (SELECT DISTINCT owner_type, owner_id, pos, coalesce(nullif(trim(anv), ''), name, 'Unknown artist') AS s,
 CASE WHEN trim(coalesce(join_text, '')) = '' THEN '' WHEN trim(join_text) = ',' THEN ', ' ELSE ' ' || trim(join_text) || ' ' END AS j FROM credits),
o AS (SELECT owner_type, owner_id, list(struct_pack(pos := pos, s := s, j := j) ORDER BY pos, s, j) AS x FROM c GROUP BY ALL)
SELECT owner_type, owner_id, array_to_string(list_transform(x, lambda e, i: e.s || CASE WHEN i < len(x) THEN e.j ELSE '' END), '') AS credit FROM o""")
def q_credit_text(spark: SparkSession, d: str) -> DataFrame:  # AGG-06, PRJ-06, SCL-14
    c = table(spark, d, "credits").select("owner_type", "owner_id", "pos", "name", "anv", "join_text").distinct()
    return relational.credit_text(c, ["owner_type", "owner_id"])


def _order_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    v1 = o.filter("o_orderkey % 7 <> 0")
    v2 = o.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    h = F.sha2(F.concat_ws("|", "o_custkey", "o_orderstatus"), 256)
    return v1.withColumn("h", h), v2.withColumn("h", h)


_VERSIONS = "v1 AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), v2 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0), c AS (SELECT v2.*, CASE WHEN v1.o_orderkey IS NULL THEN 'insert' WHEN (v1.o_custkey, v1.o_orderstatus) = (v2.o_custkey, v2.o_orderstatus) THEN 'unchanged' WHEN v1.o_orderkey % 13 = 0 THEN 'conflict' ELSE 'update' END AS action FROM v2 LEFT JOIN v1 ON v1.o_orderkey = v2.o_orderkey)"


@query(f"WITH {_VERSIONS} SELECT action, count(*) AS n FROM c GROUP BY action")
def q_upsert_classify(spark: SparkSession, d: str) -> DataFrame:  # MUT-01
    v1, v2 = _order_versions(spark, d)
    return upsert.classify(v1, v2, "o_orderkey", "h", F.col("o_orderkey") % 13 == 0).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_VERSIONS} SELECT o_orderkey, o_custkey, o_orderstatus FROM v1 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c WHERE action IN ('insert', 'update')) UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM c WHERE action IN ('insert', 'update')")
def q_upsert_apply(spark: SparkSession, d: str) -> DataFrame:  # MUT-02, SNK-01
    v1, v2 = _order_versions(spark, d)
    return upsert.apply(v1, upsert.classify(v1, v2, "o_orderkey", "h", F.col("o_orderkey") % 13 == 0), "o_orderkey").drop("h")


_ALL_COPIES = """b AS (SELECT library_id, batch_date, lag(batch_date) OVER (PARTITION BY library_id ORDER BY batch_date) AS before FROM (SELECT DISTINCT library_id, batch_date FROM parsed_rows)),
p AS (SELECT DISTINCT b.library_id, b.batch_date, b.before, row_number, concat_ws('|', b.library_id, identity_key) AS k, content_hash AS h FROM parsed_rows JOIN b ON b.library_id = parsed_rows.library_id AND b.batch_date = parsed_rows.batch_date),
n AS (SELECT *, library_id * 1000000 + row_number AS id, row_number() OVER (PARTITION BY batch_date, k, h ORDER BY library_id * 1000000 + row_number) AS rn FROM p),
m AS (SELECT r.batch_date, r.id AS row_number, r.k, r.before, e.id AS entry_id FROM n r LEFT JOIN n e ON e.batch_date = r.before AND e.k = r.k AND e.h = r.h AND e.rn = r.rn),
left_over AS (SELECT e.k, f.batch_date, e.id FROM n e JOIN b f ON f.library_id = e.library_id AND f.before = e.batch_date WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.batch_date = f.batch_date AND m.entry_id = e.id)),
spare AS (SELECT k, batch_date, count(*) AS n FROM left_over GROUP BY ALL)"""


def _all_copies(spark: SparkSession, d: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all batches, and as known ones those of the library's batch before. Numbers and keys hold the batch's
    place, as the copies of one row come again in each batch."""
    p = table(spark, d, "parsed_rows").select("library_id", "batch_date", "row_number", "identity_key", "content_hash", *more).distinct()
    b = p.select("library_id", "batch_date").distinct()
    b = b.withColumn("place", F.row_number().over(Window.partitionBy("library_id").orderBy("batch_date")).cast("bigint"))
    p = p.join(b, ["library_id", "batch_date"]).withColumn("id", F.col("library_id") * 1000000 + F.col("row_number"))
    at = lambda place: [(place * _PLACE + F.col("id")).alias("id"), F.concat_ws("|", place, "library_id", "identity_key").alias("identity_key"), "content_hash"]
    known = p.join(b.select("library_id", (F.col("place") - 1).alias("place")), ["library_id", "place"], "left_semi").select(*at(F.col("place") + 1)).withColumnRenamed("id", "entry_id")
    return p.select("library_id", "batch_date", *at(F.col("place")), *more).withColumnRenamed("id", "row_number").withColumn("invalid", F.lit(False)), known


#: Above any library_id * 1000000 + row_number.
_PLACE = 10**13


@query(f"WITH {_ALL_COPIES} SELECT m.batch_date, row_number, CASE WHEN entry_id IS NOT NULL THEN 'existing' WHEN n IS NOT NULL THEN 'ambiguous' ELSE 'new' END AS class, entry_id, CASE WHEN entry_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_candidates FROM m LEFT JOIN spare ON spare.k = m.k AND spare.batch_date = m.batch_date")
def q_multiset_reconcile(spark: SparkSession, d: str) -> DataFrame:  # REC-01, JOI-14: each batch against the library's one before
    rows, known = _all_copies(spark, d)
    out = reconcile.multiset(rows, known).join(rows.select("row_number", "batch_date"), "row_number")
    return out.select("batch_date", (F.col("row_number") % _PLACE).alias("row_number"), "class", (F.col("entry_id") % _PLACE).alias("entry_id"), F.size("candidates").cast("bigint").alias("n_candidates"))


@query(f"WITH {_ALL_COPIES} SELECT batch_date, id AS entry_id FROM left_over")
def q_missing(spark: SparkSession, d: str) -> DataFrame:  # SET-05: what each batch misses of the library's one before
    rows, known = _all_copies(spark, d)
    gone = reconcile.missing(known, reconcile.multiset(rows, known))
    place = F.floor(F.col("entry_id") / _PLACE).cast("bigint")
    b = rows.select(F.floor(F.col("row_number") / _PLACE).cast("bigint").alias("place"), "library_id", "batch_date").distinct()
    gone = gone.select(place.alias("place"), F.floor((F.col("entry_id") % _PLACE) / 1000000).cast("bigint").alias("library_id"), (F.col("entry_id") % _PLACE).alias("entry_id"))
    return gone.join(b, ["place", "library_id"]).select("batch_date", "entry_id")


def _hinted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    known = c.filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("entry_id"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_mktsegment").alias("content_hash"), F.array(F.concat(F.lit("n:"), "c_name"), F.concat(F.lit("k:"), F.col("c_custkey").cast("string"))).alias("hints"))
    k = F.col("c_custkey")
    rows = c.filter("c_custkey % 9 <> 0").select(
        k.alias("row_number"),
        F.when(k % 8 == 0, F.concat(F.lit("new"), k.cast("string"))).otherwise(k.cast("string")).alias("external_id"),
        F.when(k % 3 == 0, "changed").otherwise(F.col("c_mktsegment")).alias("content_hash"),
        F.array(F.when(k % 2 == 0, F.concat(F.lit("n:"), "c_name")).otherwise("none"), F.lit("other")).alias("hints"),
        (k % 50 == 1).alias("invalid"),
    )
    return rows, known


@query("""WITH known AS (SELECT c_custkey AS entry_id, CAST(c_custkey AS VARCHAR) AS ext, c_mktsegment AS h, 'n:' || c_name AS hint FROM customer WHERE c_custkey % 10 <> 0),
r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 8 = 0 THEN 'new' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS ext, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS h, CASE WHEN c_custkey % 2 = 0 THEN 'n:' || c_name ELSE 'none' END AS hint, c_custkey % 50 = 1 AS invalid FROM customer WHERE c_custkey % 9 <> 0),
free AS (SELECT * FROM known WHERE ext NOT IN (SELECT ext FROM r WHERE NOT invalid)),
cand AS (SELECT r.k, count(DISTINCT f.entry_id) AS n FROM r JOIN free f ON f.hint = r.hint WHERE NOT r.invalid GROUP BY r.k)
SELECT r.k AS row_number, CASE WHEN invalid THEN 'invalid' WHEN e.ext IS NOT NULL AND e.h = r.h THEN 'existing' WHEN e.ext IS NOT NULL AND e.hint = r.hint THEN 'changed' WHEN e.ext IS NOT NULL THEN 'ambiguous' WHEN cand.n IS NOT NULL THEN 'ambiguous' ELSE 'new' END AS class
FROM r LEFT JOIN known e ON e.ext = r.ext LEFT JOIN cand ON cand.k = r.k""")
def q_hint_reconcile(spark: SparkSession, d: str) -> DataFrame:  # REC-02, JOI-15
    return reconcile.by_hints(*_hinted(spark, d)).select("row_number", "class")


_FACTS = "facts AS (SELECT DISTINCT load_id, master_discogs_id AS ext, CASE WHEN load_id % 3 = 0 THEN master_discogs_id END AS fk FROM release_records)"


@query(f"WITH {_FACTS}, d AS (SELECT DISTINCT discogs_id FROM master_records), x AS (SELECT ext, coalesce(fk, discogs_id) AS fk FROM facts LEFT JOIN d ON d.discogs_id = facts.ext) SELECT count(*) FILTER (fk IS NOT NULL) AS resolved, count(*) FILTER (fk IS NULL AND ext IS NOT NULL) AS unresolved, 0 AS placeholder, count(*) FILTER (fk IS NULL AND ext IS NULL) AS none FROM x")
def q_resolve_refs(spark: SparkSession, d: str) -> DataFrame:  # MUT-07, JOI-16, AGG-19
    m = F.col("master_discogs_id")
    facts = table(spark, d, "release_records").select("load_id", m.alias("ext"), F.when(F.col("load_id") % 3 == 0, m).alias("fk")).distinct()
    dim = table(spark, d, "master_records").select(F.col("discogs_id").alias("id"), F.col("discogs_id").alias("x")).distinct()
    return upsert.reference_counts(upsert.resolve(facts, dim, "fk", "ext", "id", "x"), "fk", "ext")


@query("WITH f AS (SELECT DISTINCT load_id, master_discogs_id AS ext, CASE WHEN load_id % 4 = 0 THEN master_discogs_id + 1 ELSE master_discogs_id END AS fk FROM release_records), d AS (SELECT DISTINCT discogs_id FROM master_records) SELECT load_id, ext, CASE WHEN d.discogs_id IS NOT NULL AND ext IS NOT NULL AND d.discogs_id <> ext THEN NULL ELSE fk END AS fk FROM f LEFT JOIN d ON d.discogs_id = f.fk")
def q_stale_pairs(spark: SparkSession, d: str) -> DataFrame:  # MUT-08
    m = F.col("master_discogs_id")
    facts = table(spark, d, "release_records").select("load_id", m.alias("ext"), F.when(F.col("load_id") % 4 == 0, m + 1).otherwise(m).alias("fk")).distinct()
    dim = table(spark, d, "master_records").select(F.col("discogs_id").alias("id"), F.col("discogs_id").alias("x")).distinct()
    return upsert.repair(facts, dim, "fk", "ext", "id", "x")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def q_json_extract(spark: SparkSession, d: str) -> DataFrame:  # SCL-31, SRC-14
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT rec_id, CAST(node_json AS JSON) AS node FROM xnode_records), w AS (
 SELECT rec_id, node ->> '$.name' AS path, node FROM t UNION ALL
 SELECT rec_id, path || '/' || (child ->> '$.name'), child FROM (SELECT rec_id, path, unnest(CASE json_type(node, '$.children') WHEN 'ARRAY' THEN CAST(node -> '$.children' AS JSON[]) WHEN 'OBJECT' THEN [node -> '$.children'] END) AS child FROM w) WHERE json_type(child) = 'OBJECT')
SELECT path, count(DISTINCT rec_id) AS records, count(*) AS occurrences, count(*) FILTER (trim(coalesce(node ->> '$.text', '')) = '') AS empty, max(length(coalesce(node ->> '$.text', ''))) AS longest, CASE WHEN starts_with(path, 'release/t') THEN 'imported' ELSE 'unknown' END AS coverage FROM w GROUP BY path""")
def q_census(spark: SparkSession, d: str) -> DataFrame:  # QRY-27, AGG-18
    t = table(spark, d, "xnode_records").select("rec_id", "node_json").distinct()
    level = t.select("rec_id", F.get_json_object("node_json", "$.name").alias("path"), F.col("node_json").alias("node"))
    out = level
    while True:  # until a level is empty
        kids = F.get_json_object("node", "$.children")
        listed = F.coalesce(F.from_json(F.when(kids.startswith("["), kids), "array<string>"), F.when(kids.startswith("{"), F.array(kids)))
        level = level.select("rec_id", "path", F.explode(listed).alias("node")).filter("startswith(node, '{')").select("rec_id", F.concat("path", F.lit("/"), F.get_json_object("node", "$.name")).alias("path"), "node")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    value = F.get_json_object("node", "$.text")
    prof = quality.profile(out.withColumn("value", value), "rec_id", "path", "value", "rec_id")
    imported = F.when(F.col("path").startswith("release/t"), "imported").otherwise("unknown")
    return prof.select("path", "records", "occurrences", "empty", F.col("longest").cast("bigint").alias("longest"), imported.alias("coverage"))


@query(f"""WITH {_LIVE}, k AS (SELECT discogs_id AS id, nullif(nullif(regexp_replace(upper(strip_accents(catalog_number)), '[^\\p{{L}}\\p{{N}}]', '', 'g'), ''), 'NONE') AS code, master_discogs_id AS work, format_name AS f, country AS c,
 CASE WHEN regexp_matches(released, '^[0-9]{{4}}') AND CAST(substr(released, 1, 4) AS INT) BETWEEN 1850 AND 2100 THEN CAST(substr(released, 1, 4) AS INT) END AS y, label_name AS l FROM live),
pool AS (SELECT a.id AS i, b.id AS j FROM k a JOIN k b ON a.work = b.work WHERE a.id <> b.id AND a.id % 100 = 0
 UNION SELECT a.id, b.id FROM k a JOIN k b ON substr(a.code, 1, 3) = substr(b.code, 1, 3) AND starts_with(b.code, left(a.code, greatest(3, length(a.code) - 2))) WHERE a.id <> b.id AND a.id % 100 = 0 AND length(a.code) >= 3 AND length(b.code) >= 3),
s AS (SELECT i, j, CASE WHEN a.code = b.code THEN 5 WHEN levenshtein(a.code, b.code) = 1 OR starts_with(a.code, b.code) OR starts_with(b.code, a.code) THEN 2 ELSE 0 END AS sc,
 coalesce(a.work = b.work, false) AS w, a.f IS NOT DISTINCT FROM b.f AND coalesce(a.c, '') = coalesce(b.c, '') AS fm, coalesce(a.y = b.y, false) AS ys, coalesce(a.l = b.l, false) AS ls FROM pool JOIN k a ON a.id = i JOIN k b ON b.id = j),
p AS (SELECT i, j, sc + CASE WHEN w THEN 1 + CASE WHEN fm THEN 2 ELSE 0 END + CASE WHEN ys THEN 1 ELSE 0 END ELSE 0 END AS base, ls, sc > 0 OR (w AND (fm OR ys)) AS why FROM s),
q AS (SELECT i AS id, j AS other, base + CASE WHEN ls AND base >= 2 THEN 1 ELSE 0 END AS score, why OR (ls AND base >= 2) AS why FROM p)
SELECT id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rn FROM q WHERE score >= 2 AND why) WHERE rn <= 8""")
def q_duplicates(spark: SparkSession, d: str) -> DataFrame:  # SCL-19, SCL-20, SRT-09, QRY-05: the best 8 for each release whose id is divisible by 100, against all
    k = releases(spark, d, "catalog_number", "master_discogs_id", "format_name", "country", "released", "label_name").select(
        F.col("discogs_id").alias("id"), text.normalize_code(F.col("catalog_number")).alias("code"), F.col("master_discogs_id").alias("work"), F.col("format_name").alias("format"), "country", parsing.year_in(F.col("released"), 1850, 2100, at_start=True).alias("year"), F.col("label_name").alias("label")
    )
    return duplicates.candidates(k.filter("id % 100 = 0"), k).drop("reasons")


@query("WITH a AS (SELECT p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part), b AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN '99' ELSE p_size END AS p_size FROM a), u AS (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_size']) AS field, unnest([a.p_name, a.p_brand, a.p_size]) AS before, unnest([b.p_name, b.p_brand, b.p_size]) AS after FROM a JOIN b USING (p_partkey)) SELECT * FROM u WHERE coalesce(before, '') <> coalesce(after, '')")
def q_changed_fields(spark: SparkSession, d: str) -> DataFrame:  # SCL-28, QRY-22
    a = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    b = a.withColumns({"p_brand": F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand")), "p_size": F.when(F.col("p_partkey") % 3 == 0, "99").otherwise(F.col("p_size"))})
    return relational.changed_fields(a, b, "p_partkey", ["p_name", "p_brand", "p_size"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_repeated_keys(spark: SparkSession, d: str) -> DataFrame:  # AGG-13
    return quality.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM (SELECT 'catno_given' AS rule, count(*) FILTER (catalog_number IS NULL OR catalog_number = 'none') AS n FROM release_records UNION ALL SELECT 'year_plausible', count(*) FILTER (regexp_matches(released, '^[0-9]{4}') AND CAST(substr(released, 1, 4) AS INT) NOT BETWEEN 1850 AND 2100) FROM release_records UNION ALL SELECT 'master_or_label', count(*) FILTER ((CASE WHEN master_discogs_id IS NULL THEN 0 ELSE 1 END + CASE WHEN label_name IS NULL THEN 0 ELSE 1 END) <> 1) FROM release_records) WHERE n > 0")
def q_constraints(spark: SparkSession, d: str) -> DataFrame:  # section 1.4
    y = F.regexp_extract("released", r"^(\d{4})", 1).try_cast("int")
    rules = {"catno_given": F.coalesce(F.col("catalog_number") != "none", F.lit(False)), "year_plausible": y.between(1850, 2100), "master_or_label": quality.exactly_one(F.col("master_discogs_id"), F.col("label_name"))}
    return quality.violations(table(spark, d, "release_records"), **rules)


@query("WITH last AS (SELECT library_id, max(batch_date) AS b FROM parsed_rows WHERE external_id IS NOT NULL GROUP BY library_id) SELECT DISTINCT p.library_id, p.batch_date, p.row_number, p.identity_key FROM parsed_rows p JOIN last ON last.library_id = p.library_id AND last.b = p.batch_date")
def q_latest_batch(spark: SparkSession, d: str) -> DataFrame:  # JOI-17, QRY-23
    p = table(spark, d, "parsed_rows")
    last = p.filter("external_id IS NOT NULL").groupBy("library_id").agg(F.max("batch_date").alias("batch_date"))
    return p.join(last, ["library_id", "batch_date"], "left_semi").select("library_id", "batch_date", "row_number", "identity_key").distinct()


@query("WITH h AS (SELECT unnest([30, 10, 20]) AS id, unnest([0, 1, 2]) AS rank) SELECT h.rank, p_partkey, p_name FROM h JOIN part ON p_partkey = h.id ORDER BY h.rank")
def q_json_rank_join(spark: SparkSession, d: str) -> DataFrame:  # JOI-01, JOI-12, SRC-14, FTS-10
    ids = spark.range(1).select(F.posexplode(F.from_json(F.lit("[30, 10, 20]"), "array<bigint>")).alias("rank", "id"))  # three rows
    return table(spark, d, "part").join(F.broadcast(ids), F.col("p_partkey") == F.col("id")).select("rank", "p_partkey", "p_name").orderBy("rank")


@query("""WITH x AS (SELECT DISTINCT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, count(DISTINCT l_partkey) AS parts FROM x JOIN lineitem ON l_orderkey = x.o_orderkey GROUP BY c_custkey""")
def q_bridge_join(spark: SparkSession, d: str) -> DataFrame:  # JOI-01, JOI-18
    return _parts_bought(spark, d)


def _parts_bought(spark: SparkSession, d: str, lines: str = "true") -> DataFrame:
    x = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey").distinct()
    t = table(spark, d, "lineitem").filter(lines).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return x.join(t, "o_orderkey").groupBy("c_custkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("WITH r AS (SELECT DISTINCT load_id, released, '^([0-9]{4})(?:-([0-9]{2}))?(?:-([0-9]{2}))?' AS p FROM release_records), x AS (SELECT load_id, released, TRY_CAST(regexp_extract(coalesce(released, ''), p, 1) AS INT) AS y, nullif(TRY_CAST(regexp_extract(coalesce(released, ''), p, 2) AS INT), 0) AS m, nullif(TRY_CAST(regexp_extract(coalesce(released, ''), p, 3) AS INT), 0) AS d FROM r) SELECT *, CASE WHEN coalesce(y, 0) = 0 THEN NULL WHEN m IS NULL THEN CAST(y AS VARCHAR) WHEN d IS NULL THEN concat(y, '-', lpad(CAST(m AS VARCHAR), 2, '0')) ELSE concat(y, '-', lpad(CAST(m AS VARCHAR), 2, '0'), '-', lpad(CAST(d AS VARCHAR), 2, '0')) END AS joined, CASE WHEN y IS NULL THEN 'Unknown' WHEN m IS NULL OR m > 12 THEN CAST(y AS VARCHAR) WHEN d IS NULL THEN concat(monthname(make_date(2000, m, 1)), ' ', y) ELSE concat(d, ' ', monthname(make_date(2000, m, 1)), ' ', y) END AS shown FROM x")
def q_partial_dates(spark: SparkSession, d: str) -> DataFrame:  # SCL-21, SCL-27
    r = table(spark, d, "release_records").select("load_id", "released").distinct()
    r = r.withColumn("p", parsing.date_parts(F.col("released"))).select("load_id", "released", "p.y", "p.m", "p.d")
    return r.select("*", parsing.join_date(F.col("y"), F.col("m"), F.col("d")).alias("joined"), parsing.display_date(F.col("released")).alias("shown"))



@query("""WITH g AS (SELECT DISTINCT row_id, format_raw, media_condition, lower(trim(coalesce(media_condition, ''))) AS c, lower(regexp_replace(trim(regexp_extract(coalesce(format_raw, ''), '^[^,+]*')), '^[0-9]+\\s*[xX×]\\s*', '')) AS f FROM collection_rows)
SELECT row_id, CASE WHEN regexp_matches(c, '^mint\\b|\\(m\\)$') THEN 'M' WHEN regexp_matches(c, 'near mint|\\(nm|m-\\)') THEN 'NM' WHEN regexp_matches(c, 'very good plus|\\(vg\\+\\)') THEN 'VG+' WHEN regexp_matches(c, 'very good|\\(vg\\)') THEN 'VG' WHEN regexp_matches(c, 'good plus|\\(g\\+\\)') THEN 'G+' WHEN regexp_matches(c, '^good\\b|\\(g\\)') THEN 'G' WHEN regexp_matches(c, 'fair|\\(f\\)') THEN 'F' WHEN regexp_matches(c, 'poor|\\(p\\)') THEN 'P' WHEN regexp_matches(c, 'generic') THEN 'GENERIC' WHEN regexp_matches(c, 'no cover|no sleeve') THEN 'NONE' ELSE 'NG' END AS grade,
 CASE WHEN regexp_matches(f, '^(vinyl|lp|12"|10"|7"|lathe cut|acetate|flexi-?disc|shellac)') THEN 'Vinyl' WHEN regexp_matches(f, '^(cd|sacd|hybrid|minidisc)') THEN 'CD' WHEN regexp_matches(f, '^(cass|microcassette)') THEN 'Cassette' WHEN regexp_matches(f, '^file') THEN 'Digital' ELSE 'Other' END AS format_group FROM g""")
def q_grades_and_groups(spark: SparkSession, d: str) -> DataFrame:  # SCL-06, SCL-07
    c = table(spark, d, "collection_rows").select("row_id", "format_raw", "media_condition").distinct()
    return c.select("row_id", parsing.grade(F.col("media_condition")).alias("grade"), parsing.typed_format_group(F.col("format_raw")).alias("format_group"))


@query("""WITH c AS (SELECT DISTINCT owner_id, pos, name, role FROM credits WHERE owner_type = 'master'), m AS (SELECT DISTINCT discogs_id, title FROM master_records),
g AS (SELECT owner_id, list(coalesce(name, '') || ':' || coalesce(role, '') ORDER BY pos NULLS FIRST, name NULLS FIRST, role NULLS FIRST) AS x FROM c GROUP BY owner_id)
SELECT discogs_id, title, coalesce(array_to_string(x, '|'), '') AS credits FROM m LEFT JOIN g ON g.owner_id = m.discogs_id""")
def q_nested_record(spark: SparkSession, d: str) -> DataFrame:  # QRY-03, QRY-10
    c = table(spark, d, "credits").filter("owner_type = 'master'").select(F.col("owner_id").alias("discogs_id"), "pos", "name", "role").distinct()
    m = entities.with_children(table(spark, d, "master_records").select("discogs_id", "title").distinct(), "discogs_id", credits=(c, ["pos", "name", "role"]))
    shown = F.transform("credits", lambda x: F.concat(F.coalesce(x["name"], F.lit("")), F.lit(":"), F.coalesce(x["role"], F.lit(""))))
    return m.select("discogs_id", "title", F.array_join(shown, "|").alias("credits"))


@query("""WITH l AS (SELECT discogs_id, name, nullif(parent_discogs_id, 0) AS p FROM (SELECT *, row_number() OVER (PARTITION BY discogs_id ORDER BY dump_date DESC, load_id DESC) AS rn FROM label_records) WHERE rn = 1 AND NOT deleted)
SELECT l.discogs_id, l.name, u.name AS parent_name, coalesce(array_to_string(k.x, '|'), '') AS children
FROM l LEFT JOIN l u ON u.discogs_id = l.p LEFT JOIN (SELECT p, list(name ORDER BY name, discogs_id) AS x FROM l WHERE p IS NOT NULL GROUP BY p) k ON k.p = l.discogs_id""")
def q_label_tree(spark: SparkSession, d: str) -> DataFrame:  # QRY-08, JOI-07
    rows = relational.last_wins(table(spark, d, "label_records").select("discogs_id", "dump_date", "load_id", "deleted", "name", "parent_discogs_id"), ["discogs_id"], ["dump_date", "load_id"]).filter("NOT deleted")
    tree = entities.hierarchy(rows.withColumn("p", F.nullif("parent_discogs_id", F.lit(0))), "discogs_id", "p", "name")
    return tree.withColumn("children", F.array_join("children", "|"))


@query("SELECT DISTINCT discogs_artist_id, owner_id, coalesce(nullif(trim(role), ''), 'Main artist') AS role FROM credits WHERE owner_type = 'release' AND discogs_artist_id IS NOT NULL")
def q_artist_releases(spark: SparkSession, d: str) -> DataFrame:  # QRY-07
    return entities.contributions(table(spark, d, "credits").filter("owner_type = 'release'"), "discogs_artist_id", "owner_id", "role")


@query(f"""WITH {_LIVE}, p AS (SELECT owner_id, string_agg(n, ' ' ORDER BY n) AS people FROM (SELECT DISTINCT owner_id, coalesce(nullif(anv, ''), name) AS n FROM credits WHERE owner_type = 'release') WHERE n IS NOT NULL GROUP BY owner_id),
k AS (SELECT discogs_id, string_agg(DISTINCT c, ' ' ORDER BY c) AS codes FROM (SELECT discogs_id, catalog_number AS c FROM live WHERE catalog_number <> 'none' UNION SELECT discogs_id, regexp_replace(upper(strip_accents(catalog_number)), '[^\\p{{L}}\\p{{N}}]', '', 'g') FROM live WHERE catalog_number <> 'none') WHERE c <> '' GROUP BY discogs_id)
SELECT live.discogs_id AS ext_id, title, coalesce(people, '') AS people, coalesce(codes, '') AS codes, concat_ws(' ', label_name, CASE WHEN regexp_matches(released, '^[0-9]{{4}}') AND CAST(substr(released, 1, 4) AS INT) BETWEEN 1850 AND 2100 THEN substr(released, 1, 4) END, country, format_name) AS extra
FROM live LEFT JOIN p ON p.owner_id = live.discogs_id LEFT JOIN k ON k.discogs_id = live.discogs_id""")
def q_search_documents(spark: SparkSession, d: str) -> DataFrame:  # FTS-01
    r = releases(spark, d, "title", "released", "country", "format_name", "label_name", "catalog_number").withColumn("ext_id", F.col("discogs_id"))
    c = table(spark, d, "credits").filter("owner_type = 'release'").select(F.col("owner_id").alias("ext_id"), F.coalesce(F.nullif("anv", F.lit("")), "name").alias("credit"))
    docs = r.select("ext_id", "title", parsing.year_in(F.col("released"), 1850, 2100, at_start=True).alias("year"), "country", F.col("format_name").alias("format"))
    return entities.release_documents(docs, c, r.select("ext_id", F.when(F.col("catalog_number") != "none", F.col("catalog_number")).alias("code")), r.select("ext_id", F.col("label_name").alias("name")))


@query("SELECT library_id, batch_date, count(*) AS total, count(DISTINCT identity_key) AS works, count(*) FILTER (external_id IS NULL) AS without_id, count(*) FILTER (target = 'digital') AS digital, epoch_us(min(loaded_at)) AS first_loaded FROM (SELECT DISTINCT library_id, batch_date, row_number, identity_key, external_id, target, loaded_at FROM parsed_rows) GROUP BY ALL")
def q_batches(spark: SparkSession, d: str) -> DataFrame:  # QRY-23, QRY-24, QRY-28
    p = table(spark, d, "parsed_rows").select("library_id", "batch_date", "row_number", "identity_key", "external_id", "target", "loaded_at").distinct()
    return p.groupBy("library_id", "batch_date").agg(F.count("*").alias("total"), F.count_distinct("identity_key").alias("works"), F.count_if(F.col("external_id").isNull()).alias("without_id"), F.count_if(F.col("target") == "digital").alias("digital"), F.unix_micros(F.min("loaded_at")).alias("first_loaded"))


@query("WITH t AS (SELECT row_id, unnest(string_split(coalesce(format_raw, ''), ',')) AS tag FROM collection_rows), u AS (SELECT DISTINCT row_id, lower(trim(tag)) AS tag FROM t WHERE trim(tag) <> '') SELECT tag, count(*) AS n FROM u GROUP BY tag HAVING count(*) >= 3")
def q_tag_counts(spark: SparkSession, d: str) -> DataFrame:  # QRY-16, AGG-13
    t = table(spark, d, "collection_rows").select("row_id", F.explode(F.split(F.coalesce("format_raw", F.lit("")), ",")).alias("t")).select("row_id", F.lower(F.trim("t")).alias("tag")).filter("tag <> ''").distinct()
    return t.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT DISTINCT row_id, title FROM collection_rows WHERE lower(coalesce(title, '')) LIKE '%glass_%r' || '%' OR lower(coalesce(notes, '')) LIKE '%glass_%r%'")
def q_like_filter(spark: SparkSession, d: str) -> DataFrame:  # FLT-05
    c = table(spark, d, "collection_rows")
    return c.filter(relational.like_any("GLASS_%r", F.col("title"), F.col("notes"))).select("row_id", "title").distinct()


@query("WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS part, 'Brand#' || (c_custkey % 9) AS brand FROM customer) SELECT c_custkey, count(*) AS n, min(p_partkey) AS first_part FROM w JOIN part ON CASE WHEN w.part IS NULL THEN p_brand = w.brand ELSE p_partkey = w.part END GROUP BY c_custkey")
def q_conditional_join(spark: SparkSession, d: str) -> DataFrame:  # FLT-12, QRY-18
    return _either_part(spark, d)


def _either_part(spark: SparkSession, d: str, customers: str = "true") -> DataFrame:
    k = F.col("c_custkey")
    w = table(spark, d, "customer").filter(customers).select("c_custkey", F.when(k % 2 == 0, k).alias("part"), F.concat(F.lit("Brand#"), (k % 9).cast("string")).alias("brand"))
    return relational.either_summary(w, table(spark, d, "part"), ("part", "p_partkey"), ("brand", "p_brand"), "c_custkey", "p_partkey", "n", "first_part")


@query("SELECT item_type, item_id, artist, label FROM (SELECT DISTINCT 'physical' AS item_type, row_id AS item_id, artist, nullif(label, '') AS label FROM collection_rows WHERE library_id = 1000) ORDER BY label IS NULL, label DESC, item_type, item_id LIMIT 48 OFFSET 48")
def q_sorted_page(spark: SparkSession, d: str) -> DataFrame:  # SRT-02, SRT-06, QRY-11: page 2
    i = items(spark, d).filter("library_id = 1000 AND item_type = 'physical'").select("item_type", "item_id", "artist", F.nullif("label", F.lit("")).alias("label"))
    return ordering.page(i, relational.sort_terms("label", True, ["item_type", "item_id"]), 2, 48)


@query("SELECT l_orderkey, max(l_extendedprice) + sum(l_tax) - arg_max(l_tax, (l_extendedprice, -l_linenumber, l_tax)) AS total FROM (SELECT l_orderkey, l_linenumber, CAST(max(round(l_extendedprice * 100)) AS BIGINT) AS l_extendedprice, CAST(max(round(l_tax * 100)) AS BIGINT) AS l_tax FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY l_orderkey")
def q_largest_plus_rest(spark: SparkSession, d: str) -> DataFrame:  # AGG-15, AGG-16
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("p"), F.max(F.round(F.col("l_tax") * 100).cast("bigint")).alias("t"))
    return relational.largest_plus_rest(lines, ["l_orderkey"], "p", "t", "l_linenumber")


@query("WITH r AS (SELECT event_id AS request, user_id % 40 AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS v FROM events), c AS (SELECT s_suppkey AS k, s_suppkey % 2 AS version FROM supplier), w AS (SELECT r.k, min(request) AS w FROM r JOIN c ON c.k = r.k AND c.version = r.v GROUP BY r.k) SELECT c.k, CASE WHEN w IS NOT NULL THEN version + 1 ELSE version END AS version FROM c LEFT JOIN w ON w.k = c.k")
def q_guarded_update(spark: SparkSession, d: str) -> DataFrame:  # MUT-09
    r = table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("user_id") % 40).alias("k"), (F.from_json("props", "k bigint")["k"] % 2).alias("v"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 2).alias("version"))
    return upsert.guarded(c, r, "k", F.col("version") == F.col("v"), {"version": F.col("version") + 1})[0]


@query("SELECT user_id, min(event_id) AS first_event FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id")
def q_owned_refs(spark: SparkSession, d: str) -> DataFrame:  # SET-06, FLT-10
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("first_event"))
    return relational.owned_only(e, table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")), ["user_id"], "first_event")


@query("WITH i AS (SELECT l_orderkey AS o, l_linenumber AS pos, max(l_partkey) AS p FROM lineitem WHERE l_orderkey IN (1, 2, 3) GROUP BY ALL), r AS (SELECT DISTINCT o FROM i), e AS (SELECT DISTINCT pos FROM i) SELECT e.pos, string_agg(coalesce(CAST(i.p AS VARCHAR), '—'), '|' ORDER BY r.o) AS vals, count(DISTINCT coalesce(CAST(i.p AS VARCHAR), '—')) > 1 AS differs FROM e CROSS JOIN r LEFT JOIN i ON i.o = r.o AND i.pos = e.pos GROUP BY e.pos")
def q_sequence_matrix(spark: SparkSession, d: str) -> DataFrame:  # QRY-04 (lists side by side)
    i = table(spark, d, "lineitem").filter(F.col("l_orderkey").isin(1, 2, 3)).groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(F.max("l_partkey").cast("string").alias("p"))
    return relational.compare_sequences(i, "l_orderkey", "pos", "p").withColumn("vals", F.array_join("vals", "|"))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def q_first_seen_groups(spark: SparkSession, d: str) -> DataFrame:  # AGG-17
    return relational.first_seen_groups(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], n=F.count("*"), first_order=F.min("o_orderkey"))


@query("SELECT c_mktsegment, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q_role_list(spark: SparkSession, d: str) -> DataFrame:  # AGG-21
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("WITH w AS (SELECT p_partkey AS wanted_id, p_partkey * 3 AS code, upper(p_name) AS title FROM part WHERE p_partkey % 100 = 0), m AS (SELECT wanted_id, p_partkey FROM w JOIN part ON p_partkey = code UNION SELECT wanted_id, p_partkey FROM w JOIN part ON lower(p_name) = lower(title)) SELECT wanted_id, p_partkey, position FROM (SELECT *, row_number() OVER (PARTITION BY wanted_id ORDER BY p_partkey) AS position FROM m) WHERE position <= 8")
def q_suggestions(spark: SparkSession, d: str) -> DataFrame:  # QRY-29: the first 8 for each wanted item
    p = table(spark, d, "part")
    w = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("wanted_id"), (F.col("p_partkey") * 3).alias("code"), F.upper("p_name").alias("title"))
    return relational.suggestions(p.select("p_partkey", F.col("p_partkey").alias("code"), F.col("p_name").alias("title")), w, "p_partkey")
