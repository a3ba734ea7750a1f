"""Queries of upserts, references, imports, search and pages over whole test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramoflow.functions import ordering, parsing, text
from gramoflow.operators import entities, reconcile, relational, search, upsert
from gramoflow.plans.catalog import _ALL_COPIES, _LIVE, _PLACE, _all_copies, indexed, query, releases
from gramoflow.session import table
from gramoflow.sources import tables


@query("WITH cur AS (SELECT o_orderkey, o_orderkey * 2 + 5 AS id FROM orders WHERE o_orderkey % 3 = 0), st AS (SELECT coalesce(max(id), 0) AS m FROM cur) SELECT o_orderkey, id FROM cur UNION ALL SELECT o_orderkey, m + row_number() OVER (ORDER BY o_orderkey) FROM orders, st WHERE o_orderkey % 3 <> 0")
def q_surrogates(spark: SparkSession, d: str) -> DataFrame:  # MUT-03
    o = table(spark, d, "orders").select("o_orderkey")
    cur = o.filter("o_orderkey % 3 = 0").withColumn("id", F.col("o_orderkey") * 2 + 5)
    return upsert.with_surrogates(cur, o, "o_orderkey", "id", "o_orderkey").select("o_orderkey", "id")


_COMPANIES = "SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey // 2 END AS ext_id, concat(c_mktsegment, c_nationkey) AS name, c_custkey AS ord FROM customer"


@query(f"WITH cur AS (SELECT c_custkey // 2 AS ext_id, 'old ' || min(c_custkey) AS name FROM customer WHERE c_custkey % 10 = 1 GROUP BY 1 UNION ALL SELECT NULL, 'BUILDING3'), inc AS ({_COMPANIES}) SELECT ext_id, name FROM cur UNION ALL SELECT ext_id, arg_min(name, ord) FROM inc WHERE ext_id IS NOT NULL AND ext_id NOT IN (SELECT ext_id FROM cur WHERE ext_id IS NOT NULL) GROUP BY ext_id UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), name FROM inc WHERE ext_id IS NULL AND name <> 'BUILDING3'")
def q_companies(spark: SparkSession, d: str) -> DataFrame:  # MUT-04
    c = table(spark, d, "customer")
    half = F.floor(F.col("c_custkey") / 2).cast("bigint")
    cur = c.filter("c_custkey % 10 = 1").groupBy(half.alias("ext_id")).agg(F.concat(F.lit("old "), F.min("c_custkey")).alias("name"))
    cur = cur.unionByName(spark.createDataFrame([(None, "BUILDING3")], "ext_id bigint, name string"))
    return upsert.companies(cur, c.select(F.when(F.col("c_custkey") % 3 != 0, half).alias("ext_id"), F.concat("c_mktsegment", "c_nationkey").alias("name"), F.col("c_custkey").alias("ord")))


@query("WITH old AS (SELECT o_orderkey, o_orderstatus AS hash FROM orders WHERE o_orderkey % 7 <> 0), seen AS (SELECT o_orderkey, upper(o_orderpriority) AS hash FROM orders WHERE o_orderkey % 11 <> 0) SELECT o_orderkey, coalesce(s.hash, o.hash) AS hash, CASE WHEN o.hash IS NOT NULL THEN '2025-03-01' ELSE '2025-04-01' END AS first_seen, CASE WHEN s.hash IS NOT NULL THEN '2025-04-01' ELSE '2025-03-01' END AS last_seen FROM old o FULL JOIN seen s USING (o_orderkey)")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:  # MUT-05
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("hash"), F.lit("2025-03-01").alias("first_seen"), F.lit("2025-03-01").alias("last_seen"))
    return upsert.provenance(old, o.filter("o_orderkey % 11 <> 0").select("o_orderkey", F.upper("o_orderpriority").alias("hash")), ["o_orderkey"], F.lit("2025-04-01"))


@query("WITH cur AS (SELECT DISTINCT discogs_id AS k, min(title) AS v FROM release_records WHERE dump_date = '2025-03-01' GROUP BY 1), inc AS (SELECT discogs_id AS k, min(title) AS v FROM release_records WHERE dump_date > '2025-03-01' GROUP BY 1) SELECT * FROM cur UNION ALL SELECT * FROM inc WHERE k NOT IN (SELECT k FROM cur)")
def q_insert_missing(spark: SparkSession, d: str) -> DataFrame:  # MUT-06
    r = table(spark, d, "release_records").select(F.col("discogs_id").alias("k"), F.col("title").alias("v"), "dump_date")
    cur = r.filter("dump_date = '2025-03-01'").groupBy("k").agg(F.min("v").alias("v"))
    return upsert.insert_missing(cur, r.filter("dump_date > '2025-03-01'").select("k", "v"), ["k"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT l_orderkey, 100, count(*), 'N' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def q_replace_children(spark: SparkSession, d: str) -> DataFrame:  # MUT-02
    lines, parents = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = lines.join(parents, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.lit(100).alias("l_linenumber"), F.count("*").alias("l_partkey"), F.lit("N").alias("l_returnflag"))
    return upsert.replace_children(lines, parents, new, "l_orderkey")


_LATEST = "{n} AS (SELECT discogs_id, {c} FROM (SELECT *, row_number() OVER (PARTITION BY discogs_id ORDER BY dump_date DESC, load_id DESC) AS rn FROM {t}) WHERE rn = 1)"
_REPORT = "SELECT '{r}' AS relation, '{k}' AS fk, count(*) FILTER (i IS NOT NULL) AS resolved, count(*) FILTER (i IS NULL AND e IS NOT NULL AND NOT p) AS unresolved, count(*) FILTER (i IS NULL AND e IS NOT NULL AND p) AS placeholder, count(*) FILTER (i IS NULL AND e IS NULL) AS none FROM {f}"


@query(f"""WITH {_LATEST.format(n='lab', c='parent_discogs_id', t='label_records')}, {_LATEST.format(n='rel', c='master_discogs_id', t='release_records')}, mas AS (SELECT DISTINCT discogs_id, main_release_discogs_id FROM master_records), art AS (SELECT DISTINCT discogs_id FROM artist_snapshots), cred AS (SELECT DISTINCT credit_id, discogs_artist_id FROM credits),
a AS (SELECT nullif(main_release_discogs_id, 0) AS e, r.discogs_id AS i, false AS p FROM mas LEFT JOIN rel r ON r.discogs_id = main_release_discogs_id),
b AS (SELECT nullif(rel.master_discogs_id, 0) AS e, m.discogs_id AS i, false AS p FROM rel LEFT JOIN mas m ON m.discogs_id = rel.master_discogs_id),
c AS (SELECT nullif(discogs_artist_id, 0) AS e, art.discogs_id AS i, coalesce(discogs_artist_id IN (194, 355, 118760), false) AS p FROM cred LEFT JOIN art ON art.discogs_id = discogs_artist_id),
l AS (SELECT nullif(lab.parent_discogs_id, 0) AS e, o.discogs_id AS i, false AS p FROM lab LEFT JOIN lab o ON o.discogs_id = lab.parent_discogs_id)
{_REPORT.format(r='masters', k='main_release', f='a')} UNION ALL {_REPORT.format(r='releases', k='master', f='b')} UNION ALL {_REPORT.format(r='credits', k='artist', f='c')} UNION ALL {_REPORT.format(r='labels', k='parent', f='l')}""")
def q_reference_report(spark: SparkSession, d: str) -> DataFrame:  # MUT-07, JOI-16, AGG-19
    newest = lambda t, c: relational.last_wins(table(spark, d, t).select("discogs_id", c, "dump_date", "load_id"), ["discogs_id"], ["dump_date", "load_id"]).select("discogs_id", F.nullif(c, F.lit(0)).alias("ext"))
    lab, rel = newest("label_records", "parent_discogs_id"), newest("release_records", "master_discogs_id")
    mas = table(spark, d, "master_records").select("discogs_id", F.nullif("main_release_discogs_id", F.lit(0)).alias("ext")).distinct()
    art, cred = table(spark, d, "artist_snapshots").select("discogs_id").distinct(), table(spark, d, "credits").select("credit_id", F.nullif("discogs_artist_id", F.lit(0)).alias("ext")).distinct()
    ids = lambda df: df.select(F.col("discogs_id").alias("id"), F.col("discogs_id").alias("x"))
    empty = lambda df, fk: df.withColumn(fk, F.lit(None).cast("bigint"))
    relation = lambda n, facts, dim, fk, p=(): upsert.Relation(n, empty(facts, fk), ids(dim), fk, "ext", "id", "x", p)
    return upsert.reconcile_all([relation("masters", mas, rel, "main_release"), relation("releases", rel, mas, "master"), relation("credits", cred, art, "artist", (194, 355, 118760)), relation("labels", lab, lab, "parent")])[1]


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 5 <> 0 THEN 'old' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def q_undo(spark: SparkSession, d: str) -> DataFrame:  # MUT-14: orders are taken back unless a returned line uses them; others get their former state
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    changes = o.withColumn("kind", F.when(k % 4 == 0, "created").when((k % 4 == 1) & (k % 5 != 0), "updated")).filter("kind IS NOT NULL")
    changes = changes.select("o_orderkey", "kind", F.struct("o_orderkey", F.lit("old").alias("o_orderstatus")).alias("previous"))
    used = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return upsert.undo(o, changes, [used], "o_orderkey")


_ROWS = "CASE k % 5 WHEN 0 THEN 'seen' WHEN 1 THEN 'update' WHEN 2 THEN 'skip' WHEN 3 THEN 'invalid' ELSE 'create' END"


def _applied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("p"))
    cur = k.filter("k % 3 <> 0").select("k", "v", F.lit("2025-03-01").alias("last_seen"))
    rows = k.select("k", F.expr(_ROWS).alias("action"), F.col("p").alias("v"))
    return upsert.apply_rows(cur, rows, "k", ["v"], F.col("k") % 7 == 0, F.lit("2025-04-01"))


@query(f"WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS v, o_orderpriority AS p, {_ROWS.replace('k %', 'o_orderkey %')} AS a FROM orders) SELECT k, CASE WHEN a = 'update' AND k % 7 <> 0 THEN p ELSE v END AS v, CASE WHEN a IN ('seen', 'update') THEN '2025-04-01' ELSE '2025-03-01' END AS last_seen FROM o WHERE k % 3 <> 0 UNION ALL SELECT k, p, '2025-04-01' FROM o WHERE k % 3 = 0 AND a = 'create'")
def q_row_apply(spark: SparkSession, d: str) -> DataFrame:  # MUT-15
    return _applied(spark, d)[0]


@query(f"WITH o AS (SELECT o_orderkey AS k, {_ROWS.replace('k %', 'o_orderkey %')} AS a, o_orderkey % 3 <> 0 AS known, o_orderkey % 7 = 0 AS edited FROM orders) SELECT count(*) FILTER (a = 'create' AND NOT known) AS created, count(*) FILTER (a = 'update' AND known AND NOT edited) AS updated, count(*) FILTER (a = 'seen' AND known) AS unchanged, count(*) FILTER (a = 'skip') AS skipped, count(*) FILTER (a = 'invalid') AS invalid, count(*) FILTER (a = 'update' AND known AND edited) AS kept_user_edits FROM o")
def q_commit_report(spark: SparkSession, d: str) -> DataFrame:  # QRY-25
    return _applied(spark, d)[1]


@query("SELECT library_id, batch_date, batch_date < max(batch_date) OVER (PARTITION BY library_id) AS stale FROM (SELECT DISTINCT library_id, batch_date FROM parsed_rows)")
def q_staleness(spark: SparkSession, d: str) -> DataFrame:  # MUT-17
    b = table(spark, d, "parsed_rows").select("library_id", "batch_date").distinct().withColumn("batch", F.struct("library_id", "batch_date"))
    return upsert.newest_of_source(b, "batch", "library_id", "batch_date").select("batch.*", "stale")


@query("WITH l AS (SELECT DISTINCT o_custkey, o_orderstatus AS tag FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), j AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '5%') SELECT * FROM (SELECT * FROM l UNION SELECT o_custkey, 'gift' FROM i) WHERE NOT (tag = 'O' AND o_custkey IN (SELECT o_custkey FROM j))")
def q_bulk_tags(spark: SparkSession, d: str) -> DataFrame:  # MUT-06, MUT-18
    o = table(spark, d, "orders")
    links = o.filter("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderstatus").alias("tag")).distinct()
    linked = upsert.link_all(links, o.filter("o_orderpriority LIKE '1%'").select("o_custkey"), F.lit("gift"), ["o_custkey"], "tag")
    return upsert.unlink_all(linked, o.filter("o_orderpriority LIKE '5%'").select("o_custkey"), ["o_custkey"], "tag", "O")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '2025-01-01' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN '2025-04-01' END AS deleted_at FROM orders")
def q_soft_delete(spark: SparkSession, d: str) -> DataFrame:  # MUT-19
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "2025-01-01").alias("deleted_at"))
    return upsert.soft_deleted(o, table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", F.lit("2025-04-01"))


@query("WITH r AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O'), e AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_custkey, o_orderkey AS entry_id FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey AS row_number, entry_id FROM r JOIN e USING (o_custkey, rn)")
def q_decisions(spark: SparkSession, d: str) -> DataFrame:  # REC-05: every open order takes the first free closed one of its customer
    o = table(spark, d, "orders")
    spare = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("candidates"))
    rows = o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("row_number"), "o_custkey").join(spare, "o_custkey").withColumn("class", F.lit("ambiguous"))
    return reconcile.decide_links(rows, "o_custkey")


@query("SELECT o_orderkey AS batch_id, o_orderdate AS committed_at FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def q_same_file(spark: SparkSession, d: str) -> DataFrame:  # REC-07: the newest one is the answer
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_custkey") % 10).cast("string").alias("sha256"), F.when(F.col("o_orderstatus") == "F", "committed").otherwise("open").alias("status"), F.col("o_orderdate").alias("committed_at"))
    return reconcile.same_file(b, "3").select("batch_id", "committed_at")


@query(f"""WITH {_LIVE}, {_ALL_COPIES}, f AS (SELECT DISTINCT library_id, batch_date, library_id * 1000000 + row_number AS id, TRY_CAST(external_id AS BIGINT) AS ext, target, media_condition FROM parsed_rows),
c AS (SELECT f.*, CASE WHEN m.entry_id IS NOT NULL THEN 'existing' WHEN spare.n IS NOT NULL THEN 'ambiguous' ELSE 'new' END AS class, l.discogs_id IS NOT NULL AS cat FROM m JOIN f ON f.batch_date = m.batch_date AND f.id = m.row_number LEFT JOIN spare ON spare.k = m.k AND spare.batch_date = m.batch_date LEFT JOIN live l ON l.discogs_id = f.ext),
g AS (SELECT id // 1000000 AS library_id, batch_date, count(*) AS gone FROM left_over GROUP BY ALL)
SELECT library_id, batch_date, count(*) AS total, count(*) FILTER (class = 'new') AS new, count(*) FILTER (class = 'existing') AS existing, count(*) FILTER (class = 'ambiguous') AS ambiguous, count(*) FILTER (target = 'physical') AS physical, count(*) FILTER (target = 'digital') AS digital, count(*) FILTER (media_condition = 'NG') AS with_warnings, count(*) FILTER (cat) AS matched_catalog, coalesce(any_value(gone), 0) AS missing_from_export FROM c LEFT JOIN g USING (library_id, batch_date) GROUP BY library_id, batch_date""")
def q_preview(spark: SparkSession, d: str) -> DataFrame:  # QRY-24, REC-06: every batch against the library's one before
    rows, known = _all_copies(spark, d, "external_id", "target", "media_condition")
    result = reconcile.multiset(rows.select("row_number", "identity_key", "content_hash", "invalid"), known)
    batch = rows.select("library_id", "batch_date", F.floor(F.col("row_number") / _PLACE).alias("place")).distinct()
    notes = F.array_compact(F.array(F.when(F.col("media_condition") == "NG", "not graded")))
    facts = reconcile.matched(rows.withColumn("ext", F.col("external_id").try_cast("bigint")), releases(spark, d), "ext", "discogs_id", "discogs_id").select("row_number", "library_id", "batch_date", "target", notes.alias("warnings"), "catalog_id")
    gone = reconcile.missing(known, result).select(F.floor(F.col("entry_id") / _PLACE).alias("place"), F.floor(F.col("entry_id") % _PLACE / 1000000).alias("library_id")).join(batch, ["library_id", "place"])
    return reconcile.preview(result, facts, gone, ["library_id", "batch_date"]).drop("changed", "invalid")


def catalog_documents(spark: SparkSession, d: str) -> DataFrame:
    """ref (type:id), title, people, codes, extra of releases, masters and artists."""
    r = releases(spark, d, "title", "catalog_number", "label_name", "country", "format_name").withColumn("code", F.when(F.col("catalog_number") != "none", F.col("catalog_number")))
    docs = r.select(F.concat(F.lit("release:"), "discogs_id").alias("ref"), "title", F.lit("").alias("people"), F.concat_ws(" ", "code", text.normalize_code(F.col("code"))).alias("codes"), F.concat_ws(" ", "label_name", "country", "format_name").alias("extra"))
    m = table(spark, d, "master_records").select("discogs_id", "title", "artists", "genres", "styles", "master_year").distinct()
    credited = m.select(F.col("discogs_id").alias("ext_id"), F.explode("artists.artist").alias("a")).select("ext_id", F.coalesce(F.nullif("a.anv", F.lit("")), "a.name").alias("credit"))
    masters = entities.master_documents(m.select(F.col("discogs_id").alias("ext_id"), "title", F.col("master_year").alias("year"), F.col("genres.genre").alias("genres"), F.col("styles.style").alias("styles")).distinct(), credited)
    a = relational.last_wins(table(spark, d, "artist_snapshots").select("discogs_id", "snapshot_date", "loaded_at", "name", "realname", "namevariations"), ["discogs_id"], ["snapshot_date", "loaded_at"])
    artists = entities.artist_documents(a.select(F.col("discogs_id").alias("ext_id"), "name", "realname", F.col("namevariations.name").alias("variations"), F.lit(None).cast("array<string>").alias("aliases")))
    of = lambda df, kind: df.select(F.concat(F.lit(f"{kind}:"), "ext_id").alias("ref"), "title", "people", "codes", "extra")
    return docs.unionByName(of(masters, "master")).unionByName(of(artists, "artist"))


_WORDS = "list_filter(string_split_regex(lower(strip_accents(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_DOCS = f"""{_LIVE}, rel AS (SELECT 'release:' || discogs_id AS ref, title, '' AS people, concat_ws(' ', nullif(catalog_number, 'none'), nullif(regexp_replace(upper(nullif(catalog_number, 'none')), '[^A-Z0-9]', '', 'g'), '')) AS codes, concat_ws(' ', label_name, country, format_name) AS extra FROM live),
mm AS (SELECT DISTINCT discogs_id, title, artists, genres, styles, master_year FROM master_records), mc AS (SELECT DISTINCT discogs_id, coalesce(nullif(a.anv, ''), a.name) AS c FROM (SELECT discogs_id, unnest(artists.artist) AS a FROM mm)), mp AS (SELECT discogs_id, string_agg(c, ' ') AS people FROM mc GROUP BY 1),
mas AS (SELECT DISTINCT 'master:' || mm.discogs_id AS ref, title, coalesce(people, '') AS people, '' AS codes, concat_ws(' ', array_to_string(list_filter(genres.genre, lambda x: x IS NOT NULL), ' '), array_to_string(list_filter(styles.style, lambda x: x IS NOT NULL), ' '), master_year) AS extra FROM mm LEFT JOIN mp USING (discogs_id)),
art AS (SELECT 'artist:' || discogs_id AS ref, name AS title, coalesce(array_to_string(list_slice(list_filter(namevariations.name, lambda x: x IS NOT NULL), 1, 20), ' '), '') AS people, '' AS codes, coalesce(realname, '') AS extra FROM (SELECT *, row_number() OVER (PARTITION BY discogs_id ORDER BY snapshot_date DESC, loaded_at DESC) AS rn FROM artist_snapshots) WHERE rn = 1),
docs AS (SELECT * FROM rel UNION ALL SELECT * FROM mas UNION ALL SELECT * FROM art),
tok AS (SELECT ref, 10.0 AS w, unnest({_WORDS.format('title')}) AS term FROM docs UNION ALL SELECT ref, 3.0, unnest({_WORDS.format('people')}) FROM docs UNION ALL SELECT ref, 6.0, unnest({_WORDS.format('codes')}) FROM docs UNION ALL SELECT ref, 1.0, unnest({_WORDS.format('extra')}) FROM docs),
len AS (SELECT ref, count(*) AS l FROM tok GROUP BY ref), st AS (SELECT count(*) AS docs, avg(l) AS av FROM len),
h AS (SELECT ref, 0 AS w, CAST(sum(w) AS DOUBLE) AS n FROM tok WHERE term = 'vinyl' GROUP BY ref UNION ALL SELECT ref, 1, CAST(sum(w) AS DOUBLE) FROM tok WHERE starts_with(term, 'vol') GROUP BY ref),
df AS (SELECT w, count(*) AS df FROM h GROUP BY w),
s AS (SELECT h.ref, count(*) AS k, -sum(greatest(1e-6, ln((docs - df + 0.5) / (df + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / av))) AS score FROM h JOIN df USING (w) JOIN len USING (ref) CROSS JOIN st GROUP BY h.ref)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    posted, lengths = indexed(spark, d, "catalog", "ref", list(search.WEIGHTS), lambda: catalog_documents(spark, d))
    return search.ranked(posted, lengths, "ref", search.compile_query("vinyl vol")).withColumn("score", F.round("score", 6))


@query(f"WITH {_DOCS} SELECT ref, round(score, 6) AS score FROM s WHERE k = 2")
def q_search_weighted(spark: SparkSession, d: str) -> DataFrame:  # FTS-01, FTS-06, SNK-03: all hits over all types, by field weights
    return _found(spark, d)


@query(f"WITH {_DOCS}, top AS (SELECT ref, round(score, 6) AS score FROM s WHERE k = 2 AND ref LIKE 'release:%' ORDER BY round(score, 6), ref LIMIT 20) SELECT CAST(split_part(ref, ':', 2) AS BIGINT) AS ext_id, score, row_number() OVER (ORDER BY score, ref) AS rank, title, country FROM top JOIN live ON discogs_id = CAST(split_part(ref, ':', 2) AS BIGINT)")
def q_search_hydrated(spark: SparkSession, d: str) -> DataFrame:  # FTS-07, FTS-10: the best twenty releases with their rows
    best = search.of_type(_found(spark, d), "ref", "release").orderBy("score", "ref").limit(20)
    r = releases(spark, d, "title", "country").withColumnRenamed("discogs_id", "ext_id")
    return search.hydrated(best, "ref", release=r).select("ext_id", "score", F.col("rank").cast("bigint").alias("rank"), "title", "country")


@query("WITH d AS (SELECT discogs_id AS ref, title FROM release_records WHERE dump_date = '2025-03-01' GROUP BY ALL), old AS (SELECT ref, min(title) AS title FROM d GROUP BY ref), new AS (SELECT discogs_id AS ref, min(title) AS title FROM release_records WHERE dump_date > '2025-03-01' AND discogs_id % 5 <> 0 GROUP BY 1), gone AS (SELECT DISTINCT discogs_id AS ref FROM release_records WHERE dump_date > '2025-03-01' AND discogs_id % 5 = 0), n AS (SELECT * FROM old WHERE ref NOT IN (SELECT ref FROM new) AND ref NOT IN (SELECT ref FROM gone) UNION ALL SELECT * FROM new), t AS (SELECT ref, " + _WORDS.format("title") + " AS w FROM n) SELECT ref, len(w) AS length, list_count(list_filter(w, lambda x: x = 'vol')) AS vols FROM t WHERE len(w) > 0")
def q_index_update(spark: SparkSession, d: str) -> DataFrame:  # FTS-08: documents replaced and removed in postings and lengths
    r = table(spark, d, "release_records").select(F.col("discogs_id").alias("ref"), "title", "dump_date")
    old = r.filter("dump_date = '2025-03-01'").groupBy("ref").agg(F.min("title").alias("title"))
    later = r.filter("dump_date > '2025-03-01'")
    new, gone = later.filter("ref % 5 <> 0").groupBy("ref").agg(F.min("title").alias("title")), later.filter("ref % 5 = 0").select("ref").distinct()
    posted = search.postings(old, "ref", ["title"])
    lengths = search.updated_lengths(search.lengths(posted, "ref"), new, gone, "ref", ["title"])
    vols = search.updated(posted, new, gone, "ref", ["title"]).groupBy("ref").agg(F.count_if(F.col("term") == "vol").alias("vols"))
    return lengths.join(vols, "ref").select("ref", "length", "vols")


_YEAR = "CASE WHEN CAST(nullif(regexp_extract(coalesce(released, ''), '^([0-9]{4})', 1), '') AS INT) BETWEEN 1850 AND 2100 THEN CAST(nullif(regexp_extract(coalesce(released, ''), '^([0-9]{4})', 1), '') AS INT) END"


@query(f"""WITH {_LIVE}, terms AS (SELECT discogs_id, unnest(genres.genre) AS term FROM master_records UNION SELECT discogs_id, unnest(styles.style) FROM master_records),
r AS (SELECT *, {_YEAR} AS year FROM live WHERE list_contains({_WORDS.format('title')}, 'vol') AND master_discogs_id IN (SELECT discogs_id FROM terms WHERE term IN ('Jazz', 'House', 'Pop', 'Rock')) AND format_name IN ('Vinyl', 'CD', 'Cassette')),
w AS (SELECT coalesce('m' || master_discogs_id, 'r' || discogs_id) AS work, arg_min(title, discogs_id) AS title, count(*) AS n, min(year) AS year FROM r WHERE year BETWEEN 1950 AND 2020 GROUP BY 1)
SELECT work, title, n, year, (SELECT count(*) FROM w) AS total, false AS truncated FROM w ORDER BY lower(title), work LIMIT 24""")
def q_browse(spark: SparkSession, d: str) -> DataFrame:  # QRY-01, SRT-07, SRT-10: a page is the operator
    m = table(spark, d, "master_records")
    terms = relational.union_distinct(m.select(F.col("discogs_id").alias("master_discogs_id"), F.explode("genres.genre").alias("term")), m.select(F.col("discogs_id").alias("master_discogs_id"), F.explode("styles.style").alias("term")))
    r = releases(spark, d, "master_discogs_id", "title", "released", "country", "format_name").withColumn("year", parsing.year_in(F.col("released"), 1850, 2100, at_start=True)).withColumn("released", F.lit(None))
    posted, lengths = indexed(spark, d, "catalog", "ref", list(search.WEIGHTS), lambda: catalog_documents(spark, d))
    hits = search.of_type(search.ranked(posted.filter("field = 'title'"), lengths, "ref", search.compile_query("vol", prefix_from=99)), "ref", "release").select(F.substring_index("ref", ":", -1).cast("bigint").alias("discogs_id"), "score")
    return entities.browse(r, hits, terms, ["Jazz", "House", "Pop", "Rock"], False, ["Vinyl", "CD", "Cassette"], [], (1950, 2020), 1, 24, most_hits=1_000_000)


@query("WITH n AS (SELECT * FROM artist_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM artist_snapshots)), one AS (SELECT discogs_id, arg_max(name, loaded_at) AS name FROM n GROUP BY 1), al AS (SELECT discogs_id, unnest(aliases.name) AS a FROM n), me AS (SELECT discogs_id, unnest(members.name) AS m FROM n), gr AS (SELECT m._id AS discogs_id, one.name FROM me JOIN one ON one.discogs_id = me.discogs_id) SELECT one.discogs_id, one.name, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT a._VALUE AS v FROM al WHERE al.discogs_id = one.discogs_id AND a._VALUE IS NOT NULL)), '') AS aliases, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT m._VALUE AS v FROM me WHERE me.discogs_id = one.discogs_id AND m._VALUE IS NOT NULL)), '') AS members, coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT name AS v FROM gr WHERE gr.discogs_id = one.discogs_id)), '') AS groups FROM one")
def q_artist_page(spark: SparkSession, d: str) -> DataFrame:  # QRY-07, QRY-10: every artist with aliases, members and groups
    a = table(spark, d, "artist_snapshots").select("snapshot_date", "discogs_id", "name", "aliases", "members", "loaded_at")
    a = a.join(F.broadcast(a.agg(F.max("snapshot_date").alias("snapshot_date"))), "snapshot_date", "left_semi")  # one row
    one = a.groupBy("discogs_id").agg(F.max_by("name", "loaded_at").alias("name"))
    child = lambda c: a.select("discogs_id", F.explode(f"{c}.name").alias("x"))
    al, me = child("aliases").select("discogs_id", F.col("x._VALUE").alias("v")).filter("v IS NOT NULL").distinct(), child("members")
    gr = me.select("discogs_id", F.col("x._id").alias("of")).join(one.select("discogs_id", "name"), "discogs_id").select(F.col("of").alias("discogs_id"), F.col("name").alias("v")).filter("discogs_id IS NOT NULL AND v IS NOT NULL").distinct()
    page = entities.with_children(one, "discogs_id", aliases=(al, ["v"]), members=(me.select("discogs_id", F.col("x._VALUE").alias("v")).filter("v IS NOT NULL").distinct(), ["v"]), groups=(gr, ["v"]))
    return page.select("discogs_id", "name", *[F.array_join(F.transform(c, lambda x: x["v"]), "|").alias(c) for c in ("aliases", "members", "groups")])


@query(f"WITH {_LIVE} SELECT label_name, discogs_id, title, nullif(catalog_number, 'none') AS catno FROM live WHERE label_name IS NOT NULL AND discogs_id > 3000500 ORDER BY discogs_id LIMIT 50")
def q_label_releases(spark: SparkSession, d: str) -> DataFrame:  # QRY-08, SRT-08: a keyset page of the releases that have a label
    r = releases(spark, d, "label_name", "title", "catalog_number").filter("label_name IS NOT NULL").select("label_name", "discogs_id", "title", F.nullif("catalog_number", F.lit("none")).alias("catno"))
    return ordering.keyset_page(r, "discogs_id", 3000500)


@query("SELECT role, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, role) AS place FROM (SELECT DISTINCT credit_id, role FROM credits WHERE owner_type = 'release' AND role IS NOT NULL) GROUP BY role")
def q_company_roles(spark: SparkSession, d: str) -> DataFrame:  # QRY-09, AGG-07: roles by count, with their place in that order
    c = table(spark, d, "credits").select("credit_id", "role", "owner_type").distinct()
    n = relational.optional(c, owner_type="release", role=None).filter("role IS NOT NULL").groupBy("role").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "role")).cast("bigint"))  # one row a role


@query("WITH c AS (SELECT DISTINCT row_id, library_id, title, folder, loaded_at FROM collection_rows), o AS (SELECT row_id, arg_max((library_id, title, folder), loaded_at) AS x FROM c WHERE library_id = 1 GROUP BY 1) SELECT o.row_id, x[2] AS title, (SELECT count(*) FROM (SELECT DISTINCT row_id, folder, library_id FROM collection_rows) f WHERE f.folder = x[3] AND f.library_id = 1) AS same_folder FROM o")
def q_own_copies(spark: SparkSession, d: str) -> DataFrame:  # QRY-15, FLT-10: an owner's copies with what shares their folder
    c = table(spark, d, "collection_rows").filter("library_id = 1").select("row_id", "title", "folder", "loaded_at")
    one = relational.last_wins(c, ["row_id"], ["loaded_at"])
    n = c.select("row_id", "folder").distinct().groupBy("folder").agg(F.count("*").alias("same_folder"))
    return one.join(n, "folder", "left").select("row_id", "title", F.coalesce("same_folder", F.lit(0)).cast("bigint").alias("same_folder"))


@query("WITH f AS (SELECT DISTINCT library_id, folder FROM collection_rows WHERE folder IS NOT NULL UNION SELECT DISTINCT library_id, 'Empty shelf' FROM collection_rows), n AS (SELECT library_id, folder, count(DISTINCT row_id) AS n FROM collection_rows GROUP BY ALL) SELECT f.library_id, f.folder, coalesce(n, 0) AS n FROM f LEFT JOIN n ON n.library_id = f.library_id AND n.folder = f.folder")
def q_crates(spark: SparkSession, d: str) -> DataFrame:  # QRY-16: crates with their number of items, empty ones kept
    c = table(spark, d, "collection_rows").select("library_id", "folder", "row_id")
    crates = relational.union_distinct(c.filter("folder IS NOT NULL").select("library_id", "folder"), c.select("library_id", F.lit("Empty shelf").alias("folder")))
    return crates.join(c.groupBy("library_id", "folder").agg(F.count_distinct("row_id").alias("n")), ["library_id", "folder"], "left").select("library_id", "folder", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id, event_type")
def q_run_listing(spark: SparkSession, d: str) -> DataFrame:  # QRY-28, AGG-14: runs (users) with their events, errors and last time
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT '{' || '\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' AS json FROM orders")
def q_json_rows(spark: SparkSession, d: str) -> DataFrame:  # SNK-04
    return tables.as_json(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus")))
