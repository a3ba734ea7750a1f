"""SQL counterparts of the general problems' queries."""

P1 = r"""
WITH raw AS (
  SELECT DISTINCT file_id, CAST(row_number AS BIGINT) AS row_number,
         regexp_replace(regexp_replace(coalesce(raw_text, ''), '^\x{FEFF}', ''), '(\r\n|\n|\r)\z', '') AS t
  FROM csv_rows WHERE file_id IS NOT NULL
), parsed AS (
  SELECT file_id, row_number, t,
         regexp_full_match(t, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS good,
         list_transform(regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
                        lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) AS cells
  FROM raw
), heads AS (
  SELECT file_id, list_transform(cells, lambda c: lower(regexp_replace(c, '[\s_]', '', 'g'))) AS head
  FROM parsed WHERE row_number = 0
), named AS (
  SELECT p.file_id, p.row_number, p.good, len(p.cells) = len(h.head) AS fits,
         nullif(trim(p.cells[list_position(h.head, 'artist')], e' \t\r\n'), '') AS artist,
         nullif(trim(p.cells[list_position(h.head, 'title')], e' \t\r\n'), '') AS title,
         nullif(trim(p.cells[list_position(h.head, 'releaseid')], e' \t\r\n'), '') AS rid,
         nullif(trim(p.cells[list_position(h.head, 'dateadded')], e' \t\r\n'), '') AS added,
         nullif(trim(p.cells[list_position(h.head, 'released')], e' \t\r\n'), '') AS released
  FROM parsed p LEFT JOIN heads h USING (file_id) WHERE p.row_number >= 1
)
SELECT file_id, row_number,
       CASE WHEN NOT good THEN 'quoting' WHEN fits IS NOT TRUE THEN 'columns' ELSE 'value' END AS reason
FROM named
WHERE NOT good OR fits IS NOT TRUE OR artist IS NULL OR title IS NULL
   OR (rid IS NOT NULL AND NOT regexp_full_match(rid, '[0-9]{1,12}'))
   OR (added IS NOT NULL AND (NOT regexp_full_match(added, '[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?')
                              OR try_strptime(substr(added, 1, 10), '%Y-%m-%d') IS NULL))
   OR (released IS NOT NULL AND NOT regexp_matches(released, '^(19[0-9]{2}|20[0-9]{2}|2100)'))
"""

_HEAD, _BAD = P1.split("SELECT file_id, row_number,\n       CASE WHEN NOT good")[0], P1.rsplit("\nWHERE ", 1)[1]
P1_LOADED = f"""{_HEAD}
SELECT file_id, row_number, artist, title, CAST(rid AS BIGINT) AS release_id,
       strftime(coalesce(try_strptime(added, '%Y-%m-%d %H:%M:%S'), try_strptime(added, '%Y-%m-%d %H:%M'), try_strptime(added, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS date_added,
       CAST(substr(released, 1, 4) AS INT) AS released
FROM named WHERE NOT coalesce({_BAD}, false)"""


P2 = """
WITH artist_dates AS (SELECT DISTINCT discogs_id AS id, snapshot_date AS d FROM artist_snapshots),
artist_first AS (SELECT id, min(d) AS f FROM artist_dates GROUP BY id),
c AS (SELECT DISTINCT credit_id AS rec_id, dump_date AS period, discogs_artist_id AS ref_id FROM credits
      WHERE discogs_artist_id NOT IN (0, 194, 355, 118760)),
c_out AS (
  SELECT 'credits' AS ref_table, c.*, CASE WHEN f.f IS NULL THEN 'missing' WHEN f.f <= c.period THEN 'deleted' ELSE 'later' END AS reason
  FROM c LEFT JOIN artist_first f ON f.id = c.ref_id
  WHERE NOT EXISTS (SELECT 1 FROM artist_dates a WHERE a.id = c.ref_id AND a.d = c.period)),
l AS (SELECT DISTINCT discogs_id AS rec_id, dump_date AS period, parent_discogs_id AS ref_id FROM label_records WHERE parent_discogs_id <> 0),
l_state AS (
  SELECT l.*, (SELECT min(dump_date) FROM label_records p WHERE p.discogs_id = l.ref_id) AS f,
         (SELECT arg_max(p.deleted, (p.dump_date, p.load_id)) FROM label_records p WHERE p.discogs_id = l.ref_id AND p.dump_date <= l.period) AS gone
  FROM l),
m AS (SELECT DISTINCT discogs_id AS rec_id, dump_date AS period, main_release_discogs_id AS ref_id FROM master_records WHERE main_release_discogs_id <> 0),
m_state AS (
  SELECT m.*, (SELECT min(dump_date) FROM release_records p WHERE p.discogs_id = m.ref_id) AS f,
         (SELECT arg_max(p.status = 'Deleted', (p.dump_date, p.load_id)) FROM release_records p WHERE p.discogs_id = m.ref_id AND p.dump_date <= m.period) AS gone
  FROM m),
logs AS (SELECT 'label_records' AS ref_table, * FROM l_state UNION ALL SELECT 'master_records', * FROM m_state)
SELECT ref_table, rec_id, period, ref_id, reason FROM c_out
UNION ALL
SELECT ref_table, rec_id, period, ref_id, CASE WHEN f IS NULL THEN 'missing' WHEN f <= period THEN 'deleted' ELSE 'later' END
FROM logs WHERE gone IS NOT FALSE
"""

P2_COUNTS = f"""
SELECT ref_table, period, reason, count(*) AS n_records, count(DISTINCT ref_id) AS n_targets FROM ({P2}) GROUP BY ALL
"""

P3 = """
WITH a AS (
  SELECT DISTINCT 'artist' AS entity, CAST(0 AS BIGINT) AS library_id, CAST(discogs_id AS VARCHAR) AS rec_key, snapshot_date AS snapshot,
         concat_ws(chr(3), coalesce(name, ''), coalesce(realname, ''), coalesce(profile, ''), coalesce(data_quality, ''),
           array_to_string(list_sort(list_transform(coalesce(urls.url, []), lambda x: coalesce(x, ''))), chr(2)),
           array_to_string(list_sort(list_transform(coalesce(namevariations.name, []), lambda x: coalesce(x, ''))), chr(2)),
           array_to_string(list_sort(list_transform(coalesce(aliases.name, []), lambda x: concat(coalesce(x._VALUE, ''), chr(1), coalesce(CAST(x._id AS VARCHAR), '')))), chr(2)),
           array_to_string(list_sort(list_transform(coalesce(members.name, []), lambda x: concat(coalesce(x._VALUE, ''), chr(1), coalesce(CAST(x._id AS VARCHAR), '')))), chr(2))) AS content
  FROM artist_snapshots
), r AS (
  SELECT 'row' AS entity, library_id, identity_key AS rec_key, batch_date AS snapshot, array_to_string(list_sort(list(content_hash)), ',') AS content
  FROM (SELECT DISTINCT library_id, batch_date, row_number, identity_key, content_hash FROM parsed_rows WHERE identity_key IS NOT NULL) GROUP BY ALL
), s AS (SELECT * FROM a UNION ALL SELECT * FROM r),
copies AS (
  SELECT entity, library_id, snapshot, lead(snapshot) OVER (PARTITION BY entity, library_id ORDER BY snapshot) AS nxt
  FROM (SELECT DISTINCT entity, library_id, snapshot FROM s)
), olds AS (SELECT s.entity, s.library_id, s.rec_key, c.nxt AS snapshot, s.content FROM s JOIN copies c USING (entity, library_id, snapshot) WHERE c.nxt IS NOT NULL),
news AS (SELECT s.* FROM s JOIN copies c ON c.entity = s.entity AND c.library_id = s.library_id AND c.nxt = s.snapshot)
SELECT entity, library_id, rec_key, snapshot,
       CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM olds o FULL JOIN news n USING (entity, library_id, rec_key, snapshot)
WHERE o.content IS DISTINCT FROM n.content
"""

P5 = """
WITH RECURSIVE m AS (SELECT DISTINCT discogs_id, artists.artist AS items FROM master_records),
al AS (SELECT DISTINCT discogs_id, aliases.name AS items FROM artist_snapshots WHERE snapshot_date = (SELECT max(snapshot_date) FROM artist_snapshots)),
trees AS (SELECT DISTINCT rec_id, CAST(node_json AS JSON) AS node FROM xnode_records WHERE node_json IS NOT NULL),
walk AS (
  SELECT rec_id, '' AS path, '' AS parent_path, node FROM trees
  UNION ALL
  SELECT rec_id, concat(path, CASE WHEN path = '' THEN '' ELSE '/' END, k), path, child
  FROM (
    SELECT rec_id, path, unnest(kids) AS child, generate_subscripts(kids, 1) AS k
    FROM (
      SELECT rec_id, path, CASE json_type(node, '$.children') WHEN 'ARRAY' THEN CAST(node -> '$.children' AS JSON[]) WHEN 'OBJECT' THEN [node -> '$.children'] END AS kids
      FROM walk
    ) WHERE kids IS NOT NULL
  ) WHERE json_type(child) = 'OBJECT'
)
SELECT 'master_records' AS src_table, discogs_id AS rec_id, concat('artists/', i) AS path, '' AS parent_path, item.name AS name
FROM (SELECT discogs_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM m) WHERE item IS NOT NULL
UNION ALL
SELECT 'artist_snapshots', discogs_id, concat('aliases/', i), '', item._VALUE
FROM (SELECT discogs_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM al) WHERE item IS NOT NULL
UNION ALL
SELECT 'xnode_records', rec_id, path, parent_path, node ->> '$.name' FROM walk WHERE path <> ''
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p1_loaded": P1_LOADED, "p2_found": P2, "p2_counts": P2_COUNTS, "p3_found": P3, "p5_found": P5}
