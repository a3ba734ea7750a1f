import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gramoflow.operators import quality, reconcile
from gramoflow.sources import dumps, exports, guards, tables
from gramoflow.streaming import ingest

RELEASES = """<?xml version="1.0"?><releases>
<release id="1" status="Accepted"><title>One</title><released>1997-03-00</released><master_id is_main_release="true">9</master_id>
 <artists><artist><id>5</id><name>A</name><anv></anv><join>&amp;</join></artist><artist><id>0</id><name>B</name></artist></artists>
 <labels><label name="L" catno="none" id="3"/><label name="M" catno="M-1" id="4"/></labels>
 <formats><format name="Vinyl" qty="2" text=""><descriptions><description>LP</description><description>Album</description></descriptions></format></formats>
 <tracklist><track><position>A1</position><title>T1</title><duration>1:02</duration></track><track><position></position><title>Side</title><duration></duration></track>
  <track><position>A2</position><title>Medley</title><duration></duration><sub_tracks><track><position>A2.a</position><title>S1</title></track><track><position>A2.b</position><title>S2</title></track></sub_tracks></track></tracklist>
 <identifiers><identifier type="Barcode" value="5 01" description=""/></identifiers>
 <videos><video src="https://www.youtube.com/watch?v=Qz7_xK-92Lm"><title>v</title></video><video src="https://x.y/1"/></videos></release>
<release id="abc" status="Accepted"><title>Two</title></release><release id="3" status="Accepted"><title> </title></release><release id="1" status="Accepted"><title>One again</title></release></releases>"""


def write(path, body):
    mode = "wb" if isinstance(body, bytes) else "w"
    with open(path, mode) as f:
        f.write(body)
    return str(path)


def test_dump_records_and_tables(spark, tmp_path):
    path = write(tmp_path / "catalog_20250301_releases.xml.gz", gzip.compress(RELEASES.encode()))
    good, errors = dumps.checked_records(dumps.read_dump(spark, path, "release"), "title")
    assert [(r.id, r.reason) for r in errors.orderBy("record_index").collect()] == [("abc", "not a numeric id: abc"), ("3", "no title")]
    t = dumps.release_tables(good.filter("title = 'One'"))
    main = t["releases"].first()
    assert (main.ext_id, main.year, main.master_ext_id, main.is_main, main.label_name, main.catalog_number) == (1, 1997, 9, True, "L", None)
    assert [(r.position, r.artist_ext_id, r.anv, r.join_text) for r in t["release_artists"].orderBy("position").collect()] == [(1, 5, None, "&"), (2, None, None, None)]
    assert [(r.sequence, r.parent_sequence, r.track_type, r.seconds) for r in t["release_tracks"].orderBy("sequence").collect()] == [(1, None, "track", 62), (2, None, "heading", None), (3, None, "index", None), (4, 3, "subtrack", None), (5, 3, "subtrack", None)]
    assert [r.description for r in t["release_format_descriptions"].orderBy("description_no").collect()] == ["LP", "Album"]
    assert t["release_formats"].first().qty == 2 and t["release_media_links"].count() == 1 and t["release_identifiers"].first().normalized_value == "501"
    facts = spark.range(1).select(guards.dump_facts(F.lit(path)).alias("x")).first().x
    assert (facts.kind, str(facts.day)) == ("releases", "2025-03-01")


def test_guards(spark, tmp_path):
    a = write(tmp_path / "a.xml", '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY y "z">]><x/>')
    b = write(tmp_path / "b.xml", b"\xff\xfe<x/>")
    ok = write(tmp_path / "ok.xml", "<artists><artist><id>1</id><name>N</name></artist></artists>")
    for p in (a, b):
        with pytest.raises(guards.FileRefused):
            guards.refuse_unsafe(spark, p)
    guards.refuse_unsafe(spark, ok)
    facts = guards.file_facts(spark, ok)
    want = hashlib.sha256(open(ok, "rb").read()).hexdigest()
    assert facts.first().sha256 == want
    assert guards.verify(facts, guards.checksums(f"{want}  ok.xml\nnonsense")).first().ok
    assert guards.verify(facts, {}).first().ok is None
    cut = spark.range(1).select(guards.clipped(F.lit("abc"), 2).alias("x")).first().x
    assert (cut.text, cut.cut) == ("ab", True)
    paths = quality.xml_paths(spark.read.format("binaryFile").load(ok), "content", "artist")
    assert sorted((r.path, r.value) for r in paths.collect()) == [("artist", ""), ("artist/id", "1"), ("artist/name", "N")]


CSV = '﻿Catalog#,Artist,Title,Label,Format,Released,release_id,CollectionFolder,Date Added,Collection Media Condition,Storage Box\r\nA-1,"Foo, Bar",T,L,"2xVinyl, LP",1999,12,In,2020-01-02,Mint (M),B1\r\n\r\nnone,X,"Line\r\nbreak",L,File,,,In,,odd,B1\r\nA-1,"Foo, Bar",T,L,"2xVinyl, LP",1999,12,In,2020-01-02,Mint (M),B1\r\nragged,row\r\n'


def test_collection_export(spark):
    files = spark.createDataFrame([(1, CSV)], "file_id bigint, content string")
    rows = exports.collection_rows(exports.split_records(files)).orderBy("row_number").collect()
    assert [(r.row_number, r.reason, r.target) for r in rows] == [(1, None, "physical"), (2, None, "digital"), (3, None, "physical"), (4, "columns", "physical")]
    assert rows[0].identity_key == "r:12" and rows[1].identity_key == "t:x|linebreak|" and rows[0].content_hash == rows[2].content_hash
    assert rows[1].catno is None and rows[1].warnings == ["media condition"] and rows[0].others == {"storagebox": "B1"}
    frame = exports.collection_rows(exports.split_records(files))
    known = frame.filter("reason IS NULL").select(F.col("row_number").alias("entry_id"), "identity_key", "content_hash")
    again = reconcile.multiset(frame.select("row_number", "identity_key", "content_hash", F.col("reason").isNotNull().alias("invalid")), known)
    assert {r["class"]: r["count"] for r in again.groupBy("class").count().collect()} == {"existing": 3, "invalid": 1}


DJ = """<?xml version="1.0" encoding="UTF-8"?><DJ_PLAYLISTS Version="1"><COLLECTION Entries="3">
<TRACK TrackID="1" Name="One" Artist="A" AverageBpm="122.00" Rating="255" Kind="MP3 File" Location="file://localhost/m/one%20x.mp3" Size="10" TotalTime="100" Year="1999"><TEMPO Inizio="0" Bpm="122.00" Metro="4/4" Battito="1"/><POSITION_MARK Name="c" Type="0" Start="1" End="2" Num="0"/></TRACK>
<TRACK TrackID="2" Name="" Artist="" Kind="" Location="file://localhost/m/two.flac"/><TRACK TrackID="2" Name="Twice" Artist="B"/></COLLECTION>
<PLAYLISTS><NODE Type="0" Name="ROOT"><NODE Type="0" Name="F"><NODE Type="1" Name="P" KeyType="0"><TRACK Key="9"/><TRACK Key="1"/></NODE></NODE><NODE Type="1" Name="Q" KeyType="1"><TRACK Key="file://localhost/m/two.flac"/></NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"""


def test_dj_library(spark, tmp_path):
    path = write(tmp_path / "lib.xml", DJ)
    t = exports.dj_tracks(spark, path)
    rows = {(r.external_id, r.title): r for r in t.collect()}
    one = rows[("1", "One")]
    assert (one.bpm_x100, one.rating, one.file_format, one.location, len(one.cues), len(one.hints)) == (12200, 5, "MP3", "/m/one x.mp3", 1, 2)
    assert rows[("2", "two")].artist == "Unknown artist" and rows[("2", "two")].file_format == "FLAC"
    assert sum("track id given twice" in r.errors for r in rows.values()) == 1
    nodes, entries = exports.playlists(spark, path)
    assert sorted((r.name, r.kind, r.parent) for r in nodes.collect()) == [("F", "folder", None), ("P", "playlist", "1"), ("Q", "playlist", None)]
    good, lost = exports.resolved_entries(entries, t.filter("size(errors) = 0"))
    assert sorted((r.node, r.position, r.track) for r in good.collect()) in ([("1.1", 1, "1"), ("2", 1, "2")], [("1.1", 1, "1")])
    assert ("1.1", "9") in [(r.node, r.key) for r in lost.collect()]


def test_versioned_table_and_stream(spark, tmp_path):
    folder, runs = tmp_path / "in", str(tmp_path / "runs")
    os.makedirs(folder)
    table = tables.VersionedTable(spark, str(tmp_path / "t"))
    schema = "k string, h string, o int"
    write(folder / "a.json", '{"k":"a","h":"1","o":1}\n{"k":"b","h":"1","o":2}\n')
    run = lambda: ingest.ingest_stream(ingest.record_stream(spark, str(folder), schema, 1), table, "k", "h", "o", str(tmp_path / "cp"), runs).awaitTermination()
    run()
    write(folder / "b.json", '{"k":"a","h":"2","o":1}\n{"k":"c","h":"1","o":2}\n')
    run()
    run()
    assert sorted((r.k, r.h) for r in table.read().collect()) == [("a", "2"), ("b", "1"), ("c", "1")]
    before = table.version()
    batch = spark.createDataFrame([("z", "1", 1)], schema)
    with pytest.raises(RuntimeError):
        ingest.apply_batch(table, batch, "k", "h", "o", "late", runs, fail=True)
    assert table.version() == before
    for _ in range(2):  # a batch that is run again counts once
        ingest.apply_batch(table, batch, "k", "h", "o", "late", runs)
    assert table.version() == before + 1 and table.read().count() == 4
    assert {(r.action, r.n) for r in spark.read.json(runs).filter("batch_key = 'late'").collect()} >= {("insert", 1)}


def test_index_files(spark, tmp_path):
    from gramoflow.operators import search

    docs = spark.createDataFrame([(1, "green violin"), (2, "violin")], "id bigint, title string")
    p = search.postings(docs, "id", ["title"])
    tables.write_index(p, search.lengths(p, "id"), str(tmp_path / "i"), 2)
    posted, lengths = tables.read_index(spark, str(tmp_path / "i"))
    assert [r.id for r in search.ranked(posted, lengths, "id", search.compile_query("violin"), limit=1).collect()] == [2]
    assert '"title":"violin"' in tables.as_json(docs.filter("id = 2")).first().json


def test_freshness_and_generator(spark, tmp_path):
    f = tables.Freshness(spark, str(tmp_path / "f"))
    f.mark("2025-01-02", "import")
    f.mark("2025-01-03", "edit")
    assert tuple(f.state().first()) == ("2025-01-02", "edit")
    f.rebuilt("2025-01-04")
    assert tuple(f.state().first()) == (None, None)
    g = tables.generated(spark, 100, 7, kind=["a", "b", "c"])
    assert g.count() == 100 and sorted(map(tuple, g.collect())) == sorted(map(tuple, tables.generated(spark, 100, 7, kind=["a", "b", "c"]).collect()))


def test_split_records_by_cells(spark):
    """A stray quote spoils its own record only; line ends inside quotes stay; a quote that never ends takes its line."""
    body = '\ufeffA,B\r\n1,12" mix\r\n\r\n2,"two\nlines"\r\n3,"say ""x"""\n4,"open\n5,last'
    df = spark.createDataFrame([(7, body), (8, None), (9, "")], "file_id int, content string")
    got = [(r.file_id, r.row_number, r.raw_text) for r in exports.split_records(df).collect()]
    assert got == [(7, 0, "A,B"), (7, 1, '1,12" mix'), (7, 2, '2,"two\nlines"'), (7, 3, '3,"say ""x"""'), (7, 4, '4,"open'), (7, 5, "5,last")]


def test_header_aliases(spark):
    rows = spark.createDataFrame([(1, 0, "Catno,Artists,Title,Labels,Formats,Year,Folder,Added"), (1, 1, "Q-1,Ann,Song,Lab,LP,1999,Box,2024-01-02")], "file_id int, row_number int, raw_text string")
    r = exports.collection_rows(rows).first()
    assert (r.catno, r.artist, r.label, r.format_raw, r.released, r.folder, str(r.date_added)) == ("Q-1", "Ann", "Lab", "LP", 1999, "Box", "2024-01-02 00:00:00")


def test_facts_of_long_files(spark, tmp_path):
    """The whole file is looked at, in pieces: a document type behind a long comment, a broken letter at a piece's end."""
    bodies = {"a.xml": b"<!--" + b"x" * 300_000 + b"--><!DocType a>", "b.xml": ("é" * 70_001).encode(), "c.xml": b"ok\xc3", "d.xml.gz": gzip.compress(b"<a/>" * 9) + gzip.compress(b"<!ENTITY x>"), "e.xml": gzip.compress(b"<a/>")}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r for r in guards.file_facts(spark, str(tmp_path), piece=1001).collect()}
    assert {n: (r.n_bytes, r.sha256) for n, r in got.items()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    assert {n: (r.gzipped, r.doctype, r.utf8) for n, r in got.items()} == {"a.xml": (False, True, True), "b.xml": (False, False, True), "c.xml": (False, False, False), "d.xml.gz": (True, True, True), "e.xml": (True, False, True)}
    for name in ("a.xml", "c.xml", "e.xml"):
        with pytest.raises(guards.FileRefused):
            guards.refuse_unsafe(spark, f"{tmp_path}/{name}")


def test_record_limits_and_places(spark, tmp_path, monkeypatch):
    records = "".join(f"<label><id>{i}</id><name>{'n' * (50 if i == 3 else 5)}</name><urls>{'<url>u</url>' * (9 if i == 4 else 1)}</urls></label>" for i in range(1, 8))
    (tmp_path / "l.xml").write_text(f"<labels>{records}</labels>")
    monkeypatch.setattr(guards, "MOST_NODES", 10)
    read = dumps.read_dump(spark, str(tmp_path / "l.xml"), "label", most_text=20)
    assert {r.id: (r.record_index, r.clipped, len(r.name)) for r in read.collect()} == {str(i): (i - 1, i == 3, 20 if i == 3 else 5) for i in range(1, 8)}
    good, bad = dumps.checked_records(read, "name")
    assert [(r.id, r.reason) for r in bad.collect()] == [("4", "too many nodes")] and good.count() == 6
