from pyspark.sql import functions as F

from gramoflow.operators import duplicates, quality, reconcile, relational as rl, search, upsert


def test_moves_and_appends(spark):
    df = spark.createDataFrame([("g", i, chr(96 + i)) for i in range(1, 6)] + [("h", 1, "z")], "g string, position bigint, item string")
    order = lambda d: [r.item for r in d.filter("g = 'g'").orderBy("position").collect()]
    assert order(rl.move(df, ["g"], F.col("item") == "d", 1)) == list("dabce")
    assert order(rl.move(df, ["g"], F.col("item") == "b", 99)) == list("acdeb")
    assert order(rl.move(df, ["g"], F.col("item") == "b", 3)) == list("acbde")
    assert order(rl.move(df, ["g"], F.col("item") == "q", 1)) == list("abcde")
    new = spark.createDataFrame([("g", "x"), ("k", "y")], "g string, item string")
    assert sorted((r.g, r.position) for r in rl.append_positions(df, new, ["g"], ["item"]).collect()) == [("g", 6), ("k", 1)]


def test_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted((r.k, r.v) for r in rl.last_wins(df, ["k"], ["o"]).collect()) == [("a", "y"), ("b", None)]
    assert sorted((r.k, r.v) for r in rl.first_per_group(df, ["k"], ["o"]).collect()) == [("a", "x"), ("b", None)]
    assert sorted((r.o, r.duplicate) for r in rl.first_wins(df, ["k"], ["o"]).filter("k = 'a'").collect()) == [(1, False), (2, True)]


def test_reconcile_goldens(spark):
    known = spark.createDataFrame([(1, "r:1", "h1"), (2, "r:1", "h1"), (3, "r:2", "h2"), (4, "r:3", "h3")], "entry_id bigint, identity_key string, content_hash string")
    rows = spark.createDataFrame([(1, "r:1", "h1", False), (2, "r:1", "h1", False), (3, "r:1", "h1", False), (4, "r:2", "hX", False), (5, "r:9", "h", False), (6, "r:3", "h3", True)], "row_number bigint, identity_key string, content_hash string, invalid boolean")
    got = {r.row_number: (r["class"], r.entry_id, r.candidates) for r in reconcile.multiset(rows, known).collect()}
    assert got == {1: ("existing", 1, []), 2: ("existing", 2, []), 3: ("new", None, []), 4: ("ambiguous", None, [3]), 5: ("new", None, []), 6: ("invalid", None, [])}
    assert sorted(r.entry_id for r in reconcile.missing(known, reconcile.multiset(rows, known)).collect()) == [3, 4]
    assert [r.entry_id for r in reconcile.missing(known, reconcile.multiset(rows, known), True).collect()] == [4]
    assert reconcile.preview(reconcile.multiset(rows, known)).first().new == 2
    twice = reconcile.multiset(rows, known).withColumn("g", F.lit("x")).unionByName(spark.createDataFrame([(7, "ambiguous", None, [3, 8], "x")], "row_number bigint, class string, entry_id bigint, candidates array<bigint>, g string"))
    assert sorted(tuple(r) for r in reconcile.decide_links(twice, "g").collect()) == [(4, 3), (7, 8)]


def test_reconcile_invariants(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, f"k{rnd.randint(0, 5)}", f"h{rnd.randint(0, 2)}", False) for i in range(80)]
    known = [(i, f"k{rnd.randint(0, 6)}", f"h{rnd.randint(0, 2)}") for i in range(60)]
    r = spark.createDataFrame(rows, "row_number bigint, identity_key string, content_hash string, invalid boolean")
    k = spark.createDataFrame(known, "entry_id bigint, identity_key string, content_hash string")
    got = reconcile.multiset(r, k).collect()
    from collections import Counter

    a, b = Counter((x[1], x[2]) for x in rows), Counter((x[1], x[2]) for x in known)
    existing = sum(min(n, b[p]) for p, n in a.items())
    assert len(got) == 80 and sum(x["class"] == "existing" for x in got) == existing
    assert reconcile.missing(k, reconcile.multiset(r, k)).count() == 60 - existing


def test_upsert_is_idempotent_and_keeps_ids(spark):
    cur = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 2), ("c", "h3", 3)], "k string, h string, id bigint")
    inc = spark.createDataFrame([("a", "h1"), ("b", "hX"), ("d", "h4"), ("e", "h5"), ("c", "hY")], "k string, h string")
    done = upsert.classify(cur, inc, "k", "h", F.col("k") == "c")
    assert {r.k: r.action for r in done.collect()} == {"a": "unchanged", "b": "update", "c": "conflict", "d": "insert", "e": "insert"}
    nxt = upsert.apply(cur, upsert.with_surrogates(cur, done, "k", "id", "k"), "k")
    assert sorted((r.k, r.h, r.id) for r in nxt.collect()) == [("a", "h1", 1), ("b", "hX", 2), ("c", "h3", 3), ("d", "h4", 4), ("e", "h5", 5)]
    again = upsert.classify(nxt, inc.filter("k <> 'c'"), "k", "h")
    assert {r.action for r in again.collect()} == {"unchanged"}
    _, tally = upsert.ingest(cur.select("k", "h"), spark.createDataFrame([("a", "h1", 1), ("a", "h9", 2), ("z", "h", 3)], "k string, h string, o int"), "k", "h", "o")
    assert {r.action: r.n for r in tally.collect()} == {"update": 1, "insert": 1, "unchanged": 1}


def test_provenance_references_and_undo(spark):
    now = F.lit("t2")
    p = upsert.provenance(spark.createDataFrame([("a", "h1", "t1", "t1"), ("b", "h2", "t1", "t1")], "k string, hash string, first_seen string, last_seen string"), spark.createDataFrame([("a", "h9"), ("c", "h3")], "k string, hash string"), ["k"], now)
    assert sorted(tuple(r) for r in p.collect()) == [("a", "h9", "t1", "t2"), ("b", "h2", "t1", "t1"), ("c", "h3", "t2", "t2")]
    dim = spark.createDataFrame([(10, 1), (20, 2)], "id bigint, x bigint")
    facts = spark.createDataFrame([("f1", None, 1), ("f2", None, 9), ("f3", 20, 1), ("f4", None, None), ("f5", None, 194)], "f string, fk bigint, ext bigint")
    fixed = upsert.resolve(upsert.repair(facts, dim, "fk", "ext", "id", "x"), dim, "fk", "ext", "id", "x")
    assert {r.f: r.fk for r in fixed.collect()} == {"f1": 10, "f2": None, "f3": 10, "f4": None, "f5": None}
    assert tuple(upsert.reference_counts(fixed, "fk", "ext", (194,)).first()) == (2, 1, 1, 1)
    cur = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "k string, v int")
    changes = spark.createDataFrame([("a", "updated", ("a", 1)), ("b", "created", None), ("c", "created", None)], "k string, kind string, previous struct<k:string,v:int>")
    assert sorted(tuple(r) for r in upsert.undo(cur, changes, [spark.createDataFrame([("c",)], "k string")], "k").collect()) == [("a", 1), ("c", 1)]
    com = upsert.companies(spark.createDataFrame([(1, "A"), (None, "X")], "ext_id bigint, name string"), spark.createDataFrame([(1, "B", 1), (2, "C", 2), (2, "D", 1), (None, "X", 1), (None, "Y", 1)], "ext_id bigint, name string, ord int"))
    assert sorted((r.ext_id or 0, r.name) for r in com.collect()) == [(0, "X"), (0, "Y"), (1, "A"), (2, "D")]


def test_search_goldens(spark):
    docs = spark.createDataFrame([(1, "Été à Paris", "José", "QXR-104", "x"), (2, "Summer in Paris", "Paris Duo", "QXR104B", "x"), (3, "Night", "Nobody", None, "paris paris")], "id bigint, title string, people string, codes string, extra string")
    p = search.postings(docs, "id", ["title", "people", "codes", "extra"])
    ids = lambda q: [r.id for r in search.ranked(p, search.lengths(p, "id"), "id", search.compile_query(q)).orderBy("score", "id").collect()]
    assert ids("ete paris") == [1]
    assert ids("pari") == [2, 1, 3] or set(ids("pari")) == {1, 2, 3}
    assert set(ids("QXR-104")) == {1, 2}
    assert ids("summer-in") == [2] and ids("in-summer") == []
    assert ids('"*(') == [] and ids("jose") == [1]
    changed = spark.createDataFrame([(3, "Autumn", None, None, None)], "id bigint, title string, people string, codes string, extra string")
    q = search.updated(p, changed, spark.createDataFrame([(2,)], "id bigint"), "id", ["title", "people", "codes", "extra"])
    full = search.postings(docs.filter("id = 1").unionByName(changed), "id", ["title", "people", "codes", "extra"])
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, full.collect()))


def test_duplicates_and_quality(spark):
    recs = spark.createDataFrame([(1, "ABC123", 7, "LP", "UK", 1990, "L"), (2, "ABC124", 7, "LP", "UK", 1990, "L"), (3, "ABC123", None, "CD", None, None, "L"), (4, "ZZZ", 8, "LP", "UK", 1990, "M"), (5, None, 7, "CD", "UK", None, None)], "id bigint, code string, work bigint, format string, country string, year int, label string")
    got = {(r.id, r.other): r.score for r in duplicates.candidates(recs, recs).collect()}
    assert got[(1, 2)] == 2 + 1 + 2 + 1 + 1 and got[(1, 3)] == 5 + 1 and (4, 1) not in got and (1, 5) not in got
    df = spark.createDataFrame([(1, None, 5), (1, 2, None), (None, 3, 3)], "a bigint, b bigint, c bigint")
    assert [tuple(r) for r in quality.violations(df, one=quality.exactly_one(F.col("b"), F.col("c")), small=F.col("a") < 5).collect()] == [("one", 1)]
    assert [tuple(r) for r in quality.repeated_keys(df, ["a"]).collect()] == [(1, 2)]


def test_guarded_update_soft_delete_and_links(spark):
    cur = spark.createDataFrame([(1, 0, None), (2, 5, None), (3, 0, "t0")], "k bigint, version bigint, deleted_at string")
    req = spark.createDataFrame([(1, 10, 0), (1, 9, 0), (2, 11, 4), (9, 12, 0)], "k bigint, request bigint, want bigint")
    nxt, judged = upsert.guarded(cur, req, "k", F.col("version") == F.col("want"), {"version": F.col("version") + 1})
    assert {r.request: r.won for r in judged.collect()} == {9: True, 10: False, 11: False, 12: False}
    assert {r.k: r.version for r in nxt.collect()} == {1: 1, 2: 5, 3: 0}
    gone = upsert.soft_deleted(cur, spark.createDataFrame([(1,), (3,)], "k bigint"), "k", F.lit("t9"))
    assert {r.k: r.deleted_at for r in gone.collect()} == {1: "t9", 2: None, 3: "t0"}
    links = spark.createDataFrame([(1, "a")], "k bigint, tag string")
    more = upsert.link_all(links, cur, F.lit("a"), ["k"], "tag")
    assert sorted(tuple(r) for r in more.collect()) == [(1, "a"), (2, "a"), (3, "a")]
    assert sorted(r.k for r in upsert.unlink_all(more, cur.filter("k < 3"), ["k"], "tag", "a").collect()) == [3]


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in rl.union_last([a, b], ["k"]).collect()) == [(1, "x"), (2, "z")]
    lists = spark.createDataFrame([("r1", 1, "a"), ("r1", 2, "b"), ("r2", 1, "a")], "r string, p int, v string")
    assert sorted((x.p, x.vals, x.differs) for x in rl.compare_sequences(lists, "r", "p", "v").collect()) == [(1, ["a", "a"], False), (2, ["b", "—"], True)]


def test_nested_entities(spark):
    from gramoflow.operators import entities

    p = spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, name string")
    c = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id bigint, pos int, v string")
    got = {r.id: [(x.pos, x.v) for x in r.kids] for r in entities.with_children(p, "id", kids=(c, ["pos", "v"])).collect()}
    assert got == {1: [(1, "x"), (2, "y")], 2: []}
    docs = entities.artist_documents(spark.createDataFrame([(1, "N", None, ["v", None], None)], "ext_id bigint, name string, realname string, variations array<string>, aliases array<string>"))
    assert tuple(docs.first()) == (1, "N", "v", "", "")


def test_either_summary_sums_up_before_it_joins(spark):
    """What either_join and then grouping gives, with nulls and repeated rows, without a pair of each two rows of a hot key."""
    left = spark.createDataFrame([(1, 10, "x"), (2, None, "x"), (2, None, "x"), (3, None, None), (4, 99, "x"), (5, None, "y")], "g int, e bigint, b string")
    right = spark.createDataFrame([(10, "x"), (10, "x"), (11, "x"), (12, "y"), (13, None), (None, "x")], "p bigint, brand string")
    pairs = rl.either_join(left, right, ("e", "p"), ("b", "brand")).groupBy("g").agg(F.count("*").alias("n"), F.min("p").alias("least"))
    got = rl.either_summary(left, right, ("e", "p"), ("b", "brand"), "g", "p", "n", "least")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) == [(1, 2, 10), (2, 8, 10), (5, 1, 12)]
    hot = spark.range(200_000)
    rows = rl.either_summary(hot.select("id", F.lit(None).cast("bigint").alias("e"), F.lit("x").alias("b")), hot.select(F.col("id").alias("p"), F.lit("x").alias("brand")), ("e", "p"), ("b", "brand"), "id", "p", "n", "least")
    assert tuple(rows.agg(F.count("*"), F.min("n"), F.max("n"), F.max("least")).first()) == (200_000, 200_000, 200_000, 0)


def test_counts_of_relations_pass_nothing_through_the_driver(spark):
    dim = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (3, 31)], "id bigint, x bigint")
    rows = [(None, 10, False)] * 40 + [(1, 10, False), (1, 20, False), (1, 20, True), (1, 20, None), (None, 99, False), (None, 194, False), (None, None, False), (7, 20, False), (7, None, False), (3, 31, False)]
    facts = spark.createDataFrame(rows, "fk bigint, ext bigint, edited boolean")
    for edited in (None, F.col("edited")):
        r = upsert.Relation("a", facts, dim, "fk", "ext", "id", "x", (194,), edited)
        for written in (None, {"a": spark.createDataFrame([(20,), (31,), (99,)], "ext bigint")}):
            done, counts = upsert.reconcile_all([r, r], written)
            last = upsert.reference_counts(done["a"], "fk", "ext", (194,)).first()
            got = counts.collect()
            assert len(got) == 2 and tuple(got[1])[2:] == tuple(last) and counts.schema["none"].dataType.simpleString() == "bigint"
    none = upsert.reconcile_all([upsert.Relation("a", facts.limit(0), dim, "fk", "ext", "id", "x")])[1]
    assert tuple(none.first())[2:] == (0, 0, 0, 0)
    assert "Broadcast" not in upsert.reconcile_all([r])[1]._jdf.queryExecution().executedPlan().toString()
