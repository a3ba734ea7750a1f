"""Upserts by content hash, surrogate keys, provenance and late references (MUT-01..08, 14, 16, 17, 19; STR-05)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramoflow.operators.relational import last_wins
from gramoflow.operators.scale import sized_join, stage


def classify(current: DataFrame, incoming: DataFrame, key: str, hash_column: str, edited: Column | None = None) -> DataFrame:
    """incoming with ``action``: insert, unchanged, conflict (edited locally) or update. Unchanged comes before conflict."""
    known = current.select(F.col(key).alias("_k"), F.col(hash_column).alias("_h"), (edited if edited is not None else F.lit(False)).alias("_e"))
    joined = incoming.join(known, F.col(key) == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), "insert").when(F.col("_h") == F.col(hash_column), "unchanged").when(F.col("_e"), "conflict").otherwise("update")
    return joined.withColumn("action", action).drop("_k", "_h", "_e")


def with_surrogates(current: DataFrame, classified: DataFrame, key: str, surrogate: str, order: str) -> DataFrame:
    """Known rows keep their id, new ones get the next ones in order (MUT-03).

    Numbers are given per partition of a range sort, staged once: counts first, then offsets, so no task sees all rows."""
    ids = current.select(key, F.col(surrogate).alias("_id"))
    start = current.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("m")).first().m
    joined = classified.drop(surrogate).join(ids, key, "left")
    fresh = stage(joined.filter("_id IS NULL").drop("_id").sort(order).withColumn("_p", F.spark_partition_id()), "numbered")
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    sizes = fresh.groupBy("_p").agg(F.count("*").alias("c"))
    offsets = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_off"))  # one row a partition
    numbered = fresh.join(F.broadcast(offsets), "_p").withColumn(surrogate, (F.lit(start) + F.col("_off") + F.col("_n")).cast("bigint")).drop("_p", "_n", "_off")
    kept = joined.filter("_id IS NOT NULL").withColumnRenamed("_id", surrogate)
    return kept.unionByName(numbered)


def apply(current: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    """The next version of the table: updates replace, inserts join, everything else stays."""
    columns = current.columns
    written = stage(classified.filter(F.col("action").isin("insert", "update")).select(*columns), "written")
    # A handful of changes is broadcast, so that the table itself is not shuffled.
    return sized_join(current, written.select(key), [key], "left_anti").select(*columns).unionByName(written)


def replace_children(children: DataFrame, parents: DataFrame, new_children: DataFrame, key: str) -> DataFrame:
    """Children of the given parents replaced as a whole (MUT-02)."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(new_children)


def provenance(current: DataFrame, seen: DataFrame, key: list[str], now: Column) -> DataFrame:
    """key, hash, first_seen, last_seen: first_seen never changes (MUT-05). seen: key, hash."""
    old = current.select(*key, F.col("hash").alias("_h"), F.col("first_seen").alias("_f"), F.col("last_seen").alias("_l"))
    both = old.join(seen.select(*key, F.col("hash").alias("_n")), key, "full_outer")
    return both.select(*key, F.coalesce("_n", "_h").alias("hash"), F.coalesce("_f", now).alias("first_seen"), F.when(F.col("_n").isNotNull(), now).otherwise(F.col("_l")).alias("last_seen"))


def insert_missing(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """MUT-06: rows with a new key join; the first of equal keys in a fixed order counts."""
    rest = [c for c in incoming.columns if c not in key]
    one = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest]) if rest else incoming.distinct()
    return current.unionByName(one.join(current.select(*key), key, "left_anti").select(*current.columns))


def companies(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """ext_id, name: by id, those without id by exact name; the first name wins and is never updated (MUT-04). incoming also has ord."""
    with_id = incoming.filter("ext_id IS NOT NULL").groupBy("ext_id").agg(F.min_by("name", "ord").alias("name"))
    fresh = with_id.join(current.select("ext_id"), "ext_id", "left_anti").select("ext_id", "name")
    nameless = incoming.filter("ext_id IS NULL AND name IS NOT NULL").select("name").distinct()
    fresh_names = nameless.join(current.filter("ext_id IS NULL").select("name"), "name", "left_anti").select(F.lit(None).cast("bigint").alias("ext_id"), "name")
    return current.select("ext_id", "name").unionByName(fresh).unionByName(fresh_names)


def resolve(facts: DataFrame, dimension: DataFrame, fk: str, ext: str, dim_id: str, dim_ext: str) -> DataFrame:
    """facts with null keys filled where the dimension now has the external id (MUT-07, JOI-16).

    An external id can be that of a tenth of the facts, so the join is broadcast or salted."""
    d = dimension.select(F.col(dim_ext).alias("_x"), F.col(dim_id).alias("_i"))
    joined = sized_join(facts.withColumn("_x", F.col(ext)), d, ["_x"], "left")
    return joined.withColumn(fk, F.coalesce(F.col(fk), F.col("_i"))).select(*facts.columns)


@dataclass(frozen=True)
class Relation:
    """A key of some facts that an external id names: fk is filled from the dimension (MUT-07)."""

    name: str
    facts: DataFrame
    dimension: DataFrame
    fk: str
    ext: str
    dim_id: str
    dim_ext: str
    placeholders: tuple[int, ...] = ()
    edited: Column | None = None


def reconcile_all(relations: list[Relation], written: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """All relations repaired and then resolved, in the given order; the facts by name, and the counts of each relation.

    written: by relation the external ids that the run wrote; then only facts that name one of them are looked at, the
    others stay as they are. Relations of one name are applied one after the other to the same facts."""
    done: dict[str, DataFrame] = {}
    counts = None
    for r in relations:
        facts = before = done.get(r.name, r.facts)
        rest = ids = None
        if written is not None and r.name in written:
            ids = written[r.name].select(F.col(written[r.name].columns[0]).alias(r.ext)).distinct()
            rest = sized_join(facts, ids, [r.ext], "left_anti").select(*r.facts.columns)
            facts = sized_join(facts, ids, [r.ext], "left_semi").select(*r.facts.columns)
        now = resolve(repair(facts, r.dimension, r.fk, r.ext, r.dim_id, r.dim_ext, r.edited), r.dimension, r.fk, r.ext, r.dim_id, r.dim_ext)
        done[r.name] = now if rest is None else now.unionByName(rest)
        one = _resolved_counts(before, r, ids).select(F.lit(r.name).alias("relation"), F.lit(r.fk).alias("fk"), "*")
        counts = one if counts is None else counts.unionByName(one)
    return done, counts


def _resolved_counts(facts: DataFrame, r: Relation, ids: DataFrame | None) -> DataFrame:
    """reference_counts of the facts once repaired and resolved.

    Facts are summed up by their keys before the joins, so that no key is hot: nothing is salted, and nothing is broadcast
    through the driver."""
    keys = facts.groupBy(r.fk, r.ext, (r.edited if r.edited is not None else F.lit(False)).alias("_edited")).agg(F.count("*").alias("_n"))
    looked_at = keys if ids is None else keys.join(ids.hint("merge"), r.ext, "left_semi")
    repaired = repair(looked_at, r.dimension.hint("merge"), r.fk, r.ext, r.dim_id, r.dim_ext, F.col("_edited"))
    d = r.dimension.select(F.col(r.dim_ext).alias("_x"), F.col(r.dim_id).alias("_i"))
    now = repaired.join(d.hint("merge"), F.col(r.ext) == F.col("_x"), "left").withColumn(r.fk, F.coalesce(F.col(r.fk), F.col("_i"))).select(*keys.columns)
    if ids is not None:
        now = now.unionByName(keys.join(ids.hint("merge"), r.ext, "left_anti").select(*keys.columns))
    return reference_counts(now, r.fk, r.ext, r.placeholders, F.col("_n"))


def repair(facts: DataFrame, dimension: DataFrame, fk: str, ext: str, dim_id: str, dim_ext: str, edited: Column | None = None) -> DataFrame:
    """facts with keys cleared that disagree with their external id (MUT-08)."""
    d = dimension.select(F.col(dim_id).alias("_i"), F.col(dim_ext).alias("_x"))
    stale = F.col(ext).isNotNull() & F.col("_i").isNotNull() & ~F.col("_x").eqNullSafe(F.col(ext)) & ~(edited if edited is not None else F.lit(False))
    return facts.join(d, F.col(fk) == F.col("_i"), "left").withColumn(fk, F.when(~F.coalesce(stale, F.lit(False)), F.col(fk))).drop("_i", "_x")


def reference_counts(facts: DataFrame, fk: str, ext: str, placeholders: tuple[int, ...] = (), n: Column | None = None) -> DataFrame:
    """resolved, unresolved, placeholder, none in one pass (AGG-19). n: facts that a row stands for."""
    e, k = F.col(ext), F.col(fk)
    special = e.isin(*placeholders) if placeholders else F.lit(False)
    total = F.count_if if n is None else lambda of: F.coalesce(F.sum(F.when(of, n)), F.lit(0))
    return facts.agg(
        total(k.isNotNull()).alias("resolved"),
        total(k.isNull() & e.isNotNull() & ~special).alias("unresolved"),
        total(k.isNull() & e.isNotNull() & special).alias("placeholder"),
        total(k.isNull() & e.isNull()).alias("none"),
    )


def undo(current: DataFrame, changes: DataFrame, used: list[DataFrame], key: str) -> DataFrame:
    """Takes a batch back (MUT-14). changes: key, kind (created, updated), previous (struct of the row), last change of a key only.

    Created rows go unless some used table holds their key; updated rows get their former values."""
    created = changes.filter("kind = 'created'").select(key)
    for u in used:
        created = created.join(u.select(key).distinct(), key, "left_anti")
    restored = changes.filter("kind = 'updated'").select("previous.*").select(*current.columns)
    return current.join(created, key, "left_anti").join(restored.select(key), key, "left_anti").select(*current.columns).unionByName(restored)


def newest_of_source(batches: DataFrame, batch: str, source: str, at: str) -> DataFrame:
    """batch, stale: true if the source has a later batch (MUT-17)."""
    last = batches.groupBy(source).agg(F.max(at).alias("_m"))
    return batches.join(last, source).select(batch, (F.col(at) < F.col("_m")).alias("stale"))


def ingest(current: DataFrame, records: DataFrame, key: str, hash_column: str, order: str, edited: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The next version and the counts by action; of several records of a key the last counts, the others are unchanged."""
    one = last_wins(records, [key], [order])
    done = classify(current, one, key, hash_column, edited)
    repeated = records.groupBy(key).agg((F.count("*") - 1).alias("n")).select(F.lit("unchanged").alias("action"), "n")
    tally = done.groupBy("action").agg(F.count("*").alias("n")).unionByName(repeated).groupBy("action").agg(F.sum("n").alias("n")).filter("n > 0")
    return apply(current, done, key), tally


def apply_rows(current: DataFrame, rows: DataFrame, key: str, values: list[str], edited: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of a committed batch written by their action, and the commit's counters (MUT-15, QRY-25).

    current: key, the values, last_seen; rows: key, action (seen, update, create, skip, invalid), the values; one row a key.
    ``seen`` and ``update`` renew last_seen; an update leaves the values of edited holdings as they are; the rest changes
    nothing. Counters: created, updated, unchanged, skipped, invalid, kept_user_edits."""
    mine = rows.filter(F.col("action").isin("seen", "update")).select(key, F.col("action").alias("_a"), *[F.col(v).alias(f"_n_{v}") for v in values])
    joined = current.join(mine, key, "left").withColumn("_e", F.coalesce(edited, F.lit(False)))
    write = (F.col("_a") == "update") & ~F.col("_e")
    kept = joined.select(key, *[F.when(write, F.col(f"_n_{v}")).otherwise(F.col(v)).alias(v) for v in values], F.when(F.col("_a").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"))
    created = rows.filter("action = 'create'").join(current.select(key), key, "left_anti").select(key, *values, now.alias("last_seen"))
    known = rows.join(current.select(key, F.coalesce(edited, F.lit(False)).alias("_e")), key, "left")
    is_ = lambda a: F.col("action") == a
    tally = known.agg(
        F.count_if(is_("create") & F.col("_e").isNull()).alias("created"),
        F.count_if(is_("update") & ~F.col("_e")).alias("updated"),
        F.count_if(is_("seen") & F.col("_e").isNotNull()).alias("unchanged"),
        F.count_if(is_("skip")).alias("skipped"),
        F.count_if(is_("invalid")).alias("invalid"),
        F.count_if(is_("update") & F.col("_e")).alias("kept_user_edits"),
    )
    return kept.unionByName(created), tally


def guarded(current: DataFrame, requests: DataFrame, key: str, expected: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set (MUT-09). requests: key, request (their order) and what ``expected`` compares with the row.

    Of the requests that find the row as expected the first one wins; it makes the changes. Returns the next table and
    request, won."""
    tried = requests.join(current, key, "left").select(key, "request", F.coalesce(expected, F.lit(False)).alias("ok"))
    winner = tried.filter("ok").groupBy(key).agg(F.min("request").alias("_w"))
    judged = tried.join(winner, key, "left").select("request", F.coalesce(F.col("request") == F.col("_w"), F.lit(False)).alias("won"))
    following = current.join(winner.select(key, F.lit(True).alias("_hit")), key, "left")
    for name, value in changes.items():
        following = following.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
    return following.drop("_hit"), judged


def soft_deleted(current: DataFrame, gone: DataFrame, key: str, now: Column, column: str = "deleted_at") -> DataFrame:
    """The rows marked as deleted now, those already marked as they are (MUT-19)."""
    hit = current.join(gone.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.withColumn(column, F.when(F.col("_hit") & F.col(column).isNull(), now).otherwise(F.col(column))).drop("_hit")


def link_all(links: DataFrame, items: DataFrame, value: Column, key: list[str], name: str) -> DataFrame:
    """Links with one value added to all items that lack it (MUT-18)."""
    wanted = items.select(*key, value.alias(name)).distinct()
    return insert_missing(links, wanted, [*key, name])


def unlink_all(links: DataFrame, items: DataFrame, key: list[str], name: str, value: str) -> DataFrame:
    """Links without one value of the given items."""
    gone = items.select(*key, F.lit(value).alias(name)).distinct()
    return links.join(gone, [*key, name], "left_anti")
