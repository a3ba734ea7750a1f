"""Browse, facets, groups, ordered positions, comparison and hierarchy (JOI, AGG, WIN, SET, QRY families)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramoflow.functions.text import ascii_fold


def with_terms(items: DataFrame, terms: DataFrame, key: str, wanted: list[str], every: bool) -> DataFrame:
    """items that have any, or all, of the wanted terms (terms: key, term): a semi join on pre-aggregated keys (JOI-03, JOI-10)."""
    hits = terms.filter(F.col("term").isin(*wanted)).select(key, "term").distinct()
    if every:
        hits = hits.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(set(wanted)))
    return items.join(hits.select(key), key, "left_semi")


def union_distinct(*parts: DataFrame) -> DataFrame:
    """SET-02, SET-03."""
    return reduce(DataFrame.unionByName, parts).distinct()


def contains_tokens(query: str, *columns: Column, most: int = 8) -> Column:
    """Each of the first tokens occurs in some column, without regard to ASCII case (FLT-04)."""
    tokens = [t for t in query.split() if t][:most]
    fold = [ascii_fold(F.coalesce(c, F.lit(""))) for c in columns]
    folded = ["".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t) for t in tokens]
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [c.contains(t) for c in fold]) for t in folded], F.lit(True))


def group_counts(df: DataFrame, key: Column, none: str = "(none)") -> DataFrame:
    """key, n with a bucket for null (AGG-09)."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit(none)).alias("key")).agg(F.count("*").alias("n"))


def split_counts(df: DataFrame, column: Column, separator: str, none: str = "(none)") -> DataFrame:
    """key, n over the parts of a delimited column (AGG-08)."""
    parts = F.explode(F.coalesce(F.split(F.nullif(column, F.lit("")), separator), F.array(F.lit(none))))
    return df.select(parts.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def list_member(column: Column, separator: str, value: str) -> Column:
    """The delimited column holds the value, without regard to ASCII case (FLT-06)."""
    folded = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in value)
    return F.array_contains(F.split(ascii_fold(F.coalesce(column, F.lit(""))), separator), folded)


def in_group(column: Column, value: str, none: str = "(none)") -> Column:
    """Rows of a group that ``group_counts`` names: the null bucket by its name (FLT-07)."""
    return column.isNull() if value == none else F.coalesce(column == F.lit(value), F.lit(False))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every value that is given; None and empty text ask for nothing (FLT-08)."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    return df


def same_text(a: Column, b: Column) -> Column:
    """Equal without regard to ASCII case (FLT-11)."""
    return ascii_fold(a) == ascii_fold(b)


def public(df: DataFrame, columns: list[str], private: frozenset[str] = frozenset()) -> DataFrame:
    """The named columns only; a private one among them is an error (PRJ-05)."""
    if shown := sorted(private.intersection(columns)):
        raise ValueError(f"private columns asked for: {', '.join(shown)}")
    return df.select(*columns)


def capped_candidates(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, bool]:
    """The first rows and whether there may be more (SRT-10): one row more than asked for is looked at."""
    first = df.orderBy(*order).limit(most)
    return first, df.limit(most + 1).count() > most


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group as a map-side combined minimum, without a sort (JOI-09, WIN-04)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in order + rest])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key (WIN-05)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in order + rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows with ``duplicate`` set on those after the first of a key (WIN-06)."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based places in each group (WIN-01, WIN-02)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def move(df: DataFrame, group: list[str], is_moved: Column, target: Column | int, name: str = "position") -> DataFrame:
    """Each group with one item moved to a place and the others closed up (WIN-03). The place is clamped to the group."""
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    old = F.max(F.when(is_moved, F.col(name))).over(w)
    to = F.greatest(F.lit(1), F.least(n, target if isinstance(target, Column) else F.lit(target)))
    at = F.col(name)
    shifted = F.when(is_moved, to).when(old.isNull(), at).when((at > old) & (at <= to), at - 1).when((at < old) & (at >= to), at + 1).otherwise(at)
    return df.withColumn("_new", shifted.cast("bigint")).drop(name).withColumnRenamed("_new", name)


def append_positions(old: DataFrame, new: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """New items placed behind the last one of their group (AGG-20)."""
    last = old.groupBy(*group).agg(F.max(name).alias("_last"))
    placed = new.join(last, group, "left").withColumn(name, F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.drop("_last")


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their place, and whether the group is complete (WIN-07)."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("position", F.row_number().over(w.orderBy(*order)).cast("bigint")).filter(F.col("position") <= n)
    return ranked.withColumn("complete", F.count("*").over(w) == n)


def compare(records: DataFrame, key: str, fields: list[str], blank: str = "—") -> DataFrame:
    """field, vals by key order, differs (QRY-04)."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit(blank)).alias("v")) for f in fields]))
    rows = records.select(key, cells.alias("c")).groupBy("c.field").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("c.v")))), lambda s: s["v"]).alias("vals"))
    return rows.select("field", "vals", (F.size(F.array_distinct("vals")) > 1).alias("differs"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, before, after of fields that differ; null and empty are the same (SCL-28)."""
    both = old.select(key, *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields]).join(new.select(key, *[F.col(f).cast("string").alias(f"_n_{f}") for f in fields]), key)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("before"), F.col(f"_n_{f}").alias("after")) for f in fields]))
    return both.select(key, cells.alias("c")).select(key, "c.*").filter(F.coalesce("before", F.lit("")) != F.coalesce("after", F.lit("")))


def paths(nodes: DataFrame, key: str, parent: str, name: str, separator: str = " / ", deepest: int = 32) -> DataFrame:
    """key, path, depth from the roots down, one join a level; cycles are never reached from a root (JOI-07, QRY-26).

    Nodes below the deepest level are an error."""
    level = nodes.filter(F.col(parent).isNull()).select(key, F.col(name).alias("path"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, deepest + 1):
        above = level.select(F.col(key).alias(parent), F.col("path").alias("_p"))
        level = nodes.join(above, parent).select(key, F.concat("_p", F.lit(separator), name).alias("path"), F.lit(d).alias("depth"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    below = nodes.join(level.select(F.col(key).alias(parent)), parent)
    if not below.isEmpty():
        raise ValueError(f"the tree has more than {deepest} levels below its roots")
    return out


def credit_text(credits: DataFrame, owner: list[str], none: str = "Unknown artist") -> DataFrame:
    """owner, credit: the names as credited, in order, with their joins (AGG-06, PRJ-06)."""
    from gramoflow.functions.parsing import join_text

    shown = F.coalesce(F.nullif(F.trim("anv"), F.lit("")), F.col("name"), F.lit(none))
    return credits.groupBy(*owner).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s"), join_text(F.col("join_text")).alias("j")))).alias("x")).select(
        *owner,
        F.concat_ws("", F.transform("x", lambda c, i: F.concat(c["s"], F.when(i < F.size("x") - 1, c["j"]).otherwise("")))).alias("credit"),
    )


def related(wanted: DataFrame, items: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """key, other, reason: for each wanted item the items of the same first key, or without one of the same second key (QRY-14)."""
    out = None
    for part, others, k in ((wanted, items, first), (wanted.filter(F.col(first).isNull()), items.filter(F.col(first).isNull()), second)):
        a, b = part.select(F.col(key), F.col(k).alias("_k")), others.select(F.col(key).alias("other"), F.col(k).alias("_k"))
        one = a.join(b, "_k").filter(F.col(key) != F.col("other")).select(key, "other", F.lit(k).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def like_any(pattern: str, *columns: Column) -> Column:
    """The pattern with its wildcards occurs in some column, without regard to ASCII case (FLT-05)."""
    folded = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in pattern)
    return reduce(lambda a, b: a | b, [ascii_fold(F.coalesce(c, F.lit(""))).like(f"%{folded}%") for c in columns])


def either_join(left: DataFrame, right: DataFrame, exact: tuple[str, str], loose: tuple[str, str]) -> DataFrame:
    """Rows of left with the right rows of their exact key, or without one of their loose key: two equi joins (FLT-12)."""
    has = F.col(exact[0]).isNotNull()
    a = left.filter(has).join(right, F.col(exact[0]) == F.col(exact[1]))
    b = left.filter(~has).join(right, F.col(loose[0]) == F.col(loose[1]))
    return a.unionByName(b)


def either_summary(left: DataFrame, right: DataFrame, exact: tuple[str, str], loose: tuple[str, str], group: str, value: str, count: str, least: str) -> DataFrame:
    """group, the number of its pairs under either_join and the least value on their right side (QRY-18).

    The right rows are summed up by key before the join: a loose key of many rows on both sides would make a pair of each two."""
    has = F.col(exact[0]).isNotNull()

    def joined(rows: DataFrame, keys: tuple[str, str]) -> DataFrame:
        sums = right.groupBy(F.col(keys[1]).alias("_k")).agg(F.count("*").alias("_n"), F.min(value).alias("_least"))
        return rows.select(group, F.col(keys[0]).alias("_k")).join(sums, "_k").drop("_k")

    both = joined(left.filter(has), exact).unionByName(joined(left.filter(~has), loose))
    return both.groupBy(group).agg(F.sum("_n").alias(count), F.min("_least").alias(least))


def sort_terms(column: str, descending: bool, ties: list[str]) -> list[Column]:
    """Unknown values last in both directions, then the column, then ties ascending (SRT-06)."""
    c = F.col(column)
    return [c.isNull().asc(), c.desc() if descending else c.asc(), *[F.col(t).asc() for t in ties]]


def first_seen_groups(df: DataFrame, group: str, order: list[str], **aggregates: Column) -> DataFrame:
    """One row a group in the order in which groups first appear, with their place (AGG-17).

    The places are those of a sorted list of groups; the sort is by range, over one row a group."""
    g = df.groupBy(group).agg(F.min(F.struct(*order)).alias("_first"), *[c.alias(n) for n, c in aggregates.items()])
    return g.orderBy("_first").drop("_first")


def largest_plus_rest(df: DataFrame, group: list[str], first: str, rest: str, order: str) -> DataFrame:
    """group, total: the largest ``first`` of a group and the ``rest`` of all its other rows; of equal ones the earliest counts (AGG-16)."""
    best = F.max_by(F.col(rest), F.struct(F.col(first), -F.col(order)))
    return df.groupBy(*group).agg((F.max(first) + F.sum(rest) - best).alias("total"))


def owned_only(wanted: DataFrame, owned: DataFrame, key: list[str], order: str) -> DataFrame:
    """Wanted references that are owned, each once, with the place where it first stood (SET-06)."""
    once = wanted.groupBy(*key).agg(F.min(order).alias(order))
    return once.join(owned.select(*key).distinct(), key, "left_semi")


def union_last(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which the later part's row of a key replaces the earlier one's (SET-04)."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    return last_wins(reduce(DataFrame.unionByName, numbered), key, ["_part"]).drop("_part")


def compare_sequences(items: DataFrame, record: str, position: str, value: str, blank: str = "—") -> DataFrame:
    """position, vals by record order, differs: lists of several records side by side, full outer by position (QRY-04).

    For a handful of records: more than 100 are refused."""
    records = sorted(r[0] for r in items.select(record).distinct().limit(101).collect())
    if len(records) > 100:
        raise ValueError("more than 100 records to compare")
    kind = items.schema[record].dataType
    every = items.select(position).distinct().withColumn("_r", F.array(*[F.lit(r).cast(kind) for r in records]))
    cells = every.select(position, F.posexplode("_r").alias("_n", record)).join(items.select(position, record, F.col(value).alias("_v")), [position, record], "left")
    rows = cells.groupBy(position).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("_v", F.lit(blank)).alias("v")))), lambda s: s["v"]).alias("vals"))
    return rows.select(position, "vals", (F.size(F.array_distinct("vals")) > 1).alias("differs"))


def suggestions(items: DataFrame, wanted: DataFrame, key: str, most: int = 8) -> DataFrame:
    """wanted: wanted_id, code, title; items: key, code, title -> the first few items of the same code or folded title (QRY-29)."""
    i = items.select(F.col(key), F.col("code").alias("_c"), ascii_fold(F.col("title")).alias("_t"))
    by_code = wanted.join(i, F.col("code") == F.col("_c")).select("wanted_id", key)
    by_title = wanted.join(i, ascii_fold(F.col("title")) == F.col("_t")).select("wanted_id", key)
    return top_n(by_code.unionByName(by_title).distinct(), ["wanted_id"], [F.col(key)], most).drop("complete")
