"""What changed between full copies: invertible Bloom lookup tables, subtracted per hash bucket and peeled.

Every copy is a set of (key hash, content hash) elements. For each pair of consecutive copies, the elements of the
newer one are added to and those of the older one taken from small tables of cells, one table for each hash bucket;
equal elements cancel, so a table holds the difference only. The cells are sums and exclusive ors, which combine
before the shuffle. A bucket whose difference fits its table is peeled completely; a bucket that fails is built anew
with a larger table, the others stay. A digest of each bucket's elements, kept beside the cells, must equal that of
what was peeled. Keys found only in the newer copy are added, only in the older one removed, in both changed.

The element arithmetic is done by Spark's xxhash64, of which ``_hash_longs`` is the numpy form used for peeling.

Cases: a row delivered twice counts once; a group's first copy yields nothing; rows without key or copy date belong to
no copy and are left out; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramoflow.operators.scale import heap_share, sized_join, stage

#: Cells of each of a bucket's three sub-tables at first.
SUBTABLE = 1024
#: Share of the compared elements that may differ before buckets have to be enlarged.
EXPECTED_SHARE = 0.25
#: Differences a bucket of 3 * SUBTABLE cells is meant to hold: three-hash peeling succeeds below 0.81 of the cells.
LOAD = 0.6
GROWTH = 4

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _hash_longs(*columns) -> np.ndarray:
    """xxhash64 of long columns as Spark computes it (seed 42, each value's hash seeds the next)."""
    seed = np.uint64(42)
    with np.errstate(over="ignore"):
        for c in columns:
            v = np.asarray(c, np.int64).view(np.uint64) if not np.isscalar(c) else np.uint64(np.int64(c).view(np.uint64))
            h = seed + _P5 + np.uint64(8)
            h = h ^ (_rotl(v * _P2, 31) * _P1)
            h = _rotl(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            seed = h ^ (h >> np.uint64(32))
    return np.asarray(seed).view(np.int64)


def content_of_rows(rows: DataFrame, group: list[str], copy: str, key: str, row_id: str, content: str) -> DataFrame:
    """grp, copy, kh, ch for a table in which a key may have several rows: the content is the multiset of theirs."""
    one = rows.filter(F.col(key).isNotNull() & F.col(copy).isNotNull()).select(
        F.xxhash64(*group).alias("grp"), F.col(copy).alias("copy"), F.xxhash64(*group, key).alias("kh"), F.col(row_id).cast("long").alias("rn"), F.xxhash64(F.coalesce(F.col(content), F.lit(""))).alias("c")
    ).distinct()
    low, high = F.col("c").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("c", 32)
    bag = one.groupBy("grp", "copy", "kh").agg(F.sum(low).alias("a"), F.sum(high).alias("b"), F.count("*").alias("n"))
    return bag.select("grp", "copy", "kh", F.xxhash64("a", "b", "n").alias("ch"))


def content_of_records(rows: DataFrame, copy: str, key: str, ignore: list[str]) -> DataFrame:
    """grp, copy, kh, ch for a table with one record a key: all other columns, without regard to list order and kinds of nothing."""
    named = [f for f in rows.schema.fields if f.name not in (copy, key, *ignore)]
    content = F.xxhash64(*[_canonical(F.col(f"`{f.name}`"), f.dataType) for f in sorted(named, key=lambda f: f.name)])
    keyed = rows.filter(F.col(key).isNotNull() & F.col(copy).isNotNull()).select(F.lit(0).cast("long").alias("grp"), F.col(copy).alias("copy"), F.xxhash64(F.col(key)).alias("kh"), content.alias("ch"))
    return keyed.distinct()


def _canonical(c: Column, kind: T.DataType) -> Column:
    """A text form in which null, empty text, empty list and a struct of nothing are all the empty text and lists are sorted."""
    if isinstance(kind, T.ArrayType):
        parts = F.array_sort(F.transform(c, lambda x: _canonical(x, kind.elementType)))
        return F.coalesce(F.concat_ws("\u0002", parts), F.lit(""))
    if isinstance(kind, T.StructType):
        parts = [_canonical(c.getField(f.name), f.dataType) for f in kind.fields]
        text = F.concat_ws("\u0001", *parts) if len(parts) > 1 else parts[0]
        return F.when(F.forall(F.array(*parts), lambda x: x == ""), "").otherwise(text)
    if isinstance(kind, T.MapType):
        return _canonical(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return F.coalesce(c.cast("string"), F.lit(""))


def copies(elements: DataFrame) -> DataFrame:
    """grp, copy, ord: the copies a group has, numbered in time."""
    w = Window.partitionBy("grp").orderBy("copy")
    seen = elements.select("grp", "copy").distinct()
    return seen.select("grp", "copy", F.row_number().over(w).cast("long").alias("ord"), F.lead("copy").over(w).isNotNull().alias("has_next"))


def _contributions(elements: DataFrame, order: DataFrame) -> DataFrame:
    """kh, pair, ch, sign: an element adds to the pair its copy ends and takes from the pair its copy begins.

    A pair is named by the number of its newer copy."""
    e = sized_join(elements, order, ["grp", "copy"], size=heap_share(elements.sparkSession))
    sides = F.array_compact(
        F.array(
            F.when(F.col("ord") > 1, F.struct(F.col("ord").alias("pair"), F.lit(1).alias("sign"))),
            F.when(F.col("has_next"), F.struct((F.col("ord") + 1).alias("pair"), F.lit(-1).alias("sign"))),
        )
    )
    return e.select("kh", "ch", F.explode(sides).alias("s")).select("kh", F.col("s.pair").alias("pair"), "ch", F.col("s.sign").alias("sign"))


def _cells(contrib: DataFrame, size: int) -> DataFrame:
    """Cells of each bucket's table; cell -1 holds the bucket's digest."""
    h = F.xxhash64("kh", "pair", "ch")
    slots = [F.pmod(F.xxhash64(F.col("h"), F.lit(j).cast("long")), F.lit(size)) + j * size for j in range(3)]
    placed = contrib.withColumn("h", h).select("bucket", "kh", "pair", "ch", "sign", "h", F.explode(F.array(F.lit(-1).cast("long"), *slots)).alias("cell"))
    # The digest is a sum that never overflows: 32 bits of each hash.
    return placed.groupBy("bucket", "cell").agg(
        F.sum("sign").alias("n"),
        F.bit_xor("kh").alias("kh"),
        F.bit_xor("pair").alias("pair"),
        F.bit_xor("ch").alias("ch"),
        F.bit_xor("h").alias("h"),
        F.sum(F.when(F.col("cell") == -1, F.col("sign") * F.col("h").bitwiseAND(0xFFFFFFFF)).otherwise(0)).alias("digest"),
    )


def peel(cells: pd.DataFrame, size: int) -> tuple[np.ndarray, bool]:
    """Differences held by one bucket's table as rows (kh, pair, ch, sign), and whether nothing is left and the digest holds."""
    real = cells[cells["cell"] >= 0]
    n, kh, pair, ch, h = (np.zeros(3 * size, np.int64) for _ in range(5))
    at = real["cell"].to_numpy()
    for into, name in ((n, "n"), (kh, "kh"), (pair, "pair"), (ch, "ch"), (h, "h")):
        into[at] = real[name].to_numpy()
    found: list[np.ndarray] = []
    while True:
        pure = np.flatnonzero(np.abs(n) == 1)
        pure = pure[_hash_longs(kh[pure], pair[pure], ch[pure]) == h[pure]]
        if not len(pure):
            break
        _, first = np.unique(h[pure], return_index=True)
        pure = pure[first]
        got = np.array([kh[pure], pair[pure], ch[pure], n[pure]]).T
        hashes = h[pure].copy()
        found.append(got)
        for j in range(3):
            slot = _hash_longs(hashes, j) % size
            slot = np.where(slot < 0, slot + size, slot) + j * size
            np.subtract.at(n, slot, got[:, 3])
            for into, values in ((kh, got[:, 0]), (pair, got[:, 1]), (ch, got[:, 2]), (h, hashes)):
                np.bitwise_xor.at(into, slot, values)
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    empty = not (n.any() or kh.any() or ch.any() or h.any())
    digest = int((out[:, 3] * (_hash_longs(out[:, 0], out[:, 1], out[:, 2]) & 0xFFFFFFFF)).sum()) if len(out) else 0
    want = int(cells.loc[cells["cell"] == -1, "digest"].sum())
    return out, empty and digest == want


def differences(elements: DataFrame, order: DataFrame, subtable: int = SUBTABLE, expected_share: float = EXPECTED_SHARE) -> DataFrame:
    """kh, pair, change (added, removed, changed) from staged elements grp, copy, kh, ch."""
    spark = elements.sparkSession
    total = elements.count()
    buckets = max(1, math.ceil(total * expected_share / (LOAD * 3 * subtable)))
    contrib = _contributions(elements, order).withColumn("bucket", F.pmod(F.xxhash64("kh", "pair", F.lit(99)), F.lit(buckets)))
    size, parts, todo = subtable, [], contrib
    while True:
        peeled = stage(_peel_all(_cells(todo, size), size), "peeled")
        parts.append(peeled.filter("sign <> 0"))
        failed = peeled.filter("sign = 0").select("bucket")
        if failed.isEmpty():
            break
        if size > 4 * total + subtable:
            raise RuntimeError(f"{failed.count()} buckets do not peel at {size} cells, more than their elements need: hashes collide")
        size *= GROWTH
        todo = sized_join(contrib, failed, ["bucket"], "left_semi", size=heap_share(spark))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if not parts:
        found = spark.createDataFrame([], "kh bigint, pair bigint, ch bigint, sign int, bucket bigint")
    sides = found.groupBy("kh", "pair").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"))
    return sides.select("kh", "pair", F.when(F.col("lo") == 1, "added").when(F.col("hi") == -1, "removed").otherwise("changed").alias("change"))


def _peel_all(cells: DataFrame, size: int) -> DataFrame:
    """Elements of the buckets that peel; one row with sign 0 for each that fails."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, whole = peel(pdf, size)
        bucket = pdf["bucket"].iloc[0]
        if not whole:
            out = np.zeros((1, 4), np.int64)
        return pd.DataFrame({"bucket": np.full(len(out), bucket), "kh": out[:, 0], "pair": out[:, 1], "ch": out[:, 2], "sign": out[:, 3].astype(np.int32)})

    return cells.groupBy("bucket").applyInPandas(run, "bucket bigint, kh bigint, pair bigint, ch bigint, sign int")


def changes(elements: DataFrame, keys: DataFrame, **sizes) -> DataFrame:
    """elements: grp, copy, kh, ch; keys: grp, kh and the readable key columns -> those columns, snapshot, change."""
    elements = stage(elements, "elements")
    order = stage(copies(elements), "copies")
    diff = differences(elements, order, **sizes)
    # The few keys that differ are picked before keys are made distinct, so that the others are not shuffled.
    diff = stage(diff, "differences")
    # What differs is proportional to the input, and several entities are joined at once: no broadcast takes more than its share of the driver.
    share = heap_share(diff.sparkSession)
    named = sized_join(keys, diff.select("kh").distinct(), ["kh"], "left_semi", size=share).distinct().join(diff.hint("merge"), "kh")
    return sized_join(named, order.select("grp", F.col("ord").alias("pair"), F.col("copy").alias("snapshot")), ["grp", "pair"], size=share).drop("grp", "pair", "kh")


def record_changes(rows: DataFrame, copy: str, key: str, ignore: list[str], **sizes) -> DataFrame:
    """rec_key, snapshot, change for a table with one record a key and copy."""
    elements = content_of_records(rows, copy, key, ignore)
    keys = rows.filter(F.col(key).isNotNull()).select(F.lit(0).cast("long").alias("grp"), F.xxhash64(F.col(key)).alias("kh"), F.col(key).cast("string").alias("rec_key"))
    return changes(elements, keys, **sizes)


def row_changes(rows: DataFrame, group: list[str], copy: str, key: str, row_id: str, content: str, **sizes) -> DataFrame:
    """group columns, rec_key, snapshot, change for a table of repeated exports."""
    elements = content_of_rows(rows, group, copy, key, row_id, content)
    keys = rows.filter(F.col(key).isNotNull()).select(F.xxhash64(*group).alias("grp"), F.xxhash64(*group, key).alias("kh"), *group, F.col(key).cast("string").alias("rec_key"))
    return changes(elements, keys, **sizes)
