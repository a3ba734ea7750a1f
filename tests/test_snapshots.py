import random

import numpy as np
from pyspark.sql import functions as F

from gramoflow.operators import scale
from gramoflow.operators import snapshots as sn


def test_hash_equals_sparks(spark):
    rows = [(random.randrange(-(2**62), 2**62), i, -i) for i in range(50)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").select("*", F.xxhash64("a", "b", "c").alias("h")).collect()
    mine = sn._hash_longs(*[np.array([r[i] for r in df]) for i in range(3)])
    assert mine.tolist() == [r.h for r in df]


def _brute(rows):
    groups = {}
    for lib, day, _, key, h in set(rows):
        if key is not None and day is not None:
            groups.setdefault(lib, {}).setdefault(day, {}).setdefault(key, []).append(h)
    out = set()
    for lib, days in groups.items():
        order = sorted(days)
        for old, new in zip(order, order[1:], strict=False):
            a, b = days[old], days[new]
            for k in a.keys() | b.keys():
                x, y = sorted(map(str, a.get(k, []))), sorted(map(str, b.get(k, [])))
                if x != y:
                    out.add((lib, k, new, "added" if k not in a else "removed" if k not in b else "changed"))
    return out


def _rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for lib in (1, 2, 3):
        for day in ("a", "b", "c") if lib != 2 else ("a", "c"):
            for i in range(n):
                if rnd.random() < 0.9:
                    rows.append((lib, day, i, f"k{i % (n - 3)}", f"h{i}" if rnd.random() < 0.8 else rnd.choice("xy")))
    return rows + rows[: n // 5] + [(1, "b", 1, None, "h"), (1, None, 1, "k1", "h")]


def test_row_changes_equal_brute_force(spark):
    rows = _rows(40, 3)
    df = spark.createDataFrame(rows, "lib bigint, day string, rn int, key string, h string")
    for sizes in ({}, {"subtable": 4, "expected_share": 0.02}):  # the second has failing buckets that are enlarged
        got = {(r.lib, r.rec_key, r.snapshot, r.change) for r in sn.row_changes(df, ["lib"], "day", "key", "rn", "h", **sizes).collect()}
        assert got == _brute(rows)


def test_record_content_ignores_order_and_kinds_of_nothing(spark):
    schema = "day string, id bigint, name string, urls struct<u:array<string>>, al struct<n:array<struct<v:string,i:bigint>>>, kh string"
    rows = [
        ("1", 1, None, None, ([("a", 1), ("b", None)],), "x"), ("2", 1, "", ([],), ([("b", None), ("a", 1)],), "x"), ("2", 1, "", ([],), ([("b", None), ("a", 1)],), "x"),
        ("1", 2, "n", (["p", "q"],), None, None), ("2", 2, "n", (["q", "p"],), ([],), ""),
        ("1", 3, "n", None, None, None), ("2", 4, "n", None, None, None),
        ("1", 5, "n", (["p"],), None, None), ("2", 5, "n", (["p", "p"],), None, None),
    ]
    got = {(r.rec_key, r.change) for r in sn.record_changes(spark.createDataFrame(rows, schema), "day", "id", []).collect()}
    assert got == {("3", "removed"), ("4", "added"), ("5", "changed")}


def test_empty_and_single_copy(spark):
    df = spark.createDataFrame(_rows(10, 1), "lib bigint, day string, rn int, key string, h string")
    assert sn.row_changes(df.limit(0), ["lib"], "day", "key", "rn", "h").count() == 0
    assert sn.row_changes(df.filter("day = 'a'"), ["lib"], "day", "key", "rn", "h").count() == 0


def test_damaged_digest_fails_the_bucket():
    import pandas as pd

    kh, pair, ch = np.array([5, 6]), np.array([2, 2]), np.array([7, 8])
    h = sn._hash_longs(kh, pair, ch)
    rows = []
    for i in range(2):
        for j in range(3):
            rows.append((int(sn._hash_longs(h[i : i + 1], j)[0] % 64 + j * 64), 1, kh[i], pair[i], ch[i], h[i], 0))
    rows.append((-1, 2, 0, 0, 0, 0, int((h & 0xFFFFFFFF).sum())))
    cells = pd.DataFrame(rows, columns=["cell", "n", "kh", "pair", "ch", "h", "digest"]).groupby("cell", as_index=False).agg({"n": "sum", "kh": lambda x: np.bitwise_xor.reduce(x.to_numpy()), "pair": lambda x: np.bitwise_xor.reduce(x.to_numpy()), "ch": lambda x: np.bitwise_xor.reduce(x.to_numpy()), "h": lambda x: np.bitwise_xor.reduce(x.to_numpy()), "digest": "sum"})
    out, whole = sn.peel(cells, 64)
    assert whole and len(out) == 2
    cells.loc[cells["cell"] == -1, "digest"] += 1
    assert not sn.peel(cells, 64)[1]


def test_changes_beyond_the_drivers_share_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(1200).select(F.concat(F.lit("d"), F.col("id") % 3).alias("day"), F.floor(F.col("id") / 3).alias("k"), (F.col("id") % 7).alias("v"))
    plain = sorted(map(str, sn.record_changes(rows, "day", "k", []).collect()))
    monkeypatch.setattr(scale, "HEAP_SHARE", 1 << 40, raising=False)
    out = sn.record_changes(rows, "day", "k", [])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert plain and sorted(map(str, out.collect())) == plain
