"""Sort keys (SRT-01..06, 09): null places, ASCII case folding, ranks, tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramoflow.functions.text import ascii_fold


def nulls_last(c: Column, descending: bool = False) -> Column:
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def folded(c: Column, descending: bool = False) -> Column:
    key = ascii_fold(c)
    return key.desc_nulls_last() if descending else key.asc_nulls_first()


def true_first(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).desc()


def ranked(c: Column, order: list[str], other: int = 99) -> Column:
    """Place of the value in a list."""
    places = F.array_position(F.array(*[F.lit(v) for v in order]), c)
    return F.when(places > 0, places - 1).otherwise(F.lit(other))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page, counted from 1 (SRT-07)."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, after: int, limit: int = 50, most: int = 200) -> DataFrame:
    """Rows whose key is greater, in its order (SRT-08, PRJ-07)."""
    return df.filter(F.col(key) > max(0, after)).orderBy(key).limit(max(1, min(most, limit)))
