"""Constraints as assertions and structure profiles (section 1.4, AGG-13, AGG-18, QRY-27)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """rule, n of the rules that some rows break, in one pass; a null outcome is no violation."""
    counts = df.agg(*[F.count_if(~F.coalesce(r, F.lit(True))).alias(n) for n, r in rules.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules]))
    return counts.select(rows.alias("x")).select("x.*").filter("n > 0")


def repeated_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys held more than once; rows with a null key part do not count (partial unique)."""
    rows = df if where is None else df.filter(where)
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def exactly_one(*columns: Column) -> Column:
    return sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0)) == 1


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def profile(paths: DataFrame, record: str, path: str, value: str, order: str) -> DataFrame:
    """path, records, occurrences, empty, longest, sample (first in order) of exploded structure rows."""
    return paths.groupBy(path).agg(
        F.count_distinct(record).alias("records"),
        F.count("*").alias("occurrences"),
        F.count_if(F.coalesce(F.trim(value), F.lit("")) == "").alias("empty"),
        F.max(F.length(F.coalesce(value, F.lit("")))).alias("longest"),
        F.min_by(value, order).alias("sample"),
    )


def census(profiled: DataFrame, path: str, imported: list[str], ignored: list[str]) -> DataFrame:
    """The profile with its coverage: imported, ignored or unknown."""
    return profiled.withColumn("coverage", F.when(F.col(path).isin(*imported), "imported").when(F.col(path).isin(*ignored), "ignored").otherwise("unknown"))


def xml_paths(files: DataFrame, content: str, record_tag: str) -> DataFrame:
    """path, content -> record, path, value: element and attribute paths of each record of XML documents.

    Each document is read as a stream inside its task; only records' paths leave it."""
    import xml.etree.ElementTree as ET
    from io import BytesIO

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[tuple[str, str, str]] = []
                open_tags: list[str] = []
                no = -1
                for event, el in ET.iterparse(BytesIO(body), events=("start", "end")):
                    if event == "start":
                        open_tags.append(el.tag)
                        if len(open_tags) == 2 and el.tag == record_tag:
                            no += 1
                        continue
                    if len(open_tags) >= 2 and open_tags[1] == record_tag:
                        at = "/".join(open_tags[1:])
                        rows.append((f"{name}#{no}", at, (el.text or "").strip()))
                        rows.extend((f"{name}#{no}", f"{at}/@{k}", v) for k, v in el.attrib.items())
                    if len(open_tags) == 2:
                        el.clear()
                    open_tags.pop()
                    if len(rows) > 50_000:
                        yield pd.DataFrame(rows, columns=["record", "path", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["record", "path", "value"])

    return files.select("path", F.col(content).alias("content")).mapInPandas(run, "record string, path string, value string")
