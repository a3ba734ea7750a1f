"""Checks of files before they are read (SRC-02, 04, 05, 06, 07, 09, 15, 17)."""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of one record.
MOST_TEXT, MOST_NODES = 65_536, 50_000
#: Bytes read at a time.
PIECE = 1 << 20
GZIP = b"\x1f\x8b"
_UNSAFE = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)
_OVERLAP = 16


class FileRefused(ValueError):
    """A file that must not be read."""


def _facts(stream, size: int) -> tuple[int, str, bool, bool, bool]:
    """Bytes, sha256, whether gzipped, whether a document type or entity is declared, whether UTF-8; read piece by piece."""
    digest, text = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
    n, zipped, unsafe, utf8, tail, unzip = 0, False, False, True, b"", None
    while piece := stream.read(size):
        if n == 0 and (zipped := piece[:2] == GZIP):
            unzip = zlib.decompressobj(31)
        n += len(piece)
        digest.update(piece)
        todo = piece
        while todo:
            plain = todo
            if unzip is not None:
                plain, todo = unzip.decompress(todo), b""
                if unzip.eof and unzip.unused_data:  # a further member of the file
                    todo, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                todo = b""
            unsafe = unsafe or bool(_UNSAFE.search(tail + plain))
            tail = (tail + plain)[-_OVERLAP:]
            if utf8:
                try:
                    text.decode(plain)
                except UnicodeDecodeError:
                    utf8 = False
    if utf8:
        try:
            text.decode(b"", final=True)
        except UnicodeDecodeError:
            utf8 = False
    return n, digest.hexdigest(), zipped, unsafe, utf8


def file_facts(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """path, n_bytes, sha256, gzipped (by its first bytes), doctype (declares a document type or entities anywhere), utf8.

    Files of any size are read inside the tasks, a piece at a time; only the facts leave them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for name in pdf["path"]:
                files, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with files.open_input_stream(at, compression=None) as stream:
                    out.append((name, *_facts(stream, piece)))
            yield pd.DataFrame(out, columns=["path", "n_bytes", "sha256", "gzipped", "doctype", "utf8"])

    listed = spark.read.format("binaryFile").load(path).select("path")  # the bytes are not read here
    return listed.mapInPandas(run, "path string, n_bytes bigint, sha256 string, gzipped boolean, doctype boolean, utf8 boolean")


def refuse_unsafe(spark: SparkSession, path: str) -> None:
    """Raises if a file declares a document type or entity, is no UTF-8, or is compressed against its name, by which the
    readers go."""
    by_name = F.lower("path").endswith(".gz")
    bad = file_facts(spark, path).filter(F.col("doctype") | ~F.col("utf8") | (F.col("gzipped") != by_name)).limit(10).collect()
    if bad:
        raise FileRefused("; ".join(f"{r.path}: {'document type or entity' if r.doctype else 'not UTF-8' if not r.utf8 else 'compression and name differ'}" for r in bad))


def node_count(c: Column, kind: T.DataType) -> Column:
    """Elements and attributes that are present in a nested record."""
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(0), lambda n, x: n + node_count(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNull(), 0).otherwise(sum((node_count(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(1)))
    return F.when(c.isNotNull(), 1).otherwise(0)


def longest_text(c: Column, kind: T.DataType) -> Column:
    """Length of the longest text in a nested record."""
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(0), lambda n, x: F.greatest(n, longest_text(x, kind.elementType)))
    if isinstance(kind, T.StructType):
        return F.greatest(F.lit(0), F.lit(0), *[longest_text(c.getField(f.name), f.dataType) for f in kind.fields])
    return F.coalesce(F.length(c), F.lit(0)) if isinstance(kind, T.StringType) else F.lit(0)


def clipped_texts(c: Column, kind: T.DataType, most: int) -> Column:
    """The nested value with every text cut to its first characters."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: clipped_texts(x, kind.elementType, most))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[clipped_texts(c.getField(f.name), f.dataType, most).alias(f.name) for f in kind.fields]))
    return F.substring(c, 1, most) if isinstance(kind, T.StringType) else c


def dump_facts(path: Column) -> Column:
    """struct(kind, day) from names like ``catalog_20250301_artists.xml.gz``."""
    pattern = r"_(\d{8})_(artists|labels|masters|releases)\.xml(?:\.gz)?$"
    day = F.regexp_extract(path, pattern, 1)
    return F.when(day != "", F.struct(F.regexp_extract(path, pattern, 2).alias("kind"), F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date").alias("day")))


def clipped(c: Column, most: int = MOST_TEXT) -> Column:
    """struct(text, cut)."""
    return F.struct(F.substring(c, 1, most).alias("text"), (F.length(c) > most).alias("cut"))


def checksums(text: str) -> dict[str, str]:
    """name -> sha256 from lines ``<64 hex digits>  <name>``."""
    return {m.group(2).strip(): m.group(1).lower() for m in re.finditer(r"^([0-9a-fA-F]{64})[ \t]+\*?(.+)$", text, re.M)}


def verify(facts: DataFrame, known: dict[str, str]) -> DataFrame:
    """path, ok: the facts' hashes against a list of checksums by file name; null where the list has none."""
    spark = facts.sparkSession
    rows = [(k, v) for k, v in known.items()]
    table = spark.createDataFrame(rows, "name string, want string") if rows else spark.createDataFrame([], "name string, want string")
    named = facts.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.join(F.broadcast(table), "name", "left").select("path", (F.col("want") == F.col("sha256")).alias("ok"))  # as many rows as the checksum file has
