"""Ranked full-text search over postings tables (FTS-01..11).

``index`` writes postings (doc, field, term, positions) and lengths once; a query reads only the terms it asks for.
Query terms are a handful of literals, so matching is a filter with pushdown on the postings, one aggregation by
document and no join but the one with the document lengths.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramoflow.functions.text import without_marks

# Weight of each field and the ranking function's constants.
WEIGHTS = {"title": 10.0, "people": 3.0, "codes": 6.0, "extra": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_WORDS = 12
_SYNTAX = '"*^(){}[]:\\'


def terms(c: Column) -> Column:
    """Tokens: runs of letters and digits, lower case, without accents."""
    return F.filter(F.split(F.lower(without_marks(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, term, at: one row per token."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(F.col(f)).alias("t")) for f in fields]))
    return documents.select(key, each.alias("x")).select(key, "x.field", F.posexplode("x.t").alias("at", "term"))


def lengths(posted: DataFrame, key: str) -> DataFrame:
    """key, length: tokens over all fields."""
    return posted.groupBy(key).agg(F.count("*").alias("length"))


@dataclass
class Word:
    """One word of a query: alternatives, each a phrase of terms and whether its last term is a prefix."""

    alternatives: list[tuple[tuple[str, ...], bool]] = field(default_factory=list)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def compile_query(text: str, prefix_from: int = 1) -> list[Word]:
    """All words must match; the last one may be a prefix; a word that is a code also matches written together.

    prefix_from: least length of a last word to be a prefix (a large number makes the query exact)."""
    words = [w for w in ("".join(c for c in raw if c not in _SYNTAX) for raw in unicodedata.normalize("NFKC", text).split()) if w][:MOST_WORDS]
    out = []
    for i, w in enumerate(words):
        parts = tuple(t for t in re.split(r"[\W_]+", fold(w)) if t)
        word = Word()
        if parts:
            word.alternatives.append((parts, i == len(words) - 1 and len(w) >= prefix_from))
        code = re.sub(r"[\W_]", "", fold(w))
        if len(code) >= 3 and code.upper() != w.upper():
            word.alternatives.append(((code,), True))
        if word.alternatives:
            out.append(word)
    return out


def _asked(query: list[Word]) -> Column:
    """Filter for the postings that any part of the query reads."""
    cond = F.lit(False)
    whole = sorted({t for w in query for phrase, prefix in w.alternatives for t in (phrase[:-1] if prefix else phrase)})
    if whole:
        cond = cond | F.col("term").isin(*whole)
    for p in sorted({phrase[-1] for w in query for phrase, prefix in w.alternatives if prefix}):
        cond = cond | F.col("term").startswith(p)
    return cond


def hits(posted: DataFrame, key: str, query: list[Word]) -> DataFrame:
    """key, word, field, n: how often each word of the query occurs in each field of a document."""
    read = posted.filter(_asked(query))
    out = None
    for no, word in enumerate(query):
        for phrase, prefix in word.alternatives:
            step = None
            for j, t in enumerate(phrase):
                last = j == len(phrase) - 1
                match = F.col("term").startswith(t) if last and prefix else F.col("term") == t
                one = read.filter(match).select(key, "field", (F.col("at") - j).alias("start")).distinct()
                step = one if step is None else step.join(one, [key, "field", "start"])
            found = step.select(key, F.lit(no).alias("word"), "field", "start")
            out = found if out is None else out.unionByName(found)
    return out.distinct().groupBy(key, "word", "field").agg(F.count("*").alias("n"))


def matching(posted: DataFrame, key: str, query: list[Word]) -> DataFrame:
    """key of the documents that hold every word."""
    return hits(posted, key, query).groupBy(key).agg(F.count_distinct("word").alias("w")).filter(F.col("w") == len(query)).select(key)


def ranked(posted: DataFrame, doc_lengths: DataFrame, key: str, query: list[Word], weights: dict[str, float] | None = None, limit: int | None = None) -> DataFrame:
    """key, score: BM25 with field weights, best (most negative) first; ties by key.

    An empty query finds nothing."""
    if not query:
        return doc_lengths.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    weight = F.lit(1.0)
    for f, w in (weights or WEIGHTS).items():
        weight = F.when(F.col("field") == f, F.lit(w)).otherwise(weight)
    by_word = hits(posted, key, query).withColumn("w", weight).groupBy(key, "word").agg(F.sum(F.col("n") * F.col("w")).alias("tf"))
    totals = doc_lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("avg")).first()
    idf_rows = by_word.groupBy("word").agg(F.count("*").alias("df"))  # one row a word of the query
    scored = by_word.join(doc_lengths, key).join(F.broadcast(idf_rows), "word")
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(totals.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(totals.avg or 1.0)))
    found = scored.groupBy(key).agg(F.count("*").alias("w"), (-F.sum(part)).alias("score")).filter(F.col("w") == len(query)).select(key, "score")
    return found.orderBy("score", key).limit(limit) if limit else found


def of_type(found: DataFrame, key: str, kind: str) -> DataFrame:
    """Hits of one entity type (FTS-07). Keys are ``type:id``; ranks are those among all types."""
    return found.filter(F.col(key).startswith(f"{kind}:"))


def hydrated(found: DataFrame, key: str, **entities: DataFrame) -> DataFrame:
    """key, score, rank and the row of each hit, whatever its type, in rank order (FTS-10).

    found: key ``type:id`` and score, a few rows; entities by type: ext_id and the same further columns."""
    w = Window.orderBy("score", key)  # a page of hits
    ranked = found.withColumn("rank", F.row_number().over(w)).withColumn("_type", F.substring_index(key, ":", 1)).withColumn("ext_id", F.substring_index(key, ":", -1).cast("bigint"))
    out = None
    for kind, rows in entities.items():
        one = rows.join(F.broadcast(ranked.filter(F.col("_type") == kind)), "ext_id")
        out = one if out is None else out.unionByName(one)
    return out.drop("_type").orderBy("rank")


def updated_lengths(lengths: DataFrame, changed: DataFrame, removed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Lengths after ``updated`` (FTS-08)."""
    gone = changed.select(key).unionByName(removed.select(key)).distinct()
    size = sum((F.size(terms(F.col(f))) for f in fields), F.lit(0))
    return lengths.join(gone, key, "left_anti").unionByName(changed.select(key, size.cast("bigint").alias("length")).filter("length > 0"))


def cleared(posted: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index without documents (FTS-08)."""
    return posted.filter(F.lit(False)), lengths.filter(F.lit(False))


def updated(posted: DataFrame, changed: DataFrame, removed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Postings with some documents replaced and some removed (FTS-08)."""
    gone = changed.select(key).unionByName(removed.select(key)).distinct()
    return posted.join(gone, key, "left_anti").unionByName(postings(changed, key, fields))
