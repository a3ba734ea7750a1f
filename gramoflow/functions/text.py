"""Text columns: folding, normalised names and codes, keys, hashes (SCL-01, 02, 09, 10, 25, 33).

Everything runs inside the engine. Unicode decomposition, for which Spark has no function, is one vectorised step that
is skipped for ASCII text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normal_form(c: Column, form: str) -> Column:
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return F.when(c.rlike(r"\A\p{ASCII}*\z"), c).otherwise(normal(c))


def without_marks(c: Column) -> Column:
    """NFKD without combining marks."""
    return F.regexp_replace(_normal_form(c, "NFKD"), r"\p{M}+", "")


def normalize_name(c: Column) -> Column:
    """Accents, the number in parentheses at the end, case and punctuation go; null if nothing is left."""
    plain = F.lower(F.regexp_replace(without_marks(c), r"(?U)\s+\(\d+\)\s*$", ""))
    return F.nullif(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def normalize_code(c: Column) -> Column:
    """Upper-case letters and digits only; null for nothing and for NONE."""
    code = F.regexp_replace(F.upper(without_marks(c)), r"[^\p{L}\p{N}]", "")
    return F.when((code != "") & (code != "NONE"), code)


def norm_key(c: Column) -> Column:
    """Lower case, NFKC, only a-z, 0-9 and #; null counts as empty."""
    return F.regexp_replace(_normal_form(F.lower(F.coalesce(c, F.lit(""))), "NFKC"), "[^a-z0-9#]", "")


def ascii_fold(c: Column) -> Column:
    """ASCII letters in lower case, all others as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def identity_key(release_id: Column, artist: Column, title: Column, catno: Column) -> Column:
    """``r:`` and the id, else ``t:`` and the normalised artist, title and catalog number (REC-03)."""
    return F.when(release_id.isNotNull(), F.concat(F.lit("r:"), release_id)).otherwise(F.concat(F.lit("t:"), F.concat_ws("|", norm_key(artist), norm_key(title), norm_key(catno))))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def tag_list(c: Column, longest: int = 40, most: int = 30) -> Column:
    """Comma-separated tags: trimmed, lower case, blanks as hyphens, distinct, in first-seen order."""
    tags = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.substring(F.regexp_replace(F.lower(F.trim(t)), r"(?U)\s+", "-"), 1, longest))
    return F.slice(F.array_distinct(F.filter(tags, lambda t: t != "")), 1, most)


def clip(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def capped(c: Column, most: int) -> Column:
    """The first elements of a list (SCL-16)."""
    return F.slice(c, 1, most)
