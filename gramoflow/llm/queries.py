"""The queries of the text problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramoflow.llm import canonical, leaks, names, packing, truncation
from gramoflow.operators import segment
from gramoflow.operators.scale import stage
from gramoflow.plans.problems import known_names
from gramoflow.session import table

#: Artist ids that stand for no artist.
PLACEHOLDER_ARTISTS = (194, 355, 118760)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collection_rows")
    fields = ("media_condition", "sleeve_condition", "format_raw")
    long = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("row_id", "x.field", "x.text")
    long = long.filter("trim(text) <> ''")
    texts = stage(long.select("field", "text").distinct(), "texts")
    packed = segment.segment_fields(texts.filter("field = 'format_raw'").select("field", F.col("text").alias("kept"), "text"), known_names(spark, d))

    @F.pandas_udf("string")
    def first_value(vals):
        return vals.map(lambda v: segment.without_quantity(v[0]) if len(v) else "")

    values = texts.filter("field <> 'format_raw'").select("field", "text", F.col("text").alias("value"))
    values = values.unionByName(packed.select("field", F.col("kept").alias("text"), first_value("vals").alias("value")))
    return canonical.map_rows(long, stage(values, "values"), table(spark, d, "canon_values"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    credits, rows = table(spark, d, "credits"), table(spark, d, "collection_rows")
    texts = names.spellings([(credits, "name", "discogs_artist_id"), (credits, "anv", None), (rows, "artist", None)])
    said = credits.filter("name <> '' AND anv <> '' AND name <> anv").select("name", "anv").distinct()
    return names.links(texts, said)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(_linked(spark, d))


def p7_members(spark: SparkSession, d: str) -> DataFrame:
    return names.members(_linked(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.token_counts(table(spark, d, "documents")), table(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p8_containers(spark, d), table(spark, d, "pack_specs"))


def p8_search(spark: SparkSession, d: str) -> DataFrame:
    return packing.search_report(packing.token_counts(table(spark, d, "documents")), table(spark, d, "pack_specs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must never be: overfull containers, texts that are split though they fit, tokens lost or doubled."""
    counts = packing.token_counts(table(spark, d, "documents"))
    specs = table(spark, d, "pack_specs").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    packed = stage(packing.containers(counts, table(spark, d, "pack_specs")), "containers")
    full = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))  # pack_specs is a small table of the task
    docs = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).join(counts, "doc_id").join(F.broadcast(specs), "spec_id")
    split = docs.groupBy("spec_id", "capacity").agg(F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("split_small"), F.count_if(F.col("n") != F.col("n_tokens")).alias("wrong_tokens"), F.count("*").alias("n_docs"))
    return full.join(split, "spec_id").select("spec_id", "capacity", "overfull", "split_small", "wrong_tokens", "n_docs")


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p7_found, p7_members, p8_containers, p8_fill, p8_search, p8_valid, p9_found, p9_spans, p10_found, p10_rates)}


_INLINE = "|".join(sorted(leaks._INLINE))
_FOLDED = (
    "regexp_replace(regexp_replace(regexp_replace({}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(" + _INLINE + ")([^A-Za-z0-9<>][^<>]*)?>', '', 'g'), '</?[A-Za-z][A-Za-z0-9]*[^<>]*>', ' ', 'g')"
)
_WORDS = (
    "regexp_extract_all(regexp_replace(replace(replace(replace(replace(translate(strip_accents(lower(" + _FOLDED + ")), 'øłđðı', 'olddi'), 'þ', 'th'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), '[\\p{{Cf}}\\p{{Mn}}\\p{{Me}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"
)
_WINDOWS = f"""d AS (SELECT DISTINCT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), i AS (SELECT DISTINCT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE item_id IS NOT NULL AND passage IS NOT NULL),
dw AS (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS pos FROM d WHERE len(w) >= 13), iw AS (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS pos FROM i WHERE len(w) >= 13),
hits AS (SELECT DISTINCT doc_id, item_id, dw.pos FROM dw JOIN iw ON array_to_string(dw.w[dw.pos + 1:dw.pos + 13], ' ') = array_to_string(iw.w[iw.pos + 1:iw.pos + 13], ' '))"""
P9_FOUND = f"WITH {_WINDOWS} SELECT DISTINCT doc_id, item_id FROM hits"
P9_SPANS = f"""WITH {_WINDOWS}, s AS (SELECT doc_id, item_id, pos, lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS before FROM hits), g AS (SELECT *, sum(CASE WHEN before IS NULL OR pos > before + 13 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS span FROM s)
SELECT doc_id, item_id, CAST(min(pos) AS INT) AS first_word, CAST(max(pos) + 13 AS INT) AS end_word FROM g GROUP BY doc_id, item_id, span"""
P8_VALID = "SELECT CAST(spec_id AS INT) AS spec_id, CAST(capacity_tokens AS BIGINT) AS capacity, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_small, CAST(0 AS BIGINT) AS wrong_tokens, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_docs FROM pack_specs"


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can say it; the others' tests are in tests/llm."""
    return {"p8_valid": P8_VALID, "p9_found": P9_FOUND, "p9_spans": P9_SPANS}
