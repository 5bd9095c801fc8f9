"""Queries of the operators on text, with their SQL twins where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import credentials, dedup, mixing, origin, privacy, syntax, tokenizer
from graphloom.runtime import Scratch, table


_CODE = [("symbols", "symbol_id"), ("snippets", "snippet_id")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        credentials.scan(table(spark, sf, name), key).select(F.lit(name).alias("source_table"), "row_id", "line_no")
        for name, key in _CODE
    ]
    return parts[0].unionByName(parts[1])


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        credentials.redacted(table(spark, sf, name)).select(
            F.lit(name).alias("source_table"), F.col(key).cast("string").alias("row_id"), "source_code"
        )
        for name, key in _CODE
    ]
    return parts[0].unionByName(parts[1])


def _origins(spark: SparkSession, sf: str) -> DataFrame:
    return origin.origins(table(spark, sf, "file_index"), table(spark, sf, "parse_results"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _origins(spark, sf).select("file_id").distinct()


def p3_origins(spark: SparkSession, sf: str) -> DataFrame:
    return _origins(spark, sf)


def _collapsed(spark: SparkSession, sf: str) -> DataFrame:
    keys = {
        "title": dedup.canonical_title(F.col("title")),
        "file_path": dedup.plain_text(F.col("file_path")),
        "rule_id": dedup.plain_text(F.col("rule_id")),
    }
    return dedup.collapse(table(spark, sf, "findings"), "finding_id", keys)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _collapsed(spark, sf).where("copy_id <> kept_id").select("kept_id", "copy_id")


def p4_copies(spark: SparkSession, sf: str) -> DataFrame:
    return _collapsed(spark, sf).where("copy_id = kept_id").select("kept_id", "copies")


_P4 = """
WITH plain AS (
  SELECT finding_id, title, file_path, rule_id,
    regexp_extract(title, '[(\\[{<]([^()\\[\\]{}<>]*)[)\\]}>][^\\p{L}\\p{N}]*$', 1) AS inside,
    regexp_replace(title, '[(\\[{<]([^()\\[\\]{}<>]*)[)\\]}>][^\\p{L}\\p{N}]*$', '') AS head FROM findings),
fields AS (
  SELECT *, list_filter(string_split_regex(inside, '[,;]'), lambda f: regexp_matches(f, '[\\p{L}\\p{N}]')) AS fs FROM plain),
canon AS (
  SELECT finding_id,
    CASE WHEN len(fs) > 0 AND len(list_filter(fs, lambda f: regexp_matches(f, '[\\p{L}\\p{N}][^\\p{L}\\p{N}=:]*[=:]'))) = len(fs)
    THEN replace(translate(lower(regexp_replace(head, '[^\\p{L}\\p{N}]+', '', 'g')), 'ςſ', 'σs'), 'ß', 'ss') || array_to_string(list_sort(
      list_transform(fs, lambda f: replace(translate(lower(regexp_replace(f, '[^\\p{L}\\p{N}]+', '', 'g')), 'ςſ', 'σs'), 'ß', 'ss'))), '')
    ELSE replace(translate(lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g')), 'ςſ', 'σs'), 'ß', 'ss') END AS t,
    replace(translate(lower(regexp_replace(file_path, '[^\\p{L}\\p{N}]+', '', 'g')), 'ςſ', 'σs'), 'ß', 'ss') AS f,
    replace(translate(lower(regexp_replace(rule_id, '[^\\p{L}\\p{N}]+', '', 'g')), 'ςſ', 'σs'), 'ß', 'ss') AS r FROM fields),
g AS (SELECT finding_id, min(finding_id) OVER w AS kept_id, count(*) OVER w AS copies FROM canon WINDOW w AS (PARTITION BY t, f, r))
"""


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid(table(spark, sf, "parse_results")).select("file_id").distinct()


def p7_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.invalid(table(spark, sf, "parse_results"))


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(table(spark, sf, "parse_results"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf, "documents"), ["doc_id"])


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents weigh by their characters per token: plain prose is likelier to be taken than noise."""
    counted = tokenizer.encode(table(spark, sf, "documents"), ["doc_id", "source", "n_chars"], count_only=True)
    docs = Scratch(spark, "counts").put(counted.withColumn("weight", F.col("n_chars") / F.when(F.col("n_tokens") > 0, F.col("n_tokens"))))
    targets = table(spark, sf, "mix_targets")
    return mixing.mix(docs, targets, weight="weight"), docs, targets


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return privacy.scan(docs, privacy.learn(docs.select("text").where("text is not null and text <> ''")))


def p10_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return privacy.sanitised(docs, privacy.learn(docs.select("text").where("text is not null and text <> ''")))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_origins": p3_origins,
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p7_found": p7_found,
    "p7_kinds": p7_kinds,
    "p7_rates": p7_rates,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_sanitised": p10_sanitised,
}
ORACLE = {
    "p4_found": _P4 + "SELECT kept_id, finding_id AS copy_id FROM g WHERE finding_id <> kept_id",
    "p4_copies": _P4 + "SELECT kept_id, copies FROM g WHERE finding_id = kept_id",
}
