"""The queries of this subpackage for the driver, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsift.llm import addresses, groups, lookalikes, mixing, names, personal, scan_noise, tokens
from docsift.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_place_pairs(table(spark, d, "analyzed"), table(spark, d, "city_ref"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_place_classes(table(spark, d, "analyzed"), table(spark, d, "city_ref"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find_personal(table(spark, d, "doc_text"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted_texts(table(spark, d, "doc_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_pairs(table(spark, d, "analyzed"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.same_name_entities(table(spark, d, "analyzed"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.scan_defects(table(spark, d, "doc_text"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired_texts(table(spark, d, "doc_text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "match_pairs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking_classes(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_form(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "form")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_classes, p3_found, p3_redacted, p4_found, p4_entities, p5_found, p5_repaired, p6_found, p7_ids, p8_mixture, p8_shares, p9_found, p9_classes, p9_forms)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries it can express on whole tables: the smallest document that reaches each one."""
    return {
        "p6_found": """WITH RECURSIVE accepted AS (SELECT left_ix AS a, right_ix AS b FROM match_pairs WHERE is_match AND left_ix IS NOT NULL AND right_ix IS NOT NULL),
            links AS (SELECT a, b FROM accepted UNION SELECT b, a FROM accepted),
            reach AS (SELECT DISTINCT a AS doc_ix, a AS low FROM links UNION SELECT b, low FROM reach JOIN links ON doc_ix = a WHERE low < b)
            SELECT doc_ix, min(low) AS group_ix FROM reach GROUP BY doc_ix""",
    }
