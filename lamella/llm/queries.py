"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.sources.tables import table

from . import clusters, leak, neighbours, overlap, pii, sites, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "space_x"), table(spark, d, "labelfree_spaces"))


def p1_same_crop(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.same_crop_rate(table(spark, d, "space_x"), table(spark, d, "labelfree_spaces"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sites.tied_crops(table(spark, d, "spots_table"), table(spark, d, "design"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return sites.crop_splits(table(spark, d, "spots_table"), table(spark, d, "design"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sites.strips_of_sites(table(spark, d, "strip_map"), table(spark, d, "analysis_only"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_members(table(spark, d, "space_x"), table(spark, d, "labelfree_spaces"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_sizes(table(spark, d, "space_x"), table(spark, d, "labelfree_spaces"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "strip_map"), table(spark, d, "design"))


def p5_by_source(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps_by_source(table(spark, d, "strip_map"), table(spark, d, "design"))


def p5_same_records(spark: SparkSession, d: str) -> DataFrame:
    strips, design = table(spark, d, "strip_map"), table(spark, d, "design")
    return overlap.same_profiles(strips, design)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.corpus_ids(table(spark, d, "documents"))


def p6_tokens_by_source(spark: SparkSession, d: str) -> DataFrame:
    return tokens.tokens_by_source(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_by_suite(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks_by_suite(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(table(spark, d, "documents"), table(spark, d, "given_names"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_personal(table(spark, d, "documents"), table(spark, d, "given_names"))


QUERIES = {f.__name__: f for f in (p1_found, p1_same_crop, p2_found, p2_splits, p3_found, p4_found, p4_sizes, p5_found, p5_by_source, p5_same_records, p6_ids, p6_tokens_by_source, p7_found, p7_by_suite, p8_found, p8_redacted)}
