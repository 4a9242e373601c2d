"""Registered queries of the llm operators: (spark, data folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriatim.llm import bpe, knn, nearest, packing, residue, spans, survivor
from seriatim.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.found(table(spark, root, "discharge"))


def p1_coverage(spark: SparkSession, root: str) -> DataFrame:
    return spans.coverage(table(spark, root, "discharge"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return nearest.oxygen(table(spark, root, "labevents"), table(spark, root, "chartevents"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return knn.found(table(spark, root, "chunk_vec"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return survivor.found(table(spark, root, "chartevents"))


def p7_survivors(spark: SparkSession, root: str) -> DataFrame:
    return survivor.survivors(table(spark, root, "chartevents"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encoded(table(spark, root, "documents"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(bpe.lengths(table(spark, root, "documents")), "doc_id", "n_tokens")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue(table(spark, root, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p4_found, p6_found, p7_found, p7_survivors, p8_ids, p9_containers, p10_found)}
