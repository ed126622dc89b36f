"""Queries on nested answers (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import cut, table
from ..operators import nested


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.entries(table(spark, sf, "extractions"))


def p2_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct subtree once."""
    return nested.objects(nested.occurrences(table(spark, sf, "extractions")))


def p2_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence of a subtree with its parent and ordinal."""
    return nested.occurrences(table(spark, sf, "extractions"), bodies=False)


def _flat(block: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = cut(nested.occurrences(table(spark, sf, "extractions")))
        return nested.flat(nested.bridge(found), nested.objects(found), block)

    return query


def p2_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Entries and documents per block."""
    e = nested.entries(table(spark, sf, "extractions"))
    per = e.groupBy("block", "extraction_id", "doc_ord").agg(F.count("*").alias("n"))
    return per.groupBy("block").agg(F.sum("n").alias("entries"), F.count("*").alias("documents"))


QUERIES = {"p2_found": p2_found, "p2_objects": p2_objects, "p2_bridge": p2_bridge, "p2_blocks": p2_blocks} | {f"p2_{b}": _flat(b) for b in nested.BLOCKS}
SQL: dict[str, str] = {}
