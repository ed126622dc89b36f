"""The queries of the text preparation operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from . import canon, damage, langid, lookalike, packing, pii, residue, tokens


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return damage.found(table(spark, sf, "scans"), table(spark, sf, "flags"))


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the damaged scans and flags as they were written, as far as they survive."""
    return damage.restored(table(spark, sf, "scans"), table(spark, sf, "flags"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return canon.mapped({t: table(spark, sf, t) for t in ("q_skills", "q_languages", "q_education")}, table(spark, sf, "ref_values"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).select("src", "row_id", "ref_id")


def p3_misses(spark: SparkSession, sf: str) -> DataFrame:
    """The values that mean none of the entries."""
    return canon.misses(_typed(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.found(table(spark, sf, "scans"), table(spark, sf, "documents"))


def p4_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Every scan's main language and its lines in another, with confidence."""
    return langid.labelled_lines(table(spark, sf, "scans"), langid.train(table(spark, sf, "documents")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.found(table(spark, sf, "scans"), table(spark, sf, "flags"))


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that weren't in the one form, in it."""
    return lookalike.unified(lookalike.sources_of(table(spark, sf, "scans"), table(spark, sf, "flags")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found(table(spark, sf, "scans"), table(spark, sf, "extractions"))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every scan's text with its personal data replaced by typed placeholders."""
    return pii.redacted(table(spark, sf, "scans"), table(spark, sf, "extractions"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(table(spark, sf, "documents"))


def p9_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and coverage of every document."""
    return residue.judged(table(spark, sf, "documents"))


def p9_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without those that p9_found names."""
    return residue.cleaned(table(spark, sf, "documents"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "containers"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers of each kind are used, and how full they are."""
    return packing.report(p8_packed(spark, sf))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted, "p3_found": p3_found, "p3_misses": p3_misses, "p4_found": p4_found, "p4_labelled": p4_labelled, "p1_found": p1_found, "p1_restored": p1_restored, "p5_found": p5_found, "p5_unified": p5_unified, "p9_found": p9_found, "p9_judged": p9_judged, "p9_cleaned": p9_cleaned, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_report": p8_report}
SQL: dict[str, str] = {}
