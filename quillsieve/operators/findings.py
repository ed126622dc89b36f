"""Findings: instruction patterns, severities and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, unmask, unmask_each

SEVERITIES = ("clean", "info", "warn", "critical")
#: Text that addresses an evaluating program, folded; and the same with self-praise.
OVERRIDE = r"(ignor\w* (all|any|the|previous|prior)|disregard (all|any|the|previous)|(instruction|note|remark) (to|for) the (program|model|system|assistant)|score (this|up|the)|rank (this|first)|advance (this|this candidate)|system prompt|pokyn pro |poznamka pro program|hinweis (an|fur) das programm|unsichtbarer vermerk|consigne (pour|au) |indicacion al programa|wskazowka dla programu)"
PRAISE = r"(ideal candidate|best candidate|perfect match|idealni kandidat|nejlepsi uchazec|idealer kandidat|candidat ideal|candidato ideal|idealny kandydat)"
CLIP = 180


def severity_rank(c: Column) -> Column:
    """0 clean to 3 critical; unknown and null severities rank 0."""
    return F.coalesce(F.when(c == "critical", 3).when(c == "warn", 2).when(c == "info", 1), F.lit(0))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int") + 1)


def instruction(c: Column, broad: bool = False, disguised: bool = True) -> Column:
    """The first match of an instruction pattern, at most 120 characters; empty without one, null for null.

    Searched in the text itself, in the folded text and in the folded text without its disguises (unseen characters,
    combining marks, compatibility forms), in this order of preference: folded, without disguises, itself. Unless
    ``disguised``, in the folded text alone.
    """
    pattern = f"{OVERRIDE}|{PRAISE}" if broad else OVERRIDE
    probes = (fold(c), fold(unmask(c)), F.lower(c)) if disguised else (fold(c),)
    hits = [F.nullif(F.regexp_extract(probe, pattern, 0), F.lit("")) for probe in probes]
    return F.substring(F.when(c.isNotNull(), F.coalesce(*hits, F.lit(""))), 1, 120)


def escalate(severity: Column, hit: Column) -> Column:
    """critical on a pattern hit, else the base severity."""
    return F.when(F.coalesce(hit, F.lit("")) != "", "critical").otherwise(severity)


def context(c: Column) -> Column:
    """The first line or sentence with an instruction, at most 300 characters; the whole text's beginning without one."""
    pieces = F.flatten(F.transform(F.split(c, "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+")))
    both = F.arrays_zip(pieces.alias("piece"), unmask_each(pieces).alias("bare"))
    hits = F.filter(both, lambda p: fold(p["piece"]).rlike(OVERRIDE) | fold(p["bare"]).rlike(OVERRIDE) | F.lower(p["piece"]).rlike(OVERRIDE))
    return F.substring(F.coalesce(F.try_element_at(hits, F.lit(1))["piece"], c), 1, 300)


def distinct_findings(flags: DataFrame) -> DataFrame:
    """Each finding once: redelivered rows have the same content."""
    return flags.drop("ingested_at").dropDuplicates(["flag_id"])


def worst(findings: DataFrame, key: str) -> DataFrame:
    """(key, worst, n_flags): the worst severity of each key's findings."""
    return findings.groupBy(key).agg(F.max(severity_rank(F.col("severity"))).alias("r"), F.count("*").alias("n_flags")).select(key, severity_name(F.col("r")).alias("worst"), "n_flags")


def totals(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity and of records that have any."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return findings.groupBy(*keys).agg(n("critical"), n("warn"), n("info"), F.count("*").alias("n_all"), F.countDistinct("scan_id").alias("n_scans"))


def quality(results: DataFrame) -> DataFrame:
    """One row of detector quality over (poisoned, flagged, critical, contained): recalls over the poisoned, the false
    positive rate over the clean; null where there are none."""
    rate = lambda what, of: F.avg(F.when(of, F.col(what).cast("double")))
    p = F.col("poisoned")
    return results.agg(
        F.round(rate("flagged", p), 6).alias("detection_recall"), F.round(rate("critical", p), 6).alias("critical_recall"),
        F.round(rate("contained", p), 6).alias("containment_recall"), F.round(rate("flagged", ~p), 6).alias("false_positive_rate"), F.count("*").alias("n"),
    )


def reaches(visible: Column, hidden: Column, payload: Column) -> Column:
    """struct(in_visible, in_hidden): whether a payload stands in what a reader, and so a model, gets, and in what is held
    back; all three folded, without disguises. A blank payload stands nowhere."""
    p = fold(unmask(payload))
    there = lambda c: F.coalesce((p != "") & F.contains(fold(unmask(c)), p), F.lit(False))
    return F.struct(there(visible).alias("in_visible"), there(hidden).alias("in_hidden"))
