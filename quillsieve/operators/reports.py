"""Reports: shortlists, records and tables of results, quality of detection and what its layers miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import severity_rank
from .scoring import rank, ranked, state

#: What detection must reach, and what false positives may.
LEAST = {"detection_recall": 0.98, "containment_recall": 0.98}
MOST_FALSE = 0.10
#: Labels of states, certainties and severities.
STATES = {"strong": "strong", "partial": "partial", "weak": "weak", "unknown": "not evidenced"}
CERTAINTY = {"stated": "stated in the document", "inferred": "inferred, to be checked", "unknown": "not stated"}
SEVERITY = {"critical": "critical", "warn": "warning", "info": "note", "clean": "no finding"}


def label(c: Column, names: dict[str, str]) -> Column:
    """The label of a code, the code itself where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def view(breakdown: DataFrame) -> DataFrame:
    """Adds state, state_label and certainty to the rows of a breakdown."""
    return breakdown.withColumn("state", state(F.col("score"), F.col("known"))).withColumn("state_label", label(F.col("state"), STATES)).withColumn("certainty", label(F.col("basis"), CERTAINTY))


def strongest(breakdown: DataFrame, key: str, n: int = 2) -> DataFrame:
    """(key, strongest): the ``n`` best known criteria of each key, joined; of equal ones the first by name."""
    known = breakdown.where("known").groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "criterion"))).alias("c"))
    return known.select(key, F.array_join(F.transform(F.slice("c", 1, n), lambda x: x["criterion"]), ", ").alias("strongest"))


def shortlist(scores: DataFrame, breakdown: DataFrame, key: str, group: str, n: int = 5) -> DataFrame:
    """(group, key, total, rank, strongest) of the ``n`` best of each group, a top-k report: limited before anything meets."""
    best = rank(scores.select(group, key, "total"), [F.desc("total"), F.asc(key)], [group]).where(F.col("rank") <= n)
    return best.join(strongest(breakdown.join(best.select(key), key, "left_semi"), key), key, "left").select(group, key, "total", "rank", F.coalesce("strongest", F.lit("")).alias("strongest"))


def flagged(findings: DataFrame, key: str, group: str, n: int = 8) -> DataFrame:
    """(group, key, n_flags, place): the ``n`` with the most findings of each group, a top-k report."""
    counts = findings.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count("*").alias("n_flags"))
    return rank(counts, [F.desc("n_flags"), F.asc(key)], [group], "place").where(F.col("place") <= n)


def last_per_name(extracts: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Of several extractions of one file name of a key the last."""
    cols = [c for c in extracts.columns if c not in (key, name)]
    return extracts.groupBy(key, name).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, name, "r.*")


def displayed(ranking: DataFrame, group: str) -> DataFrame:
    """The rows of a ranking that are shown, those of applicants (is_candidate not false), with their place among them."""
    shown = ranking.where(F.coalesce("is_candidate", F.lit(True)))
    return ranked(shown.withColumnRenamed("rank", "__rank").drop("n"), group, [F.asc("__rank")]).withColumnRenamed("rank", "place").withColumnRenamed("__rank", "rank")


def as_json(df: DataFrame) -> DataFrame:
    """(value): a JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def exit_code(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """(n_critical, code): 2 if a document couldn't be scanned, 1 if there is a warning or worse, else 0."""
    rows = findings.select(severity_rank(F.col("severity")).alias("r"), F.lit(0).alias("bad")).unionByName(documents.select(F.lit(0).alias("r"), (~F.coalesce("ok", F.lit(False))).cast("int").alias("bad")))
    return rows.agg(F.count_if(F.col("r") == 3).alias("n_critical"), F.when(F.max("bad") > 0, 2).when(F.max("r") >= 2, 1).otherwise(0).alias("code"))


def passed(quality: DataFrame) -> DataFrame:
    """Adds passed to a row of detector quality: whether all rates that are known meet their bounds; without cases null."""
    ok = F.lit(True)
    for name, least in LEAST.items():
        ok = ok & (F.col(name) >= least)
    return quality.withColumn("passed", ok & (F.col("false_positive_rate") <= MOST_FALSE))


def layers(first: DataFrame, second: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, gap): for every poisoned record that a layer misses (missed_by_first, missed_by_second, missed_by_both), for every
    clean one that any flags (false_positive). first, second: keys that a layer flags; truth: key, poisoned."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    t = truth.join(mark(first, "a"), key, "left").join(mark(second, "b"), key, "left").na.fill(False, ["a", "b"])
    gap = F.when(F.col("poisoned"), F.when(~F.col("a") & ~F.col("b"), "missed_by_both").when(~F.col("a"), "missed_by_first").when(~F.col("b"), "missed_by_second")).when(F.col("a") | F.col("b"), "false_positive")
    return t.withColumn("gap", gap).where("gap IS NOT NULL").select(key, "gap")
