"""Criterion scores from 0 to 10 as column expressions, their weighted total, and ranking.

Unknown is kept apart from zero: each score comes with whether it is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut
from ..functions.text import fold
from .matching import has_skill


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def numeric_scale(v: Column, low: float, high: float) -> Column:
    """Linear from low to high; 5 where unknown, 0 where the scale is empty."""
    if high <= low:
        return F.when(v.isNull(), 5.0).otherwise(0.0)
    return F.when(v.isNull(), 5.0).otherwise(clamp((v - low) / (high - low)) * 10)


def category_points(points: Column, average: bool = False) -> Column:
    """The largest of an array of points, or their mean; 0 where there are none."""
    mean = F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(points), F.lit(0))
    return F.coalesce(mean if average else F.array_max(points), F.lit(0.0))


def tenure(mean_months: Column, floor: float = 6.0, full: float = 24.0) -> Column:
    """Mean months in a place from floor to full; 5 where unknown. With full <= floor all known means score 0."""
    if full <= floor:
        return F.when(mean_months.isNull(), 5.0).otherwise(0.0)
    return F.when(mean_months.isNull(), 5.0).otherwise(clamp((mean_months - floor) / (full - floor)) * 10)


def bonus(n: Column, each: float = 2.0, cap: float = 10.0) -> Column:
    return F.least(n * each, F.lit(cap))


def half_up(c: Column) -> Column:
    """Rounded half up to a tenth on the double, the same in every engine."""
    return F.floor(c * 10 + 0.5) / 10


def total(scores: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores times ten; all weights zero give 0."""
    weights = sum(w for _, w in scores) or 1.0
    out = F.lit(0.0)
    for s, w in scores:
        out = out + F.lit(w) / F.lit(weights) * s * 10
    return half_up(out)


def rank(scored: DataFrame, by: list[Column], group: list[str], name: str = "rank") -> DataFrame:
    """Adds a unique rank within each group; each group is sorted by one task, so for few of each group (a filter on the
    rank, which limits before the shuffle) or groups of bounded size. ``ranked`` splits large groups."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*by)))


def _features(answers: DataFrame, required: list[str], points: dict[str, float]) -> DataFrame:
    """Adds what the criteria need of an answer (q): __years, __hit_i (whether a skill meets the i-th required), __said
    (whether one that meets any has evidence), __education, __months, __places and __certificates."""
    q = lambda path: F.col(f"q.{path}")
    wanted = [fold(F.lit(w)) for w in required]
    a = answers.withColumn("__skills", F.transform(q("skills"), lambda s: F.struct(fold(s["name"]).alias("n"), (F.coalesce(s["evidence"], F.lit("")) != "").alias("e"))))
    by = F.create_map(*[F.lit(x) for kv in points.items() for x in kv]) if points else F.create_map().cast("map<string,double>")
    levels = F.transform(q("education"), lambda e: F.coalesce(F.try_element_at(by, fold(e["level"])), F.lit(0.0)))
    months = F.filter(F.transform(q("experience"), lambda e: e["months"]), lambda m: m.isNotNull())
    met = lambda w, said=False: F.exists("__skills", lambda s: has_skill(s["n"], w) & (s["e"] if said else F.lit(True)))
    said = F.lit(False)
    for w in wanted:
        said = said | met(w, True)
    return a.withColumns(
        {f"__hit_{i}": met(w) for i, w in enumerate(wanted)}
        | {"__said": said, "__years": q("years"), "__education": F.array_max(levels), "__months": F.aggregate(months, F.lit(0.0), lambda x, m: x + m), "__places": F.size(months), "__certificates": F.size(q("certifications"))}
    ).drop("__skills")


def _criteria(features: DataFrame, key: str, weights: dict[str, float], n_required: int, years: tuple[float, float]) -> DataFrame:
    hits = F.lit(0)
    for i in range(n_required):
        hits = hits + F.col(f"__hit_{i}").cast("int")
    mean = F.col("__months") / F.nullif(F.col("__places"), F.lit(0))
    stated = lambda known: F.when(known, "stated").otherwise("unknown")
    some, taught, known = F.lit(n_required > 0), F.col("__education").isNotNull(), F.col("__years").isNotNull()
    every = {
        "years": (numeric_scale(F.col("__years"), *years), known, stated(known)),
        "skills": (hits * 10.0 / max(1, n_required), some, F.when(~some, "unknown").when(F.col("__said"), "stated").otherwise("inferred")),
        "education": (F.coalesce("__education", F.lit(0.0)), taught, stated(taught)),
        "tenure": (tenure(mean), mean.isNotNull(), stated(mean.isNotNull())),
        "certifications": (bonus(F.col("__certificates")), F.lit(True), F.lit("stated")),
    }
    whole = sum(weights.values()) or 1.0
    row = lambda n: F.struct(F.lit(n).alias("criterion"), F.lit(weights[n]).alias("weight"), every[n][0].alias("score"), (F.lit(weights[n]) / F.lit(whole) * every[n][0] * 10).alias("contribution"), every[n][1].alias("known"), every[n][2].alias("basis"))
    return features.select(key, F.explode(F.array(*[row(n) for n in weights])).alias("r")).select(key, "r.*")


def breakdown(answers: DataFrame, key: str, weights: dict[str, float], required: list[str], points: dict[str, float], years: tuple[float, float] = (0.0, 8.0)) -> DataFrame:
    """(key, criterion, weight, score, contribution, known, basis): a row per criterion of ``weights`` of every answer.

    answers: key, q as ``extraction.qualification`` has it. years, skills (shares of ``required`` met, known where any are
    required, stated where a matching skill has evidence), education (best of ``points`` by folded level), tenure (mean of
    known months) and certifications (a bonus). Unknown is kept apart from zero.
    """
    return _criteria(_features(answers.select(key, "q"), required, points), key, weights, len(required), years)


def merged_breakdown(answers: DataFrame, key: str, weights: dict[str, float], required: list[str], points: dict[str, float], years: tuple[float, float] = (0.0, 8.0)) -> DataFrame:
    """``breakdown`` of all answers of a key as one: years at their largest, at least 0, certifications once by name. Each
    answer is reduced to what the criteria need before rows meet, so no key's answers are gathered; rows without a key are
    left out."""
    known = answers.where(F.col(key).isNotNull())
    f = _features(known.select(key, "q"), required, points)
    top = F.max("__years")
    one = f.groupBy(key).agg(
        F.when(top.isNotNull(), F.greatest(top, F.lit(0.0))).alias("__years"), *[F.bool_or(f"__hit_{i}").alias(f"__hit_{i}") for i in range(len(required))], F.bool_or("__said").alias("__said"),
        F.max("__education").alias("__education"), F.sum("__months").alias("__months"), F.sum("__places").alias("__places"),
    )
    named = known.select(key, F.explode("q.certifications").alias("c")).select(key, F.lower(F.trim("c")).alias("c")).where("c <> ''").distinct().groupBy(key).agg(F.count("*").alias("__certificates"))
    return _criteria(one.join(named, key, "left").na.fill(0, ["__certificates"]), key, weights, len(required), years)


def state(score: Column, known: Column) -> Column:
    """unknown, strong (from 7.5), partial (from 4) or weak."""
    return F.when(~known, "unknown").when(score >= 7.5, "strong").when(score >= 4, "partial").otherwise("weak")


def ranked(scored: DataFrame, group: str, by: list[Column], parts: int = 0) -> DataFrame:
    """Adds rank (unique within the group, in the order ``by``) and n (the group's size), whatever share of the rows one
    group has: rows are sorted by ranges over all tasks, so a group larger than a task is split, and each task's place in
    its groups comes from counts by task and group. Ties that ``by`` leaves open are broken by no rule; order by a key last.
    """
    spark = scored.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(scored.repartitionByRange(parts, F.col(group), *by).sortWithinPartitions(F.col(group), *by).withColumn("__task", F.spark_partition_id()))
    counts = placed.groupBy(group, "__task").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("__c").over(Window.partitionBy(group)))
    within = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__task", group).orderBy(*by)))
    met = within.alias("w").join(offsets.alias("o"), F.col("w.__task").eqNullSafe(F.col("o.__task")) & F.col(f"w.{group}").eqNullSafe(F.col(f"o.{group}")))
    return met.select("w.*", (F.col("o.__before") + F.col("w.__i")).alias("rank"), F.col("o.n").alias("n")).drop("__i", "__task")


def totals(breakdown_rows: DataFrame, key: str) -> DataFrame:
    """(key, total): the contributions of a breakdown added up, rounded half up to a tenth."""
    return breakdown_rows.groupBy(key).agg(half_up(F.round(F.sum("contribution"), 9)).alias("total"))
