"""What a position asks for: requests parsed, wanted languages listed, criteria built, importances encoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .matching import language_codes

#: Languages beyond so many are a wish list.
MOST_LANGUAGES = 5
#: The criteria with their types and weights out of a hundred.
CRITERIA = {"years": ("numeric_scale", 25.0), "skills": ("set_overlap", 30.0), "education": ("category_map", 15.0), "language": ("cefr_map", 10.0), "tenure": ("tenure", 10.0), "certifications": ("bonus", 10.0)}
#: Weights of the tiers of importance, and where the next begins.
TIER_WEIGHTS, TIER_ENDS = (0, 10, 20, 30, 45), (0, 15, 25, 37)


def parse(requests: DataFrame, raw: str = "request") -> DataFrame:
    """Adds job_title, min_years, required_skills, languages, weights and disabled to requests in JSON.

    Years are rounded and at least 0, also where they come as text; skills are small letters without blanks; languages
    come as a list or as one text with commas, semicolons or slashes. Unreadable requests ask for nothing.
    """
    v = F.try_parse_json(raw)
    r = requests.withColumn("__v", v)
    get = lambda path, kind: F.try_variant_get("__v", path, kind)
    texts = lambda path: F.transform(F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>")), lambda e: F.trim(F.coalesce(F.try_variant_get(e, "$", "string"), F.lit(""))))
    some = lambda c: F.filter(c, lambda s: s != "")
    listed = F.when(F.coalesce(F.schema_of_variant(get("$.languages", "variant")), F.lit("")) == "STRING", F.transform(F.split(get("$.languages", "string"), "[,;/]+"), lambda s: F.trim(s))).otherwise(texts("$.languages"))
    return r.withColumns(
        {
            "job_title": F.coalesce(get("$.jobTitle", "string"), F.lit("")), "min_years": F.greatest(F.floor(F.coalesce(get("$.minYears", "double"), F.lit(0.0)) + 0.5), F.lit(0)).cast("int"),
            "required_skills": some(F.transform(texts("$.requiredSkills"), F.lower)), "languages": some(listed), "weights": get("$.weights", "map<string,double>"), "disabled": texts("$.disabled"),
        }
    ).drop("__v")


def language_list(parsed: DataFrame, key: str, dictionary: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, place, language): the wanted languages of each request, each once by its code (by its folded name where none is
    known), named as ``labels`` (code, label) has it, the first ``MOST_LANGUAGES``. A request's list is short."""
    each = parsed.select(key, F.posexplode("languages").alias("ord", "value"))
    codes = language_codes(each, dictionary, "value").join(F.broadcast(labels), "code", "left")  # labels: of the dictionary's languages
    named = each.join(codes, "value", "left").withColumn("same", F.coalesce("code", fold(F.col("value")))).withColumn("language", F.coalesce("label", "value"))
    first = named.groupBy(key, "same").agg(F.min(F.struct("ord", "language")).alias("r"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("r.ord"))
    return first.withColumn("place", place).where(F.col("place") <= MOST_LANGUAGES).select(key, "place", F.col("r.language").alias("language"))


def criteria(parsed: DataFrame, key: str) -> DataFrame:
    """(key, criterion, type, weight, scale_max): a row per criterion of each request.

    Disabled criteria are left out, and languages where none are wanted; if that leaves none, the others come back. Weights
    below zero and missing ones are the usual ones; the scale of years reaches three beyond those asked for, 8 at least.
    """
    row = lambda n: F.struct(F.lit(n).alias("criterion"), F.lit(CRITERIA[n][0]).alias("type"), F.when(F.col("weights")[n] >= 0, F.col("weights")[n]).otherwise(CRITERIA[n][1]).alias("weight"))
    every = F.filter(F.array(*[row(n) for n in CRITERIA]), lambda c: (c["criterion"] != "language") | (F.size("languages") > 0))
    enabled = F.filter("__all", lambda c: ~F.array_contains("disabled", c["criterion"]))
    used = parsed.withColumn("__all", every).withColumn("__on", enabled).withColumn("__on", F.when(F.size("__on") > 0, F.col("__on")).otherwise(F.col("__all")))
    scale = F.when(F.col("c.criterion") == "years", F.greatest(F.lit(8), F.col("min_years") + 3))
    return used.select(key, "min_years", F.explode("__on").alias("c")).select(key, "c.*", scale.alias("scale_max"))


def tier(weight: Column) -> Column:
    """0 (ignore) to 4 (essential) by weight."""
    out = F.when(weight <= TIER_ENDS[0], 0)
    for i, end in enumerate(TIER_ENDS[1:], 1):
        out = out.when(weight <= end, i)
    return out.otherwise(len(TIER_ENDS))


def axis(weight: Column) -> Column:
    """0 to 5, a tenth of the weight rounded half up."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.floor(weight / 10 + 0.5).cast("int")))


def tier_weight(level: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in TIER_WEIGHTS]), level)
