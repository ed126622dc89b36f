"""Matching: skills by containment, languages by name, levels by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Words beside a language's name, folded.
LANGUAGE_STOP = ("jazyk", "language", "sprache", "langue", "idioma", "jezyk")
STEM = 4
#: Level rules in order (pattern on the folded phrase, level, whether it is stated, source). Of a range the
#: lower level counts, so tokens ascend; the rules after the scales are for German phrases.
LEVEL_RULES = (
    *[(rf"(?<![a-z0-9]){t.lower()}(?![a-z0-9])", t, True, "CEFR token") for t in ("A1", "A2", "B1", "B2", "C1", "C2")],
    ("native|mother ?tongue|bilingual|rodil|matersk|materstin|rodny jazyk", "native", True, "native"),
    ("full professional|pln[ae] profes", "C2", False, "ILR"),
    ("professional working|profesional|profesn|umoznujici profes", "C1", False, "ILR"),
    ("fluent|plynul|plynne|temer rodil", "C1", False, "fluent"),
    ("limited working|upper[- ]?intermediate|vyssi (?:stredn|pokro)", "B2", False, "ILR"),
    ("(?:mirne|stredne) pokrocil|intermediate|conversational|konverzac|komunikativn|domluv", "B1", False, "intermediate"),
    ("advanced|pokrocil", "B2", False, "advanced"),
    ("elementary|zaklad|basic", "A2", False, "elementary"),
    ("beginner|zacatecnik", "A1", False, "beginner"),
    ("muttersprach", "native", True, "native"),
    ("verhandlungssicher|fliessend|fließend", "C1", False, "fluent"),
    ("gute kenntnisse|fortgeschritten", "B2", False, "advanced"),
    ("mittelstufe|konversation", "B1", False, "intermediate"),
    ("grundkenntnisse", "A2", False, "elementary"),
    ("anfanger", "A1", False, "beginner"),
)
#: Rank and group of each level, and points of a level out of ten.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2", "native")
LEVEL_POINTS = {"A1": 0.0, "A2": 0.0, "B1": 4.0, "B2": 7.0, "C1": 9.0, "C2": 10.0, "native": 10.0}


def has_skill(have: Column, wanted: Column) -> Column:
    """Whether either folded name holds the other; empty names match nothing."""
    return (F.length(have) > 0) & (F.length(wanted) > 0) & (F.contains(have, wanted) | F.contains(wanted, have))


def skill_overlap(have: DataFrame, wanted: list[str], key: str, name: str) -> DataFrame:
    """(key, hits, missing, score): of the wanted skills those that any of a key's names matches, the others, and ten times
    the share of hits. wanted is a short list of parameters; names are folded, then gathered once each per key."""
    folded = F.array(*[fold(F.lit(w)) for w in wanted])
    sets = have.groupBy(key).agg(F.collect_set(fold(F.col(name))).alias("names"))
    hit = lambda w: F.exists("names", lambda h: has_skill(h, w))
    got = F.filter(folded, hit)
    lost = F.filter(folded, lambda w: ~hit(w))
    return sets.select(key, F.array_join(F.array_sort(got), ",").alias("hits"), F.array_join(F.array_sort(lost), ",").alias("missing"), F.round(F.size(got) * 10.0 / len(wanted), 4).alias("score"))


def language_codes(values: DataFrame, dictionary: DataFrame, value: str) -> DataFrame:
    """(value, code): distinct typed names with the language they name, null without one.

    dictionary: code, form, ord. An exact folded form wins, then a form beginning with the first word of at least four
    letters (stop words removed) or the other way round; of several the first of the dictionary. The dictionary is a short
    reference list and is broadcast.
    """
    v = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    words = F.filter(F.split(fold(F.col("value")), " "), lambda w: ~w.isin(*LANGUAGE_STOP) & (w != ""))
    v = v.select("value", fold(F.col("value")).alias("f"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("w"))
    d = F.broadcast(dictionary.select("code", fold(F.col("form")).alias("form"), "ord").where("form <> ''"))
    exact = v.join(d, F.col("f") == F.col("form")).select("value", "code", F.lit(0).alias("phase"), "ord")
    prefix = d.where(F.length("form") >= STEM).select("code", "form", "ord", F.substring("form", 1, STEM).alias("stem"))
    near = (
        v.where(F.length("w") >= STEM).withColumn("stem", F.substring("w", 1, STEM)).join(prefix, "stem").where(F.startswith("form", F.col("w")) | F.startswith("w", F.col("form")))
        .select("value", "code", F.lit(1).alias("phase"), "ord")
    )
    best = exact.unionByName(near).groupBy("value").agg(F.min_by("code", F.struct("phase", "ord")).alias("code"))
    return v.select("value").join(best, "value", "left")


def level_of(phrase: Column) -> Column:
    """struct(level, matched, stated, source): the first rule that a phrase meets and what it matched of the folded phrase;
    null members and stated false without one. Fold the phrase once before, where it is used more than once."""
    f = fold(phrase)
    out = None
    for rx, name, said, source in LEVEL_RULES:
        hit = F.struct(F.lit(name).alias("level"), F.regexp_extract(f, rx, 0).alias("matched"), F.lit(said).alias("stated"), F.lit(source).alias("source"))
        out = F.when(f.rlike(rx), hit) if out is None else out.when(f.rlike(rx), hit)
    none = F.lit(None).cast("string")
    return out.otherwise(F.struct(none.alias("level"), none.alias("matched"), F.lit(False).alias("stated"), none.alias("source")))


def level_rank(level: Column) -> Column:
    """1 (A1) to 7 (native); null for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0))


def level_group(level: Column) -> Column:
    """Basic, Independent or Proficient user, or Native."""
    return F.when(level == "native", "Native").when(F.startswith(level, F.lit("A")), "Basic").when(F.startswith(level, F.lit("B")), "Independent").when(F.startswith(level, F.lit("C")), "Proficient")


def same_language(values: DataFrame, wanted: list[str], dictionary: DataFrame, value: str) -> DataFrame:
    """(value, wanted): the distinct typed names that mean a wanted language. Two known names do if their codes are equal;
    if either is unknown, the folded names must be equal, or one of at least four letters must begin the other. Part of a
    name never counts. wanted is a short list of parameters."""
    spark = values.sparkSession
    asked = F.broadcast(language_codes(spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "value string"), dictionary, "value").select(F.col("value").alias("wanted"), F.col("code").alias("wanted_code"), fold(F.col("value")).alias("g")))
    typed = language_codes(values, dictionary, value).withColumn("f", fold(F.col("value")))
    begins = lambda a, b: (F.length(a) >= STEM) & F.startswith(F.col(b), F.col(a))
    named = (F.col("f") != "") & (F.col("g") != "") & ((F.col("f") == F.col("g")) | begins("f", "g") | begins("g", "f"))
    both = F.col("code").isNotNull() & F.col("wanted_code").isNotNull()
    return typed.join(asked, F.when(both, F.col("code") == F.col("wanted_code")).otherwise(named)).select("value", "wanted")


def language_score(langs: DataFrame, wanted: list[str], dictionary: DataFrame, key: str) -> DataFrame:
    """(key, score, known, basis) of the wanted languages.

    langs: key, language, level_raw, level, ord. Of each wanted language the best points among its rows with a known level
    count (level_raw before level; of equal points the first), none counts 0; the score is their mean over all wanted. It
    is known if any is, and stated if all known ones are, else inferred. Keys without a row have none.
    """
    phrase = langs.select(key, "ord", F.col("language").alias("value"), fold(F.coalesce("level_raw", "level")).alias("phrase")).where(F.col(key).isNotNull())
    same = same_language(langs.select("language"), wanted, dictionary, "language")  # a row per name, so a frequent name is split by the planner
    points = F.create_map(*[F.lit(x) for kv in LEVEL_POINTS.items() for x in kv])
    met = phrase.join(same, "value").withColumn("l", level_of(F.col("phrase"))).where("l.level IS NOT NULL")
    best = met.groupBy(key, "wanted").agg(F.max(F.struct(points[F.col("l.level")].alias("p"), (-F.col("ord")).alias("o"), F.col("l.stated").alias("stated"))).alias("b"))
    per = best.groupBy(key).agg((F.sum("b.p") / len(dict.fromkeys(wanted))).alias("score"), F.bool_and("b.stated").alias("stated"))
    every = phrase.select(key).distinct().join(per, key, "left")
    return every.select(key, F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNotNull().alias("known"), F.when(F.col("score").isNull(), "unknown").when(F.col("stated"), "stated").otherwise("inferred").alias("basis"))
