"""A model's answers as typed facts: coerced member by member, merged over a candidate's documents, kept from run to run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_type
from .validation import unfence

#: Characters of a text that a model is given, and of its answer that is kept.
PROMPT_CHARS, ANSWER_CHARS = 12_000, 2_000


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(_kind(x) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    x = F.try_variant_get(v, path, "variant")
    return F.when(_kind(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, path, "double"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _own(v: Column) -> Column:
    """A string entry itself, null for other types."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def answer(raw: Column) -> Column:
    """The JSON of an answer, out of its fence or prose; null for unreadable ones."""
    return F.try_parse_json(unfence(raw))


def _inner(v: Column, name: str) -> Column:
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.coalesce(_kind(inner).startswith("OBJECT"), F.lit(False)), inner).otherwise(v)


def qualification(v: Column) -> Column:
    """The qualification of an answer, in it or under its member of that name: known members only, never an error.

    Strings that aren't strings and numbers that aren't finite numbers (also numbers as text) are null, lists that aren't
    lists are empty. Skills, languages and certifications may be strings or objects and need a name; an education without
    a level has the level other; an experience without a title has an empty one. An unreadable answer has empty lists.
    """
    q = _inner(v, "qualification")
    experience = lambda e: F.struct(F.coalesce(_string(e, "$.title"), F.lit("")).alias("title"), _string(e, "$.employer").alias("employer"), _number(e, "$.months").alias("months"), _string(e, "$.seniority").alias("seniority"))
    skill = lambda e: F.struct(F.coalesce(_own(e), _string(e, "$.name"), F.lit("")).alias("name"), _string(e, "$.category").alias("category"), _string(e, "$.level").alias("level"), _string(e, "$.evidence").alias("evidence"))
    education = lambda e: F.struct(F.coalesce(_own(e), _string(e, "$.level"), F.lit("other")).alias("level"), _string(e, "$.field").alias("field"), _number(e, "$.year").alias("year"))
    language = lambda e: F.struct(F.coalesce(_own(e), _string(e, "$.language"), F.lit("")).alias("language"), _string(e, "$.level_raw").alias("level_raw"), _string(e, "$.level").alias("level"))
    return F.struct(
        _number(q, "$.years_total_experience").alias("years"), F.transform(_items(q, "$.experience"), experience).alias("experience"),
        F.filter(F.transform(_items(q, "$.skills"), skill), lambda s: s["name"] != "").alias("skills"), F.transform(_items(q, "$.education"), education).alias("education"),
        F.filter(F.transform(_items(q, "$.languages"), language), lambda s: s["language"] != "").alias("languages"),
        F.filter(F.transform(_items(q, "$.certifications"), lambda c: F.coalesce(_own(c), _string(c, "$.name"), F.lit(""))), lambda c: c != "").alias("certifications"),
    )


def identity(v: Column) -> Column:
    """The identity of an answer, coerced in the same way; it is shown and never scored."""
    i = _inner(v, "identity")
    listed = lambda name: F.filter(F.transform(_items(i, f"$.{name}"), _own), lambda s: F.coalesce(s, F.lit("")) != "").alias(name)
    return F.struct(_string(i, "$.full_name").alias("full_name"), listed("emails"), listed("phones"), listed("links"), _string(i, "$.location").alias("location"))


def type_of(v: Column) -> Column:
    """The document's type as the answer has it; a cv where it has none."""
    return document_type(_string(v, "$.document_type"))


def sanitized(answers: DataFrame, raw: str = "qualification_json") -> DataFrame:
    """Adds readable, q, who and doc_type to answers; each answer is parsed once."""
    v = answers.withColumn("__v", answer(F.col(raw)))
    return v.withColumn("readable", F.col("__v").isNotNull()).withColumn("q", qualification(F.col("__v"))).withColumn("who", identity(F.col("__v"))).withColumn("doc_type", type_of(F.col("__v"))).drop("__v")


def merged_lists(answers: DataFrame, key: str, order: str, block: str, name: Callable[[Column], Column] | None) -> DataFrame:
    """(key, order, ord, item): the entries of one block over all of a key's documents, in order. With ``name`` each name
    once, whatever its case, as it came first; blank names count for nothing. No list is gathered: rows meet by (key, name)."""
    rows = answers.where(F.col(key).isNotNull()).select(key, order, F.posexplode(F.col(f"q.{block}")).alias("ord", "item"))
    if name is None:
        return rows
    named = rows.withColumn("__name", F.lower(F.trim(name(F.col("item"))))).where("__name <> ''")
    first = named.groupBy(key, "__name").agg(F.min(F.struct(order, "ord", "item")).alias("r"))
    return first.select(key, f"r.{order}", "r.ord", "r.item")


def merged(answers: DataFrame, key: str, order: str) -> DataFrame:
    """(key, years, n_experience, n_education, n_languages, n_skills, n_certifications): a key's documents as one. Years are
    the largest known, 0 at least; skills and certifications count once by name, the others all."""
    known = answers.where(F.col(key).isNotNull())
    sizes = known.groupBy(key).agg(F.greatest(F.max("q.years"), F.when(F.max("q.years").isNotNull(), F.lit(0.0))).alias("years"), *[F.sum(F.size(f"q.{b}")).alias(f"n_{b}") for b in ("experience", "education", "languages")])
    count = lambda b, n: merged_lists(known, key, order, b, n).groupBy(key).agg(F.count("*").alias(f"n_{b}"))
    out = sizes.join(count("skills", lambda i: i["name"]), key, "left").join(count("certifications", lambda i: i), key, "left")
    return out.na.fill(0, ["n_skills", "n_certifications"])


def merged_contacts(identities: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """(key, item): a key's addresses, numbers or links, each once whatever its case, as it came first."""
    rows = identities.where(F.col(key).isNotNull()).select(key, order, F.posexplode(F.col(field)).alias("ord", "item")).withColumn("item", F.trim("item")).where("item <> ''")
    return rows.groupBy(key, F.lower("item").alias("__name")).agg(F.min(F.struct(order, "ord", "item")).alias("r")).select(key, "r.item")


def totals(documents: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n_documents, visible_chars, hidden_chars, n_ok, first_error, notes) of a key's documents.

    documents: key, order, visible_text, hidden_text, ok, error_note. first_error is that of the first failed one; notes
    are the distinct ones, in alphabetical order."""
    size = lambda c: F.sum(F.length(F.coalesce(c, F.lit(""))))
    note = F.when(F.trim("error_note") != "", F.col("error_note"))
    return documents.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n_documents"), size("visible_text").alias("visible_chars"), size("hidden_text").alias("hidden_chars"), F.count_if("ok").alias("n_ok"),
        F.min_by(note, F.when(note.isNotNull(), F.col(order))).alias("first_error"), F.array_join(F.array_sort(F.collect_set(note)), "; ").alias("notes"),
    )


def is_candidate(doc_types: Column, emails: Column, phones: Column, experience: Column) -> Column:
    """Whether documents speak of an applicant: a cv or letter among them, any contact, or any experience."""
    return F.exists(doc_types, lambda t: t.isin("cv", "cover_letter")) | (F.size(emails) > 0) | (F.size(phones) > 0) | (F.size(experience) > 0)


def cache_key(name: Column, size: Column, model: str, method: str, prompt: str) -> Column:
    """The key under which an extraction is kept: it changes with the file, the model, the method and the instruction."""
    return F.sha2(F.concat_ws("|", name, size.cast("string"), F.lit(model), F.lit(method), F.sha2(F.lit(prompt), 256)), 256)


def extract(texts: DataFrame, answers: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): the texts joined with the kept answers (key, raw), sanitized, and those that a model must be asked
    for, cut to ``PROMPT_CHARS``. Kept answers are a table, so tests and reruns need no model."""
    hits = sanitized(texts.join(answers.select(key, F.col("raw").alias("qualification_json")), key)).withColumn("raw", F.substring("qualification_json", 1, ANSWER_CHARS))
    misses = texts.join(answers.select(key), key, "left_anti").withColumn("prompt", F.substring(F.coalesce(F.col(text), F.lit("")), 1, PROMPT_CHARS))
    return hits, misses


def derived(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Requirements that a model derived from an advert: as ``requirements.parse`` reads them, at most twelve skills, the
    years asked for kept apart (asked_years) and demanded of nobody (min_years 0)."""
    from .requirements import parse

    p = parse(answers, raw)
    return p.withColumns({"asked_years": F.col("min_years"), "min_years": F.lit(0), "required_skills": F.slice("required_skills", 1, 12)})
