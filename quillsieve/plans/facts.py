"""Queries on extracted facts: coercion, merging, and scores of whole answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..operators import extraction, scoring

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _answers(spark, sf):
    """Each extraction once, sanitized; redelivered rows have the same content."""
    e = table(spark, sf, "extractions").select("extraction_id", "candidate_id", "scan_id", "qualification_json").where("extraction_id IS NOT NULL").dropDuplicates(["extraction_id"])
    return extraction.sanitized(e)


_BASE = r"""x AS (SELECT extraction_id, any_value(candidate_id) AS candidate_id, any_value(qualification_json) AS raw FROM extractions WHERE extraction_id IS NOT NULL GROUP BY 1),
    b AS (SELECT extraction_id, candidate_id, regexp_extract(trim(regexp_replace(regexp_replace(raw, '^\s*```[A-Za-z]*\s*', '', 's'), '\s*```\s*$', '', 's')), '(\{.*\})', 1, 's') AS j FROM x),
    v AS (SELECT extraction_id, candidate_id, CASE WHEN j <> '' AND json_valid(j) THEN j::JSON END AS j FROM b),
    a AS (SELECT extraction_id, candidate_id, j, CASE WHEN json_type(j, '$.qualification') = 'OBJECT' THEN json_extract(j, '$.qualification') ELSE j END AS q FROM v)"""


def _items(block: str) -> str:
    return f"SELECT extraction_id, candidate_id, unnest(json_extract(q, '$.{block}[*]')) AS e, unnest(range(len(json_extract(q, '$.{block}[*]')))) AS ord FROM a WHERE json_type(q, '$.{block}') = 'ARRAY'"


def _str(e: str, path: str) -> str:
    return f"CASE WHEN json_type({e}, '$.{path}') = 'VARCHAR' THEN json_extract_string({e}, '$.{path}') END"


_NAME = lambda member: f"coalesce(CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END, {_str('e', member)}, '')"
_YEARS = "CASE WHEN json_type(q, '$.years_total_experience') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(q, '$.years_total_experience')::DOUBLE END"
_COUNTED = f"""WITH {_BASE}, k AS ({_items('skills')}), l AS ({_items('languages')}), c AS ({_items('certifications')})"""


@query(
    f"""{_COUNTED} SELECT extraction_id, j IS NOT NULL AS readable, {_YEARS} AS years, coalesce(CASE WHEN json_type(q, '$.experience') = 'ARRAY' THEN json_array_length(q, '$.experience') END, 0)::BIGINT AS n_experience,
    coalesce((SELECT string_agg({_NAME('name')}, '|' ORDER BY ord) FROM k WHERE k.extraction_id = a.extraction_id AND {_NAME('name')} <> ''), '') AS skills,
    coalesce((SELECT string_agg({_NAME('language')}, '|' ORDER BY ord) FROM l WHERE l.extraction_id = a.extraction_id AND {_NAME('language')} <> ''), '') AS languages,
    (SELECT count(*) FROM c WHERE c.extraction_id = a.extraction_id AND {_NAME('name')} <> '') AS n_certifications FROM a"""
)
def sanitized_answers(spark, sf):
    """Soft validation of whole answers."""
    a = _answers(spark, sf)
    names = lambda block, member: F.array_join(F.transform(f"q.{block}", lambda s: s[member]), "|")
    return a.select("extraction_id", "readable", "q.years", F.size("q.experience").cast("long").alias("n_experience"), names("skills", "name").alias("skills"), names("languages", "language").alias("languages"), F.size("q.certifications").cast("long").alias("n_certifications"))


@query(
    f"""WITH {_BASE}, e AS ({_items('education')}) SELECT extraction_id, ord::BIGINT AS ord, coalesce(CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END, {_str('e', 'level')}, 'other') AS level, {_str('e', 'field')} AS field,
    CASE WHEN json_type(e, '$.year') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(e, '$.year')::DOUBLE END AS year FROM e"""
)
def sanitized_education(spark, sf):
    """Entries that may be strings, objects or anything else."""
    return _answers(spark, sf).select("extraction_id", F.posexplode("q.education").alias("ord", "e")).select("extraction_id", F.col("ord").cast("long").alias("ord"), "e.*")


@query(
    f"""WITH {_BASE}, s AS (SELECT *, lower(trim({_NAME('name')})) AS k, {_NAME('name')} AS name FROM ({_items('skills')}) WHERE candidate_id IS NOT NULL)
    SELECT candidate_id, arg_min(name, (extraction_id, ord)) AS skill FROM s WHERE k <> '' GROUP BY candidate_id, k"""
)
def merged_answer_skills(spark, sf):
    """Each candidate's skills over all documents, by first spelling."""
    return extraction.merged_lists(_answers(spark, sf), "candidate_id", "extraction_id", "skills", lambda i: i["name"]).select("candidate_id", F.col("item.name").alias("skill"))


@query(
    f"""{_COUNTED}, n AS (SELECT candidate_id, greatest(max({_YEARS}), CASE WHEN max({_YEARS}) IS NOT NULL THEN 0.0 END)::DOUBLE AS years,
      """ + ", ".join(f"sum(coalesce(CASE WHEN json_type(q, '$.{b}') = 'ARRAY' THEN json_array_length(q, '$.{b}') END, 0))::BIGINT AS n_{b}" for b in ("experience", "education")) + f""" FROM a WHERE candidate_id IS NOT NULL GROUP BY 1)
    SELECT n.*, (SELECT count(*) FROM l WHERE l.candidate_id = n.candidate_id AND {_NAME('language')} <> '') AS n_languages, (SELECT count(DISTINCT lower(trim({_NAME('name')}))) FROM k WHERE k.candidate_id = n.candidate_id AND trim({_NAME('name')}) <> '') AS n_skills,
    (SELECT count(DISTINCT lower(trim({_NAME('name')}))) FROM c WHERE c.candidate_id = n.candidate_id AND trim({_NAME('name')}) <> '') AS n_certifications FROM n"""
)
def merged_qualifications(spark, sf):
    return extraction.merged(_answers(spark, sf), "candidate_id", "extraction_id")


@query(
    """WITH i AS (SELECT candidate_id, extraction_id, 'emails' AS field, unnest(identity_info.emails) AS item, unnest(range(len(identity_info.emails))) AS ord FROM extractions WHERE candidate_id IS NOT NULL
      UNION ALL SELECT candidate_id, extraction_id, 'phones', unnest(identity_info.phones), unnest(range(len(identity_info.phones))) FROM extractions WHERE candidate_id IS NOT NULL)
    SELECT candidate_id, field, arg_min(trim(item), (extraction_id, ord)) AS item FROM i WHERE trim(item) <> '' GROUP BY candidate_id, field, lower(trim(item))"""
)
def merged_contacts(spark, sf):
    """Each candidate's addresses and numbers once."""
    i = table(spark, sf, "extractions").select("candidate_id", "extraction_id", "identity_info.*")
    parts = [extraction.merged_contacts(i, "candidate_id", "extraction_id", f).select("candidate_id", F.lit(f).alias("field"), "item") for f in ("emails", "phones")]
    return parts[0].unionByName(parts[1])


@query(
    """WITH s AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM scans WHERE candidate_id IS NOT NULL) SELECT candidate_id, count(*) AS n_documents, sum(length(coalesce(visible_text, '')))::BIGINT AS visible_chars, sum(length(coalesce(hidden_text, '')))::BIGINT AS hidden_chars,
    count(*) FILTER (ok) AS n_ok, arg_min(error_note, scan_id) FILTER (trim(error_note) <> '') AS first_error, coalesce(string_agg(DISTINCT error_note, '; ' ORDER BY error_note) FILTER (trim(error_note) <> ''), '') AS notes FROM s GROUP BY 1"""
)
def candidate_totals(spark, sf):
    s = table(spark, sf, "scans").select("scan_id", "candidate_id", "visible_text", "hidden_text", "ok", "error_note").dropDuplicates(["scan_id"])
    return extraction.totals(s, "candidate_id", "scan_id")


# Points by level, weights of the criteria and the scale of years, by hand: parameters of the query.
_EDU = {"secondary": 5.0, "bachelor": 7.0, "master": 10.0, "phd": 10.0, "course": 4.0, "other": 2.0}
_REQUIRED = ["python", "sql", "docker"]
_POINTS_SQL = "CASE lower(trim(level)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _EDU.items()) + " ELSE 0.0 END"


@query(
    f"""WITH {_BASE}, s AS (SELECT extraction_id, lower(trim({_NAME('name')})) AS n, {_str('e', 'evidence')} AS ev FROM ({_items('skills')}) WHERE trim({_NAME('name')}) <> ''),
    d AS (SELECT extraction_id, coalesce(CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') END, {_str('e', 'level')}, 'other') AS level FROM ({_items('education')})),
    m AS (SELECT extraction_id, avg(CASE WHEN json_type(e, '$.months') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(e, '$.months')::DOUBLE END) AS months FROM ({_items('experience')}) GROUP BY 1),
    h AS (SELECT extraction_id, count(DISTINCT w) AS hits, bool_or(coalesce(ev, '') <> '') AS said FROM s JOIN (SELECT unnest({_REQUIRED}) AS w) ON contains(n, w) OR contains(w, n) GROUP BY 1),
    c AS (SELECT extraction_id, count(*) AS n FROM ({_items('certifications')}) WHERE {_NAME('name')} <> '' GROUP BY 1), g AS (SELECT extraction_id, max({_POINTS_SQL})::DOUBLE AS p FROM d GROUP BY 1),
    t AS (SELECT a.extraction_id, {_YEARS} AS years, coalesce(hits, 0) AS hits, coalesce(said, false) AS said, p, months, coalesce(c.n, 0) AS certs FROM a LEFT JOIN h USING (extraction_id) LEFT JOIN g USING (extraction_id) LEFT JOIN m USING (extraction_id) LEFT JOIN c USING (extraction_id))
    SELECT extraction_id, 'years' AS criterion, CASE WHEN years IS NULL THEN 5.0 ELSE greatest(0.0, least(1.0, years / 8)) * 10 END AS score, years IS NOT NULL AS known, CASE WHEN years IS NULL THEN 'unknown' ELSE 'stated' END AS basis FROM t
    UNION ALL SELECT extraction_id, 'skills', hits * 10.0::DOUBLE / 3, true, CASE WHEN said THEN 'stated' ELSE 'inferred' END FROM t
    UNION ALL SELECT extraction_id, 'education', coalesce(p, 0), p IS NOT NULL, CASE WHEN p IS NULL THEN 'unknown' ELSE 'stated' END FROM t
    UNION ALL SELECT extraction_id, 'tenure', CASE WHEN months IS NULL THEN 5.0 ELSE greatest(0.0, least(1.0, (months - 6) / 18)) * 10 END, months IS NOT NULL, CASE WHEN months IS NULL THEN 'unknown' ELSE 'stated' END FROM t
    UNION ALL SELECT extraction_id, 'certifications', least(certs * 2.0, 10.0), true, 'stated' FROM t"""
)
def score_breakdown(spark, sf):
    """Scores of whole answers, a row per criterion, with whether it is known and stated."""
    q = _answers(spark, sf).select("extraction_id", "q")
    return scoring.breakdown(q, "extraction_id", {"years": 25.0, "skills": 30.0, "education": 15.0, "tenure": 10.0, "certifications": 10.0}, _REQUIRED, _EDU).select("extraction_id", "criterion", F.round("score", 9).alias("score"), "known", "basis")
