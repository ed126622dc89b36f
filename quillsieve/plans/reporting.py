"""Queries on requirements, kept selections and reports, with their SQL. Fixtures of literals show every rule once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import text
from ..operators import extraction, reports, requirements, scoring
from ..sources import store
from . import facts, screening

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REQUESTS = """(VALUES ('R1', '{"jobTitle": "tester", "minYears": 5.5, "requiredSkills": [" Python ", "SQL", "", 7], "languages": "anglictina, Deutsch; english / Klingon", "weights": {"skills": 40, "years": -1}, "disabled": ["tenure"]}'),
 ('R2', '{"minYears": "3", "languages": ["en", "fr", "es", "pl", "sk", "uk", "cs"], "disabled": ["years", "skills", "education", "language", "tenure", "certifications"]}'), ('R3', 'not json'), ('R4', '{"minYears": -2, "requiredSkills": "python"}'), ('R5', NULL)) AS r(id, request)"""


@query(
    """SELECT * FROM (VALUES ('R1', 'tester', 6, 'python|sql|7', 'anglictina|Deutsch|english|Klingon', 40.0::DOUBLE, 'tenure'), ('R2', '', 3, '', 'en|fr|es|pl|sk|uk|cs', NULL, 'years|skills|education|language|tenure|certifications'),
    ('R3', '', 0, '', '', NULL, ''), ('R4', '', 0, '', '', NULL, ''), ('R5', '', 0, '', '', NULL, '')) AS w(id, job_title, min_years, skills, languages, skills_weight, disabled)"""
)
def requirements_parsed(spark, sf):
    p = requirements.parse(spark.sql(f"SELECT * FROM {_REQUESTS}"))
    return p.select("id", "job_title", "min_years", F.array_join("required_skills", "|").alias("skills"), F.array_join("languages", "|").alias("languages"), F.col("weights")["skills"].alias("skills_weight"), F.array_join("disabled", "|").alias("disabled"))


@query(
    """SELECT r.id, r.place, coalesce(v.label_cs, r.language) AS language FROM (VALUES ('R1', 1, 'lang-en'), ('R1', 2, 'lang-de'), ('R1', 3, 'Klingon'), ('R2', 1, 'lang-en'), ('R2', 2, 'lang-fr'), ('R2', 3, 'lang-es'), ('R2', 4, 'lang-pl'), ('R2', 5, 'lang-sk')) AS r(id, place, language)
    LEFT JOIN ref_values v ON v.ref_id = r.language"""
)
def requirement_languages(spark, sf):
    """Each wanted language once, the first five, by its name."""
    p = requirements.parse(spark.sql(f"SELECT * FROM {_REQUESTS}"))
    labels = table(spark, sf, "ref_values").where("ref_kind = 'lang'").select(F.col("ref_id").alias("code"), F.col("label_cs").alias("label"))
    return requirements.language_list(p, "id", screening._forms(spark, sf), labels)


@query(
    """SELECT id, criterion, type, weight::DOUBLE AS weight, scale_max FROM (VALUES ('R1', 'years', 'numeric_scale', 25, 9), ('R1', 'skills', 'set_overlap', 40, NULL), ('R1', 'education', 'category_map', 15, NULL), ('R1', 'language', 'cefr_map', 10, NULL), ('R1', 'certifications', 'bonus', 10, NULL),
    ('R2', 'years', 'numeric_scale', 25, 8), ('R2', 'skills', 'set_overlap', 30, NULL), ('R2', 'education', 'category_map', 15, NULL), ('R2', 'language', 'cefr_map', 10, NULL), ('R2', 'tenure', 'tenure', 10, NULL), ('R2', 'certifications', 'bonus', 10, NULL)) AS w(id, criterion, type, weight, scale_max)
    UNION ALL SELECT id, criterion, type, weight::DOUBLE, scale_max FROM (VALUES ('R3'), ('R4'), ('R5')) AS i(id), (VALUES ('years', 'numeric_scale', 25, 8), ('skills', 'set_overlap', 30, NULL), ('education', 'category_map', 15, NULL), ('tenure', 'tenure', 10, NULL), ('certifications', 'bonus', 10, NULL)) AS c(criterion, type, weight, scale_max)"""
)
def requirement_criteria(spark, sf):
    """The criteria that each request builds."""
    return requirements.criteria(requirements.parse(spark.sql(f"SELECT * FROM {_REQUESTS}")), "id")


@query(
    """WITH r AS (SELECT job_id, unnest(from_json(json_extract(rubric_json, '$.criteria'), '[{"key":"VARCHAR","weight":"DOUBLE"}]')) AS c FROM job_requirements), w AS (SELECT job_id, c.key AS criterion, c.weight AS weight FROM r)
    SELECT job_id, criterion, CASE WHEN weight <= 0 THEN 0 WHEN weight <= 15 THEN 1 WHEN weight <= 25 THEN 2 WHEN weight <= 37 THEN 3 ELSE 4 END AS tier, CASE WHEN weight <= 0 THEN 0 WHEN weight <= 15 THEN 10 WHEN weight <= 25 THEN 20 WHEN weight <= 37 THEN 30 ELSE 45 END AS tier_weight,
    greatest(0, least(5, floor(weight / 10 + 0.5)::INT)) AS axis FROM w"""
)
def importances(spark, sf):
    """Weights as tiers and on an axis."""
    c = F.from_json(F.get_json_object("rubric_json", "$.criteria"), "array<struct<key:string,weight:double>>")
    r = table(spark, sf, "job_requirements").select("job_id", F.explode(c).alias("c")).select("job_id", F.col("c.key").alias("criterion"), F.col("c.weight").alias("weight"))
    return r.select("job_id", "criterion", requirements.tier(F.col("weight")).alias("tier"), requirements.tier_weight(requirements.tier(F.col("weight"))).alias("tier_weight"), requirements.axis(F.col("weight")).alias("axis"))


@query("SELECT DISTINCT language AS value, trim(regexp_replace(lower(strip_accents(language)), '\\s+', ' ', 'g')) AS name FROM q_languages WHERE language IS NOT NULL AND regexp_full_match(language, '[\\x{20}-\\x{7E}\\x{C0}-\\x{D6}\\x{D8}-\\x{DE}\\x{E0}-\\x{F6}\\x{F8}-\\x{10F}\\x{112}-\\x{125}\\x{139}-\\x{13E}\\x{143}-\\x{148}\\x{14C}-\\x{151}\\x{154}-\\x{165}\\x{168}-\\x{17E}]*') AND NOT regexp_matches(language, '[øØæÆðÐþÞ]')")
def normalized_names(spark, sf):
    """Typed names decomposed, without accents. SQL can only take accents off, so names with other letters are left to tests."""
    v = table(spark, sf, "q_languages").where("language IS NOT NULL").select(F.col("language").alias("value")).distinct()
    latin = r"^[\x{20}-\x{7E}\x{C0}-\x{D6}\x{D8}-\x{DE}\x{E0}-\x{F6}\x{F8}-\x{10F}\x{112}-\x{125}\x{139}-\x{13E}\x{143}-\x{148}\x{14C}-\x{151}\x{154}-\x{165}\x{168}-\x{17E}]*$"
    return v.where(F.col("value").rlike(latin) & ~F.col("value").rlike("[øØæÆðÐþÞ]")).select("value", text.norm_name(F.col("value")).alias("name"))


_KEPT = "(VALUES ('20260101-1000', TIMESTAMP '2026-01-01 10:00:00', TIMESTAMP '2026-01-31 10:00:00', false, 'a'), ('20260101-1000-2', TIMESTAMP '2026-01-01 10:00:01', TIMESTAMP '2026-01-05 00:00:00', false, 'b'), ('20260102-0900', TIMESTAMP '2026-01-02 09:00:00', NULL, true, 'c')) AS k(id, created, expires, closed, title)"
_NEW = "(VALUES ('20260101-1000', TIMESTAMP '2026-01-09 10:00:00', NULL, false, 'd'), ('20260101-1000', TIMESTAMP '2026-01-09 11:00:00', NULL, false, 'e'), ('20260303-0800', TIMESTAMP '2026-03-03 08:00:00', NULL, false, 'f'), ('20260303-0800', TIMESTAMP '2026-03-03 08:00:30', NULL, false, 'g')) AS n(id, created, expires, closed, title)"


@query("SELECT * FROM (VALUES ('a', '20260101-1000'), ('b', '20260101-1000-2'), ('c', '20260102-0900'), ('d', '20260101-1000-3'), ('e', '20260101-1000-4'), ('f', '20260303-0800'), ('g', '20260303-0800-2')) AS w(title, id)")
def selections_alongside(spark, sf):
    """Imported selections keep their ids or get the smallest free suffix."""
    return store.imported(spark.sql(f"SELECT * FROM {_KEPT}"), spark.sql(f"SELECT * FROM {_NEW}"), False).select("title", "id")


@query("SELECT * FROM (VALUES ('a', 22, false, true), ('b', -4, true, true), ('c', NULL, true, true)) AS w(title, days, locked, valid)")
def selection_states(spark, sf):
    """Days left, lock and valid ids of kept selections."""
    now = F.lit("2026-01-09 12:00:00").cast("timestamp")
    k = spark.sql(f"SELECT * FROM {_KEPT}")
    return k.select("title", store.days_left(F.col("expires"), now).cast("int").alias("days"), store.locked(F.col("closed"), F.col("expires"), now).alias("locked"), store.valid_id(F.col("id")).alias("valid"))


@query(
    f"""{screening._SCORED}, q AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, candidate_id) AS rank FROM z),
    u AS (SELECT job_id, candidate_id, total, rank, unnest([(-skills, 'skills'), (-education, 'education'), (-languages, 'languages'), (-breadth, 'breadth')]) AS c FROM q WHERE rank <= 5),
    o AS (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY c[1], c[2]) AS i FROM u) SELECT job_id, candidate_id, any_value(total) AS total, any_value(rank) AS rank, string_agg(c[2], ', ' ORDER BY i) FILTER (i <= 2) AS strongest FROM o GROUP BY 1, 2"""
)
def shortlists(spark, sf):
    """The five best of each job with their two strongest criteria: a top-k report."""
    s = screening._scored(spark, sf)
    each = s.select("candidate_id", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score"), F.lit(True).alias("known")) for c in ("skills", "education", "languages", "breadth")])).alias("b")).select("candidate_id", "b.*")
    return reports.shortlist(s, each, "candidate_id", "job_id")


@query(f"WITH c AS (SELECT f.candidate_id, s.job_id, count(*) AS n_flags FROM {screening._F} f JOIN {screening._S} s USING (scan_id) WHERE f.candidate_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n_flags DESC, candidate_id) AS place FROM c) SELECT job_id, candidate_id, n_flags, place FROM r WHERE place <= 8")
def most_flagged(spark, sf):
    """The eight candidates of each job with the most findings: a top-k report."""
    f = screening._flags(spark, sf).select("scan_id", "candidate_id").join(screening._scans(spark, sf, "job_id"), "scan_id")
    return reports.flagged(f, "candidate_id", "job_id")


@query(
    f"""WITH a AS (SELECT DISTINCT scan_id FROM {screening._F} WHERE detect_method = 'deterministic'), b AS (SELECT DISTINCT scan_id FROM {screening._F} WHERE detect_method = 'llm'), s AS (SELECT scan_id, coalesce(hidden_text, '') <> '' AS p FROM {screening._S}),
    g AS (SELECT scan_id, p, scan_id IN (SELECT scan_id FROM a WHERE scan_id IS NOT NULL) AS x, scan_id IN (SELECT scan_id FROM b WHERE scan_id IS NOT NULL) AS y FROM s WHERE scan_id IS NOT NULL)
    SELECT scan_id, CASE WHEN p AND NOT x AND NOT y THEN 'missed_by_both' WHEN p AND NOT x THEN 'missed_by_first' WHEN p THEN 'missed_by_second' ELSE 'false_positive' END AS gap FROM g WHERE CASE WHEN p THEN NOT (x AND y) ELSE x OR y END"""
)
def layer_misses(spark, sf):
    """Which records a layer of detection misses, and which clean ones are flagged."""
    f = screening._flags(spark, sf)
    truth = screening._scans(spark, sf, "hidden_text").where("scan_id IS NOT NULL").select("scan_id", (F.coalesce("hidden_text", F.lit("")) != "").alias("poisoned"))
    return reports.layers(f.where("detect_method = 'deterministic'"), f.where("detect_method = 'llm'"), truth, "scan_id")


@query("SELECT dual_path_status AS status, count(*) AS n, count(*) FILTER (qualification_json IS NOT NULL) AS n_answers FROM (SELECT DISTINCT extraction_id, dual_path_status, qualification_json FROM extractions) GROUP BY 1")
def path_statuses(spark, sf):
    """How the two ways of reading a document agree, as it is recorded with each extraction."""
    e = table(spark, sf, "extractions").select("extraction_id", "dual_path_status", "qualification_json").dropDuplicates(["extraction_id"])
    return e.groupBy(F.col("dual_path_status").alias("status")).agg(F.count("*").alias("n"), F.count("qualification_json").alias("n_answers"))


@query(
    f"""WITH v AS (SELECT scan_id, md5(visible_text) AS h FROM {screening._S} WHERE visible_text <> ''), w AS (SELECT flag_id, scan_id, md5(evidence) AS h FROM {screening._F} WHERE evidence <> '')
    SELECT CASE WHEN v.scan_id IS NULL THEN 'render_only' WHEN w.scan_id IS NULL THEN 'text_only' WHEN v.h = w.h THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM v FULL JOIN w ON v.scan_id = w.scan_id GROUP BY 1"""
)
def compared_paths(spark, sf):
    """Two texts of each document compared by content."""
    v = screening._scans(spark, sf, "visible_text").where("visible_text <> ''").select("scan_id", F.md5("visible_text").alias("a"))
    w = screening._flags(spark, sf).where("evidence <> ''").select(F.col("scan_id").alias("other"), F.md5("evidence").alias("b"))
    status = F.when(F.col("scan_id").isNull(), "render_only").when(F.col("other").isNull(), "text_only").when(F.col("a") == F.col("b"), "match").otherwise("mismatch")
    return v.join(w, F.col("scan_id") == F.col("other"), "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT DISTINCT extraction_id, candidate_id, model, extracted_at FROM extractions WHERE candidate_id IS NOT NULL) SELECT candidate_id, model, arg_max(extraction_id, (extracted_at, extraction_id)) AS extraction_id FROM e GROUP BY 1, 2")
def last_extractions(spark, sf):
    """Of several extractions by one model of a candidate the last."""
    e = table(spark, sf, "extractions").where("candidate_id IS NOT NULL").select("candidate_id", "model", "extraction_id", F.struct("extracted_at", "extraction_id").alias("at")).dropDuplicates(["extraction_id"])
    return reports.last_per_name(e, "candidate_id", "model", "at").select("candidate_id", "model", "extraction_id")


@query(
    facts.SQL["score_breakdown"].replace("SELECT extraction_id, 'years' AS criterion", "SELECT criterion, CASE WHEN NOT known THEN 'not evidenced' WHEN score >= 7.5 THEN 'strong' WHEN score >= 4 THEN 'partial' ELSE 'weak' END AS state_label, CASE basis WHEN 'stated' THEN 'stated in the document' WHEN 'inferred' THEN 'inferred, to be checked' ELSE 'not stated' END AS certainty, count(*) AS n FROM (SELECT extraction_id, 'years' AS criterion", 1)
    + ") GROUP BY 1, 2, 3"
)
def criterion_views(spark, sf):
    """States and certainties of the criteria of all answers."""
    q = facts._answers(spark, sf).select("extraction_id", "q")
    b = scoring.breakdown(q, "extraction_id", {"years": 25.0, "skills": 30.0, "education": 15.0, "tenure": 10.0, "certifications": 10.0}, facts._REQUIRED, facts._EDU)
    return reports.view(b).groupBy("criterion", "state_label", "certainty").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT DISTINCT extraction_id, candidate_id, identity_info.emails AS m, identity_info.phones AS p FROM extractions), x AS (SELECT candidate_id, extraction_id, coalesce(len(m), 0) + coalesce(len(p), 0) > 0 AS c FROM e WHERE extraction_id IS NOT NULL) SELECT c AS is_candidate, count(*) AS n FROM x GROUP BY 1")
def applicants(spark, sf):
    """Extractions that speak of an applicant by their contacts alone."""
    e = table(spark, sf, "extractions").where("extraction_id IS NOT NULL").select("extraction_id", "identity_info.emails", "identity_info.phones").dropDuplicates(["extraction_id"])
    none = F.array().cast("array<string>")
    c = extraction.is_candidate(none, F.coalesce("emails", none), F.coalesce("phones", none), none)
    return e.groupBy(c.alias("is_candidate")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (severity = 'critical') AS n_critical, (SELECT CASE WHEN count(*) FILTER (NOT coalesce(ok, false)) > 0 THEN 2 ELSE 1 END FROM {screening._S}) AS code FROM {screening._F}")
def run_code(spark, sf):
    """The code that a run over all documents ends with."""
    return reports.exit_code(screening._flags(spark, sf), screening._scans(spark, sf, "ok"))


@query(screening.SQL["detector_quality"].replace("SELECT round(avg(flagged", "SELECT *, detection_recall >= 0.98 AND containment_recall >= 0.98 AND false_positive_rate <= 0.10 AS passed FROM (SELECT round(avg(flagged", 1) + ")")
def quality_gate(spark, sf):
    """Detector quality with whether it meets its bounds."""
    return reports.passed(screening.detector_quality(spark, sf))
