"""Queries on documents, findings and typed facts, each with the SQL that it must agree with."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import newest, table
from ..functions import color, text
from ..operators import findings, matching, scoring, validation, visibility

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The skills that the overlap queries ask for; a parameter.
WANTED = ["Python", "SQL", "Docker", "Kubernetes", "Java"]
#: Bytes that one candidate's documents may have together; a parameter.
BUDGET = 600_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return findings.distinct_findings(table(spark, sf, "flags"))


def _scans(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "scans").select("scan_id", *columns).dropDuplicates(["scan_id"])


_F = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM flags)"
_S = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM scans)"


def _fold_sql(c: str) -> str:
    return rf"trim(regexp_replace(translate(lower({c}), '{text.ACCENTED}', '{text.PLAIN}'), '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"


@query(f"SELECT flag_type, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warn') AS n_warn, count(*) FILTER (severity = 'info') AS n_info, count(*) AS n_all, count(DISTINCT scan_id) AS n_scans FROM {_F} GROUP BY 1")
def findings_by_type(spark, sf):
    return findings.totals(_flags(spark, sf), "flag_type")


@query(f"SELECT candidate_id, ['clean', 'info', 'warn', 'critical'][max({_RANK}) + 1] AS worst, count(*) AS n_flags FROM {_F} GROUP BY 1")
def worst_severity(spark, sf):
    return findings.worst(_flags(spark, sf), "candidate_id")


@query(
    f"""WITH s AS {_S}, f AS (SELECT scan_id, max({_RANK}) AS r, count(*) AS n, count(*) FILTER (severity = 'critical') AS c FROM {_F} GROUP BY 1),
    d AS (SELECT s.job_id, s.candidate_id, s.scan_id, coalesce(f.r, 0) AS r, coalesce(f.n, 0) AS n, coalesce(f.c, 0) AS c FROM s LEFT JOIN f USING (scan_id)),
    p AS (SELECT job_id, candidate_id, count(*) AS docs, count(*) FILTER (n > 0) AS hit, sum(c) AS crit, max(r) AS r FROM d GROUP BY 1, 2)
    SELECT job_id, count(*) AS candidates, sum(docs)::BIGINT AS documents, sum(hit)::BIGINT AS documents_with_findings, sum(crit)::BIGINT AS n_critical, count(*) FILTER (r = 0) AS clean_candidates FROM p GROUP BY 1"""
)
def batch_overview(spark, sf):
    per_scan = _flags(spark, sf).groupBy("scan_id").agg(F.max(findings.severity_rank(F.col("severity"))).alias("r"), F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("c"))
    d = _scans(spark, sf, "job_id", "candidate_id").join(per_scan, "scan_id", "left").na.fill(0, ["r", "n", "c"])
    p = d.groupBy("job_id", "candidate_id").agg(F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("hit"), F.sum("c").alias("crit"), F.max("r").alias("r"))
    return p.groupBy("job_id").agg(F.count("*").alias("candidates"), F.sum("docs").alias("documents"), F.sum("hit").alias("documents_with_findings"), F.sum("crit").alias("n_critical"), F.count_if(F.col("r") == 0).alias("clean_candidates"))


@query(
    f"""WITH g AS (SELECT flag_type, TRY_CAST(json_extract_string(detail_json, '$.contrast') AS DOUBLE) AS c, TRY_CAST(json_extract_string(detail_json, '$.font_size') AS DOUBLE) AS z FROM {_F} WHERE detail_json IS NOT NULL)
    SELECT flag_type, CASE WHEN c < 1.6 THEN 'low_contrast' WHEN z < 4 THEN 'tiny_font' WHEN c < 2.5 THEN 'faint' ELSE 'visible' END AS state, count(*) AS n FROM g GROUP BY 1, 2"""
)
def graded_findings(spark, sf):
    d = _flags(spark, sf).where("detail_json IS NOT NULL").select("flag_type", *[F.get_json_object("detail_json", f"$.{k}").try_cast("double").alias(a) for k, a in (("contrast", "c"), ("font_size", "z"))])
    return d.groupBy("flag_type", visibility.grade(F.col("c"), F.col("z")).alias("state")).agg(F.count("*").alias("n"))


@query(rf"SELECT flag_id, length(evidence) - length(regexp_replace(evidence, '[{text.INVISIBLE}]', '', 'g')) AS n_unseen FROM {_F} WHERE length(evidence) - length(regexp_replace(evidence, '[{text.INVISIBLE}]', '', 'g')) >= {text.INVISIBLE_LEAST}")
def unseen_characters(spark, sf):
    return _flags(spark, sf).select("flag_id", text.invisible_count(F.col("evidence")).cast("long").alias("n_unseen")).where(F.col("n_unseen") >= text.INVISIBLE_LEAST)


@query(
    rf"""SELECT flag_id, array_to_string(list_transform(regexp_extract_all(evidence, '[\x{{E0020}}-\x{{E007E}}]'), lambda c: chr(unicode(c) - 917504)), '') AS payload
    FROM {_F} WHERE regexp_matches(evidence, '[\x{{E0020}}-\x{{E007E}}]')"""
)
def decoded_tags(spark, sf):
    return _flags(spark, sf).where(F.col("evidence").rlike(r"[\x{E0020}-\x{E007E}]")).select("flag_id", text.decode_tags(F.col("evidence")).alias("payload"))


@query(f"SELECT scan_id, substr(regexp_extract({_fold_sql('hidden_text')}, '{findings.OVERRIDE}', 0), 1, 120) AS hit FROM {_S} WHERE regexp_matches({_fold_sql('hidden_text')}, '{findings.OVERRIDE}')")
def hidden_instructions(spark, sf):
    """Scans whose hidden text, folded, holds an instruction; those that only hold a disguised one: ``disguised_instructions``."""
    return _scans(spark, sf, "hidden_text").select("scan_id", findings.instruction(F.col("hidden_text"), disguised=False).alias("hit")).where("hit <> ''")


@query(
    f"""SELECT flag_id, CASE WHEN regexp_matches({_fold_sql('evidence')}, '{findings.OVERRIDE}|{findings.PRAISE}') THEN 'critical' ELSE severity END AS severity, substr(evidence, 1, {findings.CLIP}) AS evidence
    FROM {_F} WHERE evidence <> ''"""
)
def escalated_findings(spark, sf):
    f = _flags(spark, sf).where("evidence <> ''")
    return f.select("flag_id", findings.escalate(F.col("severity"), findings.instruction(F.col("evidence"), broad=True)).alias("severity"), F.substring("evidence", 1, findings.CLIP).alias("evidence"))


def _bare_sql(c: str) -> str:
    """Mathematical and full-width letters as plain ones, without the unseen characters; what SQL can do of the operator's probe."""
    odd = [chr(o) for o in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)) if len(unicodedata.normalize("NFKC", chr(o))) == 1 and unicodedata.normalize("NFKC", chr(o)) != chr(o)]
    plain = "".join(unicodedata.normalize("NFKC", o) for o in odd).replace("'", "''")
    return rf"regexp_replace(translate({c}, '{''.join(odd)}', '{plain}'), '[{text.INVISIBLE}\x{{300}}-\x{{36F}}]', '', 'g')"


@query(
    f"""WITH s AS (SELECT scan_id, {_fold_sql('hidden_text')} AS plain, {_fold_sql(_bare_sql('hidden_text'))} AS bare FROM {_S})
    SELECT scan_id, substr(regexp_extract(bare, '{findings.OVERRIDE}', 0), 1, 120) AS hit FROM s WHERE regexp_matches(bare, '{findings.OVERRIDE}') AND NOT regexp_matches(plain, '{findings.OVERRIDE}')"""
)
def disguised_instructions(spark, sf):
    """Scans whose hidden text holds an instruction only without its disguises."""
    s = _scans(spark, sf, "hidden_text")
    open_hit, hit = findings.instruction(F.col("hidden_text"), disguised=False), findings.instruction(F.col("hidden_text"))
    return s.where(open_hit == "").select("scan_id", hit.alias("hit")).where("hit <> ''")


@query(
    rf"""WITH s AS (SELECT scan_id, hidden_text AS t, string_split(regexp_replace(replace(hidden_text, chr(10), chr(1)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM {_S} WHERE hidden_text <> '')
    SELECT scan_id, substr(coalesce(list_filter(p, lambda x: regexp_matches({_fold_sql('x')}, '{findings.OVERRIDE}') OR regexp_matches({_fold_sql(_bare_sql('x'))}, '{findings.OVERRIDE}'))[1], t), 1, 300) AS context FROM s"""
)
def instruction_context(spark, sf):
    """Hidden texts with the sentence that holds the instruction."""
    return _scans(spark, sf, "hidden_text").where("hidden_text <> ''").select("scan_id", findings.context(F.col("hidden_text")).alias("context"))


@query(f"SELECT DISTINCT candidate_id, lower(unnest(regexp_extract_all(visible_text, '{text.EMAIL}'))) AS email FROM scans")
def contacts(spark, sf):
    return table(spark, sf, "scans").select("candidate_id", F.explode(text.emails(F.col("visible_text"))).alias("email")).distinct()


@query(
    rf"""WITH d AS (SELECT scan_id, unnest(regexp_extract_all(visible_text, '\+?[0-9][0-9 ./()-]{{7,18}}[0-9]')) AS p FROM scans), n AS (SELECT DISTINCT scan_id, regexp_replace(p, '[^0-9]', '', 'g') AS digits FROM d)
    SELECT scan_id, digits FROM n WHERE length(digits) BETWEEN 9 AND 15"""
)
def phone_runs(spark, sf):
    return table(spark, sf, "scans").select("scan_id", F.explode(text.phones(F.col("visible_text"))).alias("digits")).distinct()


_BASE = _fold_sql(r"regexp_replace(regexp_replace(doc_name, '\.[A-Za-z0-9]{1,5}$', ''), '[_+-]', ' ', 'g')")


@query(
    f"""WITH k AS (SELECT scan_id, doc_name, array_to_string(list_filter(string_split({_BASE}, ' '), lambda w: NOT regexp_matches(w, '^(?:{text.DOCUMENT_WORDS}|v[0-9]+|[0-9]+|)$')), ' ') AS k FROM {_S} WHERE doc_name IS NOT NULL)
    SELECT CASE WHEN k <> '' THEN k ELSE {_fold_sql('doc_name')} END AS person, count(*) AS n_docs, min(scan_id) AS first_scan FROM k GROUP BY 1"""
)
def person_groups(spark, sf):
    s = _scans(spark, sf, "doc_name").where("doc_name IS NOT NULL").withColumn("person", text.person_key(F.col("doc_name")))
    return s.groupBy("person").agg(F.count("*").alias("n_docs"), F.min("scan_id").alias("first_scan"))


_W = "[" + ", ".join(f"'{w.lower()}'" for w in WANTED) + "]"


@query(
    f"""WITH h AS (SELECT candidate_id, list(DISTINCT {_fold_sql('name')}) FILTER (name IS NOT NULL) AS names FROM q_skills GROUP BY 1),
    g AS (SELECT candidate_id, list_filter({_W}, lambda w: len(list_filter(coalesce(names, []), lambda h: length(h) > 0 AND (contains(h, w) OR contains(w, h)))) > 0) AS hit FROM h)
    SELECT candidate_id, array_to_string(list_sort(hit), ',') AS hits, array_to_string(list_sort(list_filter({_W}, lambda w: NOT list_contains(hit, w))), ',') AS missing, round(len(hit) * 10.0 / {len(WANTED)}, 4) AS score FROM g"""
)
def skill_overlap(spark, sf):
    return matching.skill_overlap(table(spark, sf, "q_skills"), WANTED, "candidate_id", "name")


@query(
    rf"""WITH k AS (SELECT DISTINCT candidate_id, trim(name) AS skill FROM q_skills WHERE length(trim(name)) > 1),
    m AS (SELECT scan_id, skill, visible_text AS t, position(lower(skill) IN lower(visible_text)) AS p FROM {_S} JOIN k USING (candidate_id)),
    w AS (SELECT *, greatest(p - 45, 1) AS a, p - greatest(p - 45, 1) + length(skill) + 45 AS n FROM m WHERE p > 0)
    SELECT scan_id, skill, concat(CASE WHEN a > 1 THEN '…' ELSE '' END, trim(regexp_replace(substr(t, a, n), '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ' ', 'g')), CASE WHEN a + n <= length(t) THEN '…' ELSE '' END) AS snippet FROM w"""
)
def skill_snippets(spark, sf):
    k = table(spark, sf, "q_skills").select("candidate_id", F.trim("name").alias("skill")).where(F.length("skill") > 1).distinct()
    s = _scans(spark, sf, "candidate_id", "visible_text").where("visible_text <> ''")
    return s.join(k, "candidate_id").select("scan_id", "skill", text.snippet(F.col("visible_text"), F.col("skill")).alias("snippet")).where("snippet IS NOT NULL")


def _forms(spark, sf):
    r = table(spark, sf, "ref_values").where("ref_kind = 'lang'")
    names = F.concat(F.array("label", "label_cs", "label_de"), F.coalesce("aliases", F.array().cast("array<string>")))
    return r.select("ref_id", F.posexplode(names).alias("k", "form")).where("form IS NOT NULL").select(F.col("ref_id").alias("code"), "form", F.concat("ref_id", F.lit("#"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("ord"))


@query(
    f"""WITH r AS (SELECT ref_id AS code, unnest(list_concat([label, label_cs, label_de], coalesce(aliases, []))) AS form, unnest(range(len(list_concat([label, label_cs, label_de], coalesce(aliases, []))))) AS k FROM ref_values WHERE ref_kind = 'lang'),
    d AS (SELECT code, {_fold_sql('form')} AS form, concat(code, '#', lpad(k::VARCHAR, 3, '0')) AS ord FROM r WHERE form IS NOT NULL),
    v AS (SELECT DISTINCT language AS value FROM q_languages WHERE language IS NOT NULL), u AS (SELECT value, {_fold_sql('value')} AS f FROM v),
    x AS (SELECT value, f, coalesce(list_filter(string_split(f, ' '), lambda w: w <> '' AND NOT list_contains(['jazyk', 'language', 'sprache', 'langue', 'idioma', 'jezyk'], w))[1], '') AS w FROM u),
    m AS (SELECT value, code, 0 AS phase, ord FROM x JOIN d ON f = form AND form <> '' UNION ALL
      SELECT value, code, 1, ord FROM x JOIN d ON length(w) >= 4 AND length(form) >= 4 AND (starts_with(form, w) OR starts_with(w, form))),
    b AS (SELECT value, arg_min(code, (phase, ord)) AS code FROM m GROUP BY 1)
    SELECT value, code FROM v LEFT JOIN b USING (value)"""
)
def language_codes(spark, sf):
    return matching.language_codes(table(spark, sf, "q_languages"), _forms(spark, sf), "language")


# Written apart from the operator's rules; (level, stated, source, pattern that RE2 takes).
_LEVEL_CASES = [
    ("A1", True, "CEFR token", "(^|[^a-z0-9])a1($|[^a-z0-9])"), ("A2", True, "CEFR token", "(^|[^a-z0-9])a2($|[^a-z0-9])"), ("B1", True, "CEFR token", "(^|[^a-z0-9])b1($|[^a-z0-9])"),
    ("B2", True, "CEFR token", "(^|[^a-z0-9])b2($|[^a-z0-9])"), ("C1", True, "CEFR token", "(^|[^a-z0-9])c1($|[^a-z0-9])"), ("C2", True, "CEFR token", "(^|[^a-z0-9])c2($|[^a-z0-9])"),
    ("native", True, "native", "native|mother tongue|mothertongue|bilingual|rodil|matersk|materstin|rodny jazyk"), ("C2", False, "ILR", "full professional|plna profes|plne profes"),
    ("C1", False, "ILR", "professional working|profesional|profesn|umoznujici profes"), ("C1", False, "fluent", "fluent|plynul|plynne|temer rodil"),
    ("B2", False, "ILR", "limited working|upper.intermediate|upperintermediate|vyssi stredn|vyssi pokro"), ("B1", False, "intermediate", "mirne pokrocil|stredne pokrocil|intermediate|conversational|konverzac|komunikativn|domluv"),
    ("B2", False, "advanced", "advanced|pokrocil"), ("A2", False, "elementary", "elementary|zaklad|basic"), ("A1", False, "beginner", "beginner|zacatecnik"), ("native", True, "native", "muttersprach"),
    ("C1", False, "fluent", "verhandlungssicher|fliessend|fließend"), ("B2", False, "advanced", "gute kenntnisse|fortgeschritten"), ("B1", False, "intermediate", "mittelstufe|konversation"),
    ("A2", False, "elementary", "grundkenntnisse"), ("A1", False, "beginner", "anfanger"),
]


def _level_sql(f: str, part: int) -> str:
    value = lambda c: "true" if c[part] is True else "false" if c[part] is False else f"'{c[part]}'"
    return "CASE " + " ".join(f"WHEN regexp_matches({f}, '{c[3]}') THEN {value(c)}" for c in _LEVEL_CASES) + (" ELSE false" if part == 1 else "") + " END"


@query(f"WITH v AS (SELECT row_id, any_value({_fold_sql('level_raw')}) AS f FROM q_languages WHERE level_raw IS NOT NULL GROUP BY 1) SELECT {_level_sql('f', 0)} AS level, {_level_sql('f', 1)} AS stated, {_level_sql('f', 2)} AS source, count(*) AS n FROM v GROUP BY 1, 2, 3")
def level_rules(spark, sf):
    """Levels of typed phrases; each distinct phrase is looked up once."""
    v = table(spark, sf, "q_languages").where("level_raw IS NOT NULL").select("row_id", "level_raw").dropDuplicates(["row_id"])
    each = v.groupBy(text.fold(F.col("level_raw")).alias("f")).agg(F.count("*").alias("n")).withColumn("l", matching.level_of(F.col("f")))
    return each.groupBy("l.level", "l.stated", "l.source").agg(F.sum("n").alias("n"))


_PHRASES = "(VALUES ('B2/C1'), ('C1 - C2'), ('level: a2'), ('native speaker'), ('near-native'), ('bilingual'), ('full professional proficiency'), ('professional working'), ('limited working proficiency'), ('Upper-Intermediate'), ('pre-intermediate'), ('mírně pokročilá'), ('pokročilá'), ('základy'), ('úplný začátečník'), ('rodilý mluvčí'), ('mateřština'), ('plynně'), ('fließend'), (''), ('xc1x'), (NULL)) AS p(phrase)"
# The levels by hand.
_PHRASE_LEVELS = """(VALUES ('B2/C1', 'B2', 'b2', true), ('C1 - C2', 'C1', 'c1', true), ('level: a2', 'A2', 'a2', true), ('native speaker', 'native', 'native', true), ('near-native', 'native', 'native', true), ('bilingual', 'native', 'bilingual', true),
 ('full professional proficiency', 'C2', 'full professional', false), ('professional working', 'C1', 'professional working', false), ('limited working proficiency', 'B2', 'limited working', false), ('Upper-Intermediate', 'B2', 'upper-intermediate', false),
 ('pre-intermediate', 'B1', 'intermediate', false), ('mírně pokročilá', 'B1', 'mirne pokrocil', false), ('pokročilá', 'B2', 'pokrocil', false), ('základy', 'A2', 'zaklad', false), ('úplný začátečník', 'A1', 'zacatecnik', false), ('rodilý mluvčí', 'native', 'rodil', true),
 ('mateřština', 'native', 'materstin', true), ('plynně', 'C1', 'plynne', false), ('fließend', 'C1', 'fließend', false), ('', NULL, NULL, false), ('xc1x', NULL, NULL, false), (NULL, NULL, NULL, false)) AS w(phrase, level, matched, stated)"""


@query(f"SELECT phrase, level, matched, stated FROM {_PHRASE_LEVELS}")
def level_phrases(spark, sf):
    """Levels of phrases chosen to show the order of the rules."""
    p = spark.sql(f"SELECT * FROM {_PHRASES}").withColumn("l", matching.level_of(F.col("phrase")))
    return p.select("phrase", "l.level", "l.matched", "l.stated")


#: The languages that the language queries ask for; a parameter. One of them is in no dictionary.
ASKED = ["anglický jazyk", "Deutsch", "Esperanto"]
_DICT = f"""d AS (SELECT ref_id AS code, {_fold_sql('form')} AS form, concat(ref_id, '#', lpad(k::VARCHAR, 3, '0')) AS ord FROM (SELECT ref_id, unnest(list_concat([label, label_cs, label_de], coalesce(aliases, []))) AS form, unnest(range(len(list_concat([label, label_cs, label_de], coalesce(aliases, []))))) AS k FROM ref_values WHERE ref_kind = 'lang') WHERE form IS NOT NULL),
    v AS (SELECT DISTINCT language AS value FROM q_languages WHERE language IS NOT NULL UNION SELECT unnest(['anglický jazyk', 'Deutsch', 'Esperanto'])), u AS (SELECT value, {_fold_sql('value')} AS f FROM v),
    x AS (SELECT value, f, coalesce(list_filter(string_split(f, ' '), lambda w: w <> '' AND NOT list_contains(['jazyk', 'language', 'sprache', 'langue', 'idioma', 'jezyk'], w))[1], '') AS w FROM u),
    m AS (SELECT value, code, 0 AS phase, ord FROM x JOIN d ON f = form AND form <> '' UNION ALL SELECT value, code, 1, ord FROM x JOIN d ON length(w) >= 4 AND length(form) >= 4 AND (starts_with(form, w) OR starts_with(w, form))),
    b AS (SELECT value, f, (SELECT arg_min(code, (phase, ord)) FROM m WHERE m.value = u.value) AS code FROM u),
    same AS (SELECT a.value, w.value AS wanted FROM b a JOIN b w ON w.value IN ('anglický jazyk', 'Deutsch', 'Esperanto') AND CASE WHEN a.code IS NOT NULL AND w.code IS NOT NULL THEN a.code = w.code ELSE a.f <> '' AND (a.f = w.f OR (length(a.f) >= 4 AND starts_with(w.f, a.f)) OR (length(w.f) >= 4 AND starts_with(a.f, w.f))) END
      WHERE a.value IN (SELECT language FROM q_languages))"""


@query(f"WITH {_DICT} SELECT value, wanted FROM same")
def same_languages(spark, sf):
    """Which typed names mean a wanted language."""
    return matching.same_language(table(spark, sf, "q_languages").select("language"), ASKED, _forms(spark, sf), "language")


@query(
    f"""WITH {_DICT}, t AS (SELECT DISTINCT row_id, candidate_id, ord, language, {_fold_sql('coalesce(level_raw, level)')} AS f FROM q_languages WHERE candidate_id IS NOT NULL),
    g AS (SELECT candidate_id, wanted, ord, {_level_sql('f', 0)} AS l, {_level_sql('f', 1)} AS said FROM t JOIN same ON value = language),
    q AS (SELECT *, CASE l WHEN 'B1' THEN 4.0 WHEN 'B2' THEN 7.0 WHEN 'C1' THEN 9.0 WHEN 'C2' THEN 10.0 WHEN 'native' THEN 10.0 ELSE 0.0 END::DOUBLE AS p FROM g WHERE l IS NOT NULL),
    y AS (SELECT candidate_id, wanted, max(p) AS p, arg_max(said, (p, -ord, said)) AS said FROM q GROUP BY 1, 2), z AS (SELECT candidate_id, sum(p) / 3 AS score, bool_and(said) AS said FROM y GROUP BY 1)
    SELECT c.candidate_id, coalesce(score, 0) AS score, score IS NOT NULL AS known, CASE WHEN score IS NULL THEN 'unknown' WHEN said THEN 'stated' ELSE 'inferred' END AS basis FROM (SELECT DISTINCT candidate_id FROM t) c LEFT JOIN z USING (candidate_id)"""
)
def language_scores(spark, sf):
    """Points of the wanted languages, their mean over all wanted, and whether they are known and stated."""
    langs = table(spark, sf, "q_languages").select("candidate_id", "ord", "language", "level_raw", "level")
    return matching.language_score(langs, ASKED, _forms(spark, sf), "candidate_id")


@query("WITH k AS (SELECT candidate_id, lower(trim(name)) AS k, name, ord, row_id FROM q_skills WHERE trim(name) <> '') SELECT candidate_id, k AS skill_key, arg_min(name, (ord, row_id)) AS name FROM k GROUP BY 1, 2")
def merged_skills(spark, sf):
    """Each candidate's skills once, the first spelling kept; a partial aggregation instead of a window."""
    k = table(spark, sf, "q_skills").where("trim(name) <> ''").withColumn("skill_key", F.lower(F.trim("name")))
    return k.groupBy("candidate_id", "skill_key").agg(F.min_by("name", F.struct("ord", "row_id")).alias("name"))


@query(
    """WITH i AS (SELECT candidate_id, extraction_id, identity_info.full_name AS n, identity_info.location AS l, identity_info.emails AS e FROM extractions),
    a AS (SELECT candidate_id, arg_min(n, extraction_id) FILTER (trim(n) <> '') AS full_name, arg_min(l, extraction_id) FILTER (trim(l) <> '') AS location FROM i GROUP BY 1),
    m AS (SELECT candidate_id, count(DISTINCT lower(e)) AS n_emails FROM (SELECT candidate_id, unnest(e) AS e FROM i) GROUP BY 1)
    SELECT a.candidate_id, full_name, location, coalesce(n_emails, 0) AS n_emails FROM a LEFT JOIN m USING (candidate_id)"""
)
def merged_identity(spark, sf):
    i = table(spark, sf, "extractions").select("candidate_id", "extraction_id", "identity_info.*")
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("extraction_id"))).alias(c)
    return i.groupBy("candidate_id").agg(F.min_by("full_name", F.when(F.trim("full_name") != "", F.col("extraction_id"))).alias("full_name"), first("location"), F.flatten(F.collect_list(F.transform("emails", F.lower))).alias("e")).select("candidate_id", "full_name", "location", F.size(F.array_distinct("e")).cast("long").alias("n_emails"))


@query(
    f"""WITH s AS (SELECT candidate_id, job_id, scan_id, size_bytes FROM {_S}) SELECT candidate_id, scan_id, running::BIGINT AS running, running <= {BUDGET} AS accepted
    FROM (SELECT *, sum(size_bytes) OVER (PARTITION BY candidate_id ORDER BY scan_id ROWS UNBOUNDED PRECEDING) AS running FROM s)"""
)
def upload_budget(spark, sf):
    w = Window.partitionBy("candidate_id").orderBy("scan_id").rowsBetween(Window.unboundedPreceding, 0)
    return _scans(spark, sf, "candidate_id", "size_bytes").withColumn("running", F.sum("size_bytes").over(w)).select("candidate_id", "scan_id", "running", (F.col("running") <= BUDGET).alias("accepted"))


@query("SELECT source, count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_texts, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hashes(spark, sf):
    """Documents and different contents per source; two aggregations, so a hot source is pre-aggregated by hash."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("d"))
    return d.groupBy("source").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_texts"), F.min("d").alias("first_doc"))


@query("SELECT sha256(text) AS content_key, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_keys(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query(
    rf"""WITH e AS (SELECT lower(regexp_extract(doc_name, '\.([A-Za-z0-9]+)$', 1)) AS extension, ok FROM {_S} WHERE doc_name IS NOT NULL)
    SELECT extension, CASE WHEN extension = 'docx' THEN 'docx' WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('txt', 'md') THEN 'text' WHEN extension IN ('png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff') THEN 'image' ELSE 'unsupported' END AS reader,
    count(*) AS n, count(*) FILTER (ok) AS n_ok FROM e GROUP BY 1, 2"""
)
def readers(spark, sf):
    e = _scans(spark, sf, "doc_name", "ok").where("doc_name IS NOT NULL").select(text.extension(F.col("doc_name")).alias("extension"), "ok")
    c = F.col("extension")
    reader = F.when(c == "docx", "docx").when(c == "pdf", "pdf").when(c.isin("txt", "md"), "text").when(c.isin("png", "jpg", "jpeg", "webp", "tif", "tiff"), "image").otherwise("unsupported")
    return e.groupBy("extension", reader.alias("reader")).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


@query(f"WITH t AS (SELECT regexp_replace(lower(trim(doc_type)), '[ -]+', '_', 'g') AS t FROM {_S}) SELECT CASE WHEN t IN ('cv', 'cover_letter', 'job_posting', 'other', 'certificate', 'diploma', 'reference', 'job_ad', 'portfolio') THEN t ELSE 'cv' END AS doc_type, count(*) AS n FROM t GROUP BY 1")
def document_types(spark, sf):
    return _scans(spark, sf, "doc_type").groupBy(text.document_type(F.col("doc_type")).alias("doc_type")).agg(F.count("*").alias("n"))


@query(
    r"""WITH b AS (SELECT extraction_id, regexp_extract(trim(regexp_replace(regexp_replace(qualification_json, '^\s*```[A-Za-z]*\s*', '', 's'), '\s*```\s*$', '', 's')), '(\{.*\})', 1, 's') AS j FROM extractions),
    v AS (SELECT extraction_id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM b)
    SELECT extraction_id, j IS NOT NULL AS readable, CASE WHEN json_type(j, '$.years_total_experience') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract(j, '$.years_total_experience')::DOUBLE END AS years,
    CASE WHEN json_type(j, '$.schema_version') = 'VARCHAR' THEN json_extract_string(j, '$.schema_version') END AS version, coalesce(CASE WHEN json_type(j, '$.skills') = 'ARRAY' THEN json_array_length(j, '$.skills') END, 0)::BIGINT AS n_skills FROM v"""
)
def soft_validation(spark, sf):
    j = F.col("j")
    return table(spark, sf, "extractions").select("extraction_id", validation.unfence(F.col("qualification_json")).alias("j")).select(
        "extraction_id", F.coalesce(validation.readable(j), F.lit(False)).alias("readable"), validation.number(j, "$.years_total_experience").alias("years"), validation.string(j, "$.schema_version").alias("version"), validation.list_size(j, "$.skills").cast("long").alias("n_skills")
    )


@query(
    f"""WITH f AS (SELECT scan_id, max({_RANK}) AS r FROM {_F} GROUP BY 1), r AS (SELECT coalesce(hidden_text, '') <> '' AS poisoned, coalesce(r, 0) >= 2 AS flagged, coalesce(r, 0) >= 3 AS critical, NOT contains(visible_text, hidden_text) AS contained
      FROM {_S} s LEFT JOIN f USING (scan_id) WHERE visible_text IS NOT NULL)
    SELECT round(avg(flagged::INT::DOUBLE) FILTER (poisoned), 6) AS detection_recall, round(avg(critical::INT::DOUBLE) FILTER (poisoned), 6) AS critical_recall, round(avg(contained::INT::DOUBLE) FILTER (poisoned), 6) AS containment_recall,
    round(avg(flagged::INT::DOUBLE) FILTER (NOT poisoned), 6) AS false_positive_rate, count(*) AS n FROM r"""
)
def detector_quality(spark, sf):
    r = _flags(spark, sf).groupBy("scan_id").agg(F.max(findings.severity_rank(F.col("severity"))).alias("r"))
    s = _scans(spark, sf, "visible_text", "hidden_text").where("visible_text IS NOT NULL").join(r, "scan_id", "left")
    rank = F.coalesce("r", F.lit(0))
    return findings.quality(s.select((F.coalesce("hidden_text", F.lit("")) != "").alias("poisoned"), (rank >= 2).alias("flagged"), (rank >= 3).alias("critical"), (~F.contains("visible_text", "hidden_text")).alias("contained")))


@query(
    f"""WITH a AS (SELECT DISTINCT scan_id FROM {_F} WHERE detect_method = 'deterministic'), b AS (SELECT DISTINCT scan_id FROM {_F} WHERE detect_method = 'llm'), s AS (SELECT scan_id, coalesce(hidden_text, '') <> '' AS poisoned FROM {_S})
    SELECT poisoned, a.scan_id IS NOT NULL AS by_rules, b.scan_id IS NOT NULL AS by_model, count(*) AS n FROM s LEFT JOIN a USING (scan_id) LEFT JOIN b USING (scan_id) GROUP BY 1, 2, 3"""
)
def layer_gaps(spark, sf):
    """What each layer of detection finds and misses; one pass over the findings."""
    by = _flags(spark, sf).groupBy("scan_id").agg(F.bool_or(F.col("detect_method") == "deterministic").alias("by_rules"), F.bool_or(F.col("detect_method") == "llm").alias("by_model"))
    s = _scans(spark, sf, "hidden_text").select("scan_id", (F.coalesce("hidden_text", F.lit("")) != "").alias("poisoned")).join(by, "scan_id", "left").na.fill(False, ["by_rules", "by_model"])
    return s.groupBy("poisoned", "by_rules", "by_model").agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS (SELECT scan_id FROM {_S} WHERE coalesce(visible_text, '') <> ''), e AS (SELECT DISTINCT scan_id FROM extractions WHERE qualification_json IS NOT NULL)
    SELECT CASE WHEN t.scan_id IS NULL THEN 'extraction_only' WHEN e.scan_id IS NULL THEN 'text_only' ELSE 'both' END AS status, count(*) AS n FROM t FULL JOIN e ON t.scan_id = e.scan_id GROUP BY 1"""
)
def dual_path(spark, sf):
    t = _scans(spark, sf, "visible_text").where("coalesce(visible_text, '') <> ''").select("scan_id", F.lit(True).alias("t"))
    e = table(spark, sf, "extractions").where("qualification_json IS NOT NULL").select("scan_id").distinct().withColumn("e", F.lit(True))
    return t.join(e, "scan_id", "full").groupBy(F.when(F.col("t").isNull(), "extraction_only").when(F.col("e").isNull(), "text_only").otherwise("both").alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT scan_id FROM {_S} WHERE ok AND scan_id NOT IN (SELECT scan_id FROM extractions WHERE scan_id IS NOT NULL)")
def extraction_misses(spark, sf):
    """Scans without a kept extraction."""
    return _scans(spark, sf, "ok").where("ok").select("scan_id").join(table(spark, sf, "extractions").select("scan_id"), "scan_id", "left_anti")


@query(f"SELECT scan_id FROM {_S} WHERE scan_id IN (SELECT scan_id FROM extractions)")
def extraction_hits(spark, sf):
    return _scans(spark, sf).join(table(spark, sf, "extractions").select("scan_id"), "scan_id", "left_semi")


@query(f"SELECT j.job_id, count(s.scan_id) AS n_scans, count(s.scan_id) = 0 AS missing FROM job_requirements j LEFT JOIN {_S} s ON j.job_id = s.job_id GROUP BY 1")
def manifest(spark, sf):
    """Every job with its documents, also without any; the documents are counted before the join."""
    n = _scans(spark, sf, "job_id").groupBy("job_id").agg(F.count("*").alias("n"))
    return table(spark, sf, "job_requirements").select("job_id").join(n, "job_id", "left").select("job_id", F.coalesce("n", F.lit(0)).alias("n_scans"), F.col("n").isNull().alias("missing"))


@query(f"WITH s AS {_S}, j AS (SELECT job_id, retention_days FROM job_requirements) SELECT job_id, count(*) AS n_kept FROM s JOIN j USING (job_id) WHERE scanned_at >= TIMESTAMP '2025-12-31 00:00:00' - to_days(retention_days) GROUP BY 1")
def retained(spark, sf):
    j = table(spark, sf, "job_requirements").select("job_id", "retention_days")
    s = _scans(spark, sf, "job_id", "scanned_at").join(j, "job_id")
    return s.where("scanned_at >= TIMESTAMP '2025-12-31 00:00:00' - make_dt_interval(retention_days)").groupBy("job_id").agg(F.count("*").alias("n_kept"))


@query(
    f"""WITH s AS (SELECT scan_id, unnest(string_split(visible_text, chr(10))) AS line, unnest(range(len(string_split(visible_text, chr(10))))) AS k FROM {_S} WHERE visible_text <> '')
    SELECT scan_id, count(*) AS n_lines, count(*) FILTER (trim(line) <> '') AS n_filled, sum(length(line))::BIGINT AS n_chars, md5(string_agg(line, '|' ORDER BY k)) AS assembled FROM s GROUP BY 1"""
)
def assembled_lines(spark, sf):
    s = _scans(spark, sf, "visible_text").where("visible_text <> ''").select("scan_id", F.split("visible_text", "\n").alias("x"))
    return s.select("scan_id", F.size("x").cast("long").alias("n_lines"), F.size(F.filter("x", lambda v: F.trim(v) != "")).cast("long").alias("n_filled"), F.aggregate(F.transform("x", F.length), F.lit(0), lambda a, b: a + b).cast("long").alias("n_chars"), F.md5(F.array_join("x", "|")).alias("assembled"))


@query(
    """WITH r AS (SELECT job_id, unnest(from_json(json_extract(rubric_json, '$.criteria'), '[{"key":"VARCHAR","weight":"DOUBLE"}]')) AS c FROM job_requirements)
    SELECT job_id, sum(c.weight) AS weights, count(*) AS n, string_agg(c.key, ',' ORDER BY c.weight DESC, c.key) AS by_weight, sum(CASE WHEN c.weight < 15 THEN 1 WHEN c.weight < 25 THEN 2 WHEN c.weight < 37 THEN 3 ELSE 4 END)::BIGINT AS tiers FROM r GROUP BY 1"""
)
def rubric_weights(spark, sf):
    c = F.from_json(F.get_json_object("rubric_json", "$.criteria"), "array<struct<key:string,weight:double>>")
    r = table(spark, sf, "job_requirements").select("job_id", F.explode(c).alias("c"))
    w = F.col("c.weight")
    tier = F.when(w < 15, 1).when(w < 25, 2).when(w < 37, 3).otherwise(4)
    return r.groupBy("job_id").agg(F.sum(w).alias("weights"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-w).alias("w"), F.col("c.key").alias("k")))), lambda x: x["k"]), ",").alias("by_weight"), F.sum(tier).alias("tiers"))


_POINTS = {"secondary": 5, "bachelor": 7, "master": 9, "phd": 10, "course": 4}
_CEFR = {"A1": 2, "A2": 3, "B1": 4, "B2": 7, "C1": 9, "C2": 10, "native": 10}
_SCORED = (
    f"""WITH c AS (SELECT candidate_id, min(job_id) AS job_id FROM candidates GROUP BY 1),
    h AS (SELECT candidate_id, list(DISTINCT {_fold_sql('name')}) FILTER (name IS NOT NULL) AS names FROM q_skills GROUP BY 1),
    k AS (SELECT candidate_id, len(list_filter({_W}, lambda w: len(list_filter(coalesce(names, []), lambda h: length(h) > 0 AND (contains(h, w) OR contains(w, h)))) > 0)) * 10.0 / {len(WANTED)} AS s FROM h),
    e AS (SELECT candidate_id, max(CASE lower(trim(level)) """ + " ".join(f"WHEN '{a}' THEN {b}" for a, b in _POINTS.items()) + """ ELSE 0 END)::DOUBLE AS s FROM q_education GROUP BY 1),
    l AS (SELECT candidate_id, max(CASE level """ + " ".join(f"WHEN '{a}' THEN {b}" for a, b in _CEFR.items()) + f""" ELSE 0 END)::DOUBLE AS s FROM q_languages GROUP BY 1),
    n AS (SELECT candidate_id, least(count(DISTINCT job_id || ord::VARCHAR) * 2.0, 10.0) AS s FROM q_education GROUP BY 1),
    t AS (SELECT candidate_id, job_id, coalesce(k.s, 0) AS skills, coalesce(e.s, 0) AS education, coalesce(l.s, 0) AS languages, coalesce(n.s, 0) AS breadth FROM c LEFT JOIN k USING (candidate_id) LEFT JOIN e USING (candidate_id) LEFT JOIN l USING (candidate_id) LEFT JOIN n USING (candidate_id)),
    z AS (SELECT *, floor((0.0::DOUBLE + 40.0::DOUBLE / 100.0 * skills * 10 + 30.0::DOUBLE / 100.0 * education * 10 + 20.0::DOUBLE / 100.0 * languages * 10 + 10.0::DOUBLE / 100.0 * breadth * 10) * 10 + 0.5) / 10 AS total FROM t)"""
)


def _scored(spark, sf):
    c = table(spark, sf, "candidates").groupBy("candidate_id").agg(F.min("job_id").alias("job_id"))
    k = matching.skill_overlap(table(spark, sf, "q_skills"), WANTED, "candidate_id", "name").select("candidate_id", F.col("score").alias("skills"))
    points = lambda c, m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), c), F.lit(0)).cast("double")
    e = table(spark, sf, "q_education").groupBy("candidate_id").agg(F.max(points(F.lower(F.trim("level")), _POINTS)).alias("education"), scoring.bonus(F.countDistinct(F.concat("job_id", F.col("ord").cast("string")))).alias("breadth"))
    lang = table(spark, sf, "q_languages").groupBy("candidate_id").agg(F.max(points(F.col("level"), _CEFR)).alias("languages"))
    t = c.join(k, "candidate_id", "left").join(e, "candidate_id", "left").join(lang, "candidate_id", "left").na.fill(0.0, ["skills", "education", "languages", "breadth"])
    return t.withColumn("total", scoring.total([(F.col("skills"), 40.0), (F.col("education"), 30.0), (F.col("languages"), 20.0), (F.col("breadth"), 10.0)]))


@query(f"{_SCORED} SELECT candidate_id, job_id, total, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, candidate_id) AS rank, count(*) OVER (PARTITION BY job_id) AS n FROM z")
def ranked_candidates(spark, sf):
    """Every candidate's place among its job's, and how many those are; jobs of any size are sorted by many tasks."""
    return scoring.ranked(_scored(spark, sf).select("candidate_id", "job_id", "total"), "job_id", [F.desc("total"), F.asc("candidate_id")])


@query(f"{_SCORED}, q AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY total DESC, candidate_id) AS rank FROM z) SELECT job_id, candidate_id, total, rank FROM q WHERE rank <= 5")
def top_five(spark, sf):
    """The five best of each job: a top-k report."""
    return scoring.rank(_scored(spark, sf), [F.desc("total"), F.asc("candidate_id")], ["job_id"]).where("rank <= 5").select("job_id", "candidate_id", "total", "rank")


@query(f"{_SCORED} SELECT job_id, least(greatest(round(skills), 0), 10)::INT AS bucket, CASE WHEN skills >= 7.5 THEN 'strong' WHEN skills >= 4 THEN 'partial' ELSE 'weak' END AS state, count(*) AS n FROM z GROUP BY 1, 2, 3")
def criterion_heat(spark, sf):
    s = F.col("skills")
    return _scored(spark, sf).groupBy("job_id", F.least(F.greatest(F.round(s), F.lit(0)), F.lit(10)).cast("int").alias("bucket"), F.when(s >= 7.5, "strong").when(s >= 4, "partial").otherwise("weak").alias("state")).agg(F.count("*").alias("n"))


_HAND = "(VALUES ('A', 1, 5.0, 5, 9.0, 9.0, 30.0, 2), ('B', 2, 1.0, 1, 5.0, 4.0, 12.0, 0), ('C', 3, 3.0, 3, 7.0, 7.0, 36.0, 0), ('D', 4, NULL, 0, 0.0, 0.0, NULL, 0)) AS t(name, ord, years, hits, education, language, months, certs)"


@query(
    f"""WITH s AS (SELECT name, ord, coalesce(years >= 2, true) AS passes, CASE WHEN years IS NULL THEN 5.0 ELSE greatest(0, least(1, years / 8)) * 10 END AS y, hits * 10.0 / 5 AS k, education::DOUBLE AS e, language::DOUBLE AS l,
      CASE WHEN months IS NULL THEN 5.0 ELSE greatest(0, least(1, (months - 6) / 18)) * 10 END AS t, least(certs * 2.0, 10.0) AS c FROM {_HAND}),
    z AS (SELECT name, ord, passes, CASE WHEN passes THEN floor((0.25 * y * 10 + 0.30 * k * 10 + 0.15 * e * 10 + 0.10 * l * 10 + 0.10 * t * 10 + 0.10 * c * 10) * 10 + 0.5) / 10 ELSE 0 END::DOUBLE AS total FROM s)
    SELECT name, passes, total, row_number() OVER (ORDER BY passes DESC, total DESC, ord) AS rank FROM z"""
)
def rubric_handmade(spark, sf):
    c = spark.sql(f"SELECT * FROM {_HAND}")
    d = lambda n: F.col(n).cast("double")
    c = c.withColumn("passes", F.coalesce(F.col("years") >= 2, F.lit(True)))
    parts = [(scoring.numeric_scale(d("years"), 0, 8), 25.0), (d("hits") * 10 / 5, 30.0), (d("education"), 15.0), (d("language"), 10.0), (scoring.tenure(d("months")), 10.0), (scoring.bonus(d("certs")), 10.0)]
    c = c.withColumn("total", F.when(F.col("passes"), scoring.total(parts)).otherwise(0.0)).withColumn("g", F.lit(1))
    return scoring.rank(c, [F.desc("passes"), F.desc("total"), F.asc("ord")], ["g"]).select("name", "passes", "total", "rank")


_RUNS = """(VALUES ('V01', 'document', 1, 1, 'hide me', 'true', true, NULL, NULL, NULL, NULL, NULL, 24.0), ('V02', 'document', 1, 1, 'nearly white', NULL, false, 'FEFEFE', NULL, NULL, NULL, NULL, 24.0),
 ('V03', 'document', 1, 1, 'light grey', NULL, false, 'E8E8E8', NULL, NULL, NULL, NULL, 24.0), ('V05', 'document', 1, 1, 'one point', NULL, false, NULL, NULL, NULL, NULL, NULL, 2.0),
 ('N01', 'document', 1, 1, 'plain ', NULL, false, NULL, NULL, NULL, NULL, NULL, 24.0), ('N01', 'document', 1, 2, 'text', NULL, false, '#333333', NULL, NULL, NULL, NULL, NULL), ('N01', 'document', 2, 1, 'second', 'off', true, 'auto', NULL, NULL, NULL, NULL, 22.0),
 ('N02', 'document', 1, 1, 'white on dark', NULL, false, 'FFFFFF', NULL, NULL, '1F2937', NULL, 24.0), ('N05', 'document', 1, 1, 'faint', NULL, false, 'C0C0C0', 'auto', NULL, NULL, NULL, 24.0), ('N06', 'document', 1, 1, 'on yellow', NULL, false, 'FFFFFF', 'yellow', NULL, NULL, NULL, 24.0),
 ('N07', 'document', 1, 1, NULL, NULL, false, NULL, NULL, NULL, NULL, NULL, 24.0)) AS t(doc, part, para, run, text, vanish, has_vanish, color, highlight, run_shd, para_shd, doc_bg, size_half_pt)"""


def _lum_sql(h: str) -> str:
    v = [f"('0x' || substr({h}, {k}, 2))::INT / 255.0" for k in (1, 3, 5)]
    ch = [f"(CASE WHEN {x} <= 0.03928 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)" for x in v]
    return f"({ch[0]} * 0.2126 + {ch[1]} * 0.7152 + {ch[2]} * 0.0722)"


_HEX = lambda c: f"CASE WHEN regexp_full_match(upper(replace({c}, '#', '')), '[0-9A-F]{{6}}') THEN upper(replace({c}, '#', '')) WHEN {c} = 'yellow' THEN 'FFFF00' END"
_CLASSIFIED = (
    f"""WITH r AS (SELECT *, coalesce({_HEX('highlight')}, {_HEX('run_shd')}, {_HEX('para_shd')}, {_HEX('doc_bg')}, 'FFFFFF') AS bg FROM {_RUNS}),
    f AS (SELECT *, coalesce({_HEX('color')}, CASE WHEN {_lum_sql('bg')} > 0.5 THEN '000000' ELSE 'FFFFFF' END) AS fg FROM r),
    c AS (SELECT *, round((greatest({_lum_sql('fg')}, {_lum_sql('bg')}) + 0.05) / (least({_lum_sql('fg')}, {_lum_sql('bg')}) + 0.05), 3) AS contrast FROM f),
    s AS (SELECT *, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN has_vanish AND coalesce(lower(vanish), 'true') NOT IN ('false', '0', 'off') THEN 'vanish' WHEN contrast < 1.6 THEN 'low_contrast' WHEN size_half_pt / 2 < 4 THEN 'tiny_font' WHEN contrast < 2.5 THEN 'faint' ELSE 'visible' END AS state FROM c)"""
)


@query(f"{_CLASSIFIED} SELECT doc, para, run, contrast, state, state IN ('vanish', 'low_contrast', 'tiny_font') AS hidden FROM s")
def visibility_cascade(spark, sf):
    return visibility.classify_runs(spark.sql(f"SELECT * FROM {_RUNS}")).select("doc", "para", "run", "contrast", "state", "hidden")


@query(
    f"""{_CLASSIFIED}, p AS (SELECT doc, part, para, string_agg(trim(text), ' ' ORDER BY run) FILTER (state IN ('faint', 'visible')) AS v, string_agg(trim(text), chr(10) ORDER BY run) FILTER (state IN ('vanish', 'low_contrast', 'tiny_font')) AS h FROM s GROUP BY 1, 2, 3)
    SELECT doc, coalesce(string_agg(v, chr(10) ORDER BY part, para), '') AS visible, coalesce(string_agg(h, chr(10) ORDER BY part, para), '') AS hidden FROM p GROUP BY 1"""
)
def visible_and_hidden(spark, sf):
    return visibility.assemble(visibility.classify_runs(spark.sql(f"SELECT * FROM {_RUNS}")))


_SPANS = "(VALUES ('D', 1, 1, 'on white', 10.0, 10.0, 60.0, 20.0, 11.0, 'FFFFFF'), ('D', 1, 2, 'on panel', 110.0, 110.0, 160.0, 120.0, 11.0, 'FFFFFF'), ('D', 1, 3, 'tiny', 10.0, 30.0, 60.0, 32.0, 2.0, '000000'), ('D', 1, 4, 'away', 700.0, 10.0, 760.0, 20.0, 11.0, '000000'), ('D', 2, 5, 'plain', 10.0, 10.0, 60.0, 20.0, 11.0, '000000'), ('D', 2, 6, 'unseen', 200.0, 200.0, 260.0, 210.0, 11.0, '000000')) AS s(doc, page, ord, text, x0, y0, x1, y1, size, ink)"
_DRAWN = "(VALUES ('D', 1, 1, 100.0, 100.0, 300.0, 300.0, '808080'), ('D', 1, 2, 105.0, 105.0, 200.0, 200.0, '1F2937'), ('D', 2, 1, 0.0, 0.0, 500.0, 500.0, 'FFFFFF')) AS d(doc, page, ord, x0, y0, x1, y1, fill)"
_REGIONS = "(VALUES ('D', 2, 195.0, 195.0, 250.0, 215.0)) AS g(doc, page, x0, y0, x1, y1)"
_BEHIND = f"SELECT s.*, coalesce(arg_min(d.fill, ((d.x1 - d.x0) * (d.y1 - d.y0), -d.ord)), 'FFFFFF') AS fill FROM {_SPANS} LEFT JOIN {_DRAWN} ON s.doc = d.doc AND s.page = d.page AND d.x0 <= s.x0 AND d.y0 <= s.y0 AND d.x1 >= s.x1 AND d.y1 >= s.y1 GROUP BY ALL"
_UNDER = f"SELECT DISTINCT s.ord FROM {_SPANS} JOIN {_REGIONS} ON s.doc = g.doc AND s.page = g.page AND least(s.x1, g.x1) > greatest(s.x0, g.x0) AND least(s.y1, g.y1) > greatest(s.y0, g.y0) AND (least(s.x1, g.x1) - greatest(s.x0, g.x0)) * (least(s.y1, g.y1) - greatest(s.y0, g.y0)) > 0.5 * (s.x1 - s.x0) * (s.y1 - s.y0)"


@query(f"SELECT ord, fill FROM ({_BEHIND})")
def spatial_background(spark, sf):
    return visibility.behind_spans(spark.sql(f"SELECT * FROM {_SPANS}"), spark.sql(f"SELECT * FROM {_DRAWN}")).select("ord", "fill")


@query(_UNDER)
def invisible_overlap(spark, sf):
    return visibility.under_invisible(spark.sql(f"SELECT * FROM {_SPANS}"), spark.sql(f"SELECT * FROM {_REGIONS}")).select("ord")


@query(
    f"""WITH b AS ({_BEHIND}), u AS ({_UNDER}), c AS (SELECT b.*, u.ord IS NOT NULL AS in_region, round((greatest({_lum_sql('ink')}, {_lum_sql('fill')}) + 0.05) / (least({_lum_sql('ink')}, {_lum_sql('fill')}) + 0.05), 3) AS contrast FROM b LEFT JOIN u USING (ord))
    SELECT ord, CASE WHEN in_region THEN 'invisible_region' WHEN x1 < -1 OR y1 < -1 OR x0 > 596 OR y0 > 843 THEN 'offpage' WHEN contrast < 1.6 THEN 'low_contrast' WHEN size < 4 THEN 'tiny_font' WHEN contrast < 2.5 THEN 'faint' ELSE 'visible' END AS state FROM c"""
)
def span_cascade(spark, sf):
    spans = spark.sql(f"SELECT * FROM {_SPANS}")
    under = visibility.under_invisible(spans, spark.sql(f"SELECT * FROM {_REGIONS}")).select("ord").withColumn("in_region", F.lit(True))
    s = visibility.behind_spans(spans, spark.sql(f"SELECT * FROM {_DRAWN}")).join(under, "ord", "left").na.fill(False, ["in_region"])
    return visibility.classify_spans(s).select("ord", "state")


@query(f"SELECT a, b, round((greatest({_lum_sql('a')}, {_lum_sql('b')}) + 0.05) / (least({_lum_sql('a')}, {_lum_sql('b')}) + 0.05), 3) AS contrast FROM (VALUES ('FEFEFE', 'FFFFFF'), ('D0D0D0', 'FFFFFF'), ('333333', 'FFFFFF'), ('FFFFFF', '1F2937')) AS t(a, b)")
def contrast_pairs(spark, sf):
    return spark.sql("SELECT * FROM VALUES ('FEFEFE', 'FFFFFF'), ('D0D0D0', 'FFFFFF'), ('333333', 'FFFFFF'), ('FFFFFF', '1F2937') AS t(a, b)").withColumn("contrast", F.round(color.contrast(F.col("a"), F.col("b")), 3))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY received_at, doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents")
def progress_index(spark, sf):
    """Place and size within each source, whatever its share of the rows."""
    d = table(spark, sf, "documents").select("source", "doc_id", "received_at")
    return scoring.ranked(d, "source", [F.asc_nulls_last("received_at"), F.asc("doc_id")]).select("source", "doc_id", F.col("rank").alias("i"), "n")


@query(
    """WITH k AS (SELECT doc_id, strftime(received_at, '%Y%m%d-%H') AS stamp FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY stamp ORDER BY doc_id) AS i FROM k)
    SELECT doc_id, CASE WHEN i = 1 THEN stamp ELSE concat(stamp, '-', i) END AS free_id FROM n"""
)
def free_ids(spark, sf):
    k = table(spark, sf, "documents").select("doc_id", F.date_format("received_at", "yyyyMMdd-HH").alias("stamp"))
    k = scoring.ranked(k, "stamp", [F.asc("doc_id")]).withColumnRenamed("rank", "i")
    return k.select("doc_id", F.when(F.col("i") == 1, F.col("stamp")).otherwise(F.concat("stamp", F.lit("-"), F.col("i").cast("string"))).alias("free_id"))


@query("SELECT candidate_id, max(ingested_at) AS ingested_at, arg_max(status, ingested_at) AS status FROM candidates GROUP BY 1")
def newest_candidates(spark, sf):
    """The last delivery of each candidate."""
    return newest(table(spark, sf, "candidates"), "candidate_id").select("candidate_id", "ingested_at", "status")


@query(f"SELECT 'scan' AS origin, scan_id AS rec_id, visible_text AS body FROM {_S} WHERE visible_text <> '' UNION ALL SELECT 'flag', flag_id, evidence FROM {_F} WHERE evidence <> ''")
def text_union(spark, sf):
    """Scanned and quoted texts as one batch."""
    s = _scans(spark, sf, "visible_text").where("visible_text <> ''").select(F.lit("scan").alias("origin"), F.col("scan_id").alias("rec_id"), F.col("visible_text").alias("body"))
    f = _flags(spark, sf).where("evidence <> ''").select(F.lit("flag").alias("origin"), F.col("flag_id").alias("rec_id"), F.col("evidence").alias("body"))
    return s.unionByName(f)
