"""Ranks over split groups against a window, and the scores' unknowns."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillsieve.operators import extraction, scoring


def test_ranked_splits_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('g', id % 7) END AS g", "id * 37 % 101 AS s")
    by = [F.desc("s"), F.asc("id")]
    got = scoring.ranked(rows, "g", by, parts=8)
    w = Window.partitionBy("g")
    want = rows.withColumn("rank", F.row_number().over(w.orderBy(*by)).cast("long")).withColumn("n", F.count("*").over(w))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert scoring.ranked(rows.limit(0), "g", by, parts=4).count() == 0


def test_unknown_is_kept_apart(spark):
    a = extraction.sanitized(spark.createDataFrame([(1, "{}"), (2, None), (3, '{"years_total_experience": "5", "education": [7], "skills": [" "]}'), (4, "junk")], "id bigint, qualification_json string"))
    weights = {"years": 1.0, "skills": 1.0, "education": 1.0, "tenure": 1.0, "certifications": 0.0}
    got = {(r.id, r.criterion): (r.score, r.known, r.basis) for r in scoring.breakdown(a, "id", weights, [], {"other": 2.0}).collect()}
    for i in (1, 2, 3, 4):
        assert got[i, "years"] == (5.0, False, "unknown") and got[i, "skills"] == (0.0, False, "unknown") and got[i, "tenure"] == (5.0, False, "unknown")
    assert got[1, "education"] == (0.0, False, "unknown") and got[3, "education"] == (2.0, True, "stated")
    zero = scoring.breakdown(a, "id", dict.fromkeys(weights, 0.0), ["x"], {}).agg(F.sum("contribution")).first()[0]
    assert zero == 0.0
    mean = spark.range(1).select(scoring.category_points(F.array(F.lit(4.0), F.lit(7.0)), True), scoring.category_points(F.array(F.lit(4.0), F.lit(7.0))), scoring.category_points(F.array().cast("array<double>"), True)).first()
    assert tuple(mean) == (5.5, 7.0, 0.0)


@pytest.mark.parametrize(
    "raw,skills,langs",
    [('{"skills": ["a", {"name": "b", "level": 3}, {"x": 1}, "", 5, null], "languages": "cs"}', ["a", "b"], []), ('```json\n{"qualification": {"skills": [{"name": "k"}], "languages": ["cs", {"language": "de"}]}}\n```', ["k"], ["cs", "de"]), ('{"qualification": "no object", "skills": ["t"]}', ["t"], [])],
)
def test_coercion(spark, raw, skills, langs):
    q = extraction.sanitized(spark.createDataFrame([(raw,)], "qualification_json string")).first().q
    assert [s.name for s in q.skills] == skills and [x.language for x in q.languages] == langs


def test_identity_merges_and_cache(spark):
    raw = '{"identity": {"full_name": "A", "emails": ["x@y.z", 5, ""], "phones": "no list"}, "document_type": "Cover-Letter"}'
    r = extraction.sanitized(spark.createDataFrame([(raw,), (None,)], "qualification_json string")).select("who", "doc_type").collect()
    assert (r[0].who.full_name, r[0].who.emails, r[0].who.phones, r[0].doc_type) == ("A", ["x@y.z"], [], "cover_letter") and r[1].doc_type == "cv"
    ids = spark.createDataFrame([(1, 2, ["B@c", " "]), (1, 1, ["b@C", None, "d"]), (None, 1, ["e"])], "k bigint, o bigint, emails array<string>")
    assert sorted(x.item for x in extraction.merged_contacts(ids, "k", "o", "emails").collect()) == ["b@C", "d"]
    texts = spark.createDataFrame([("a", "x" * 13_000), ("b", None), ("c", "t")], "key string, text string")
    hits, misses = extraction.extract(texts, spark.createDataFrame([("c", '{"skills": ["s"]}')], "key string, raw string"), "key", "text")
    assert [h.q.skills[0].name for h in hits.collect()] == ["s"] and sorted((m.key, len(m.prompt)) for m in misses.collect()) == [("a", 12_000), ("b", 0)]
    one = spark.range(1).select(extraction.cache_key(F.lit("f"), F.lit(3), "m", "v", "p"), extraction.cache_key(F.lit("f"), F.lit(3), "m", "v", "q")).first()
    assert one[0] != one[1]
