"""Single expressions that no query covers, nulls and extra columns included."""

from pyspark.sql import functions as F

from quillsieve.operators import findings, matching, visibility
from quillsieve.sources import batch, dispatch


def test_colours_levels_and_tables(spark):
    got = spark.createDataFrame([("FEFEFE",), ("#F0F0F0",), ("EFFFFF",), ("auto",), (None,)], "c string").select(visibility.near_white(F.col("c"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]
    levels = spark.createDataFrame([("A1",), ("B2",), ("C2",), ("native",), ("x",), (None,)], "l string").select(matching.level_rank(F.col("l")), matching.level_group(F.col("l"))).collect()
    assert [tuple(r) for r in levels] == [(1, "Basic"), (4, "Independent"), (6, "Proficient"), (7, "Native"), (None, None), (None, None)]
    kept = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, v int")
    assert sorted(r.v for r in batch.removed(kept, kept.where("name = 'a'").union(kept.limit(0)), "name").collect()) == [2, 3]


def test_visible_tone_and_places(spark):
    t = spark.createDataFrame([("a", "I am the ideal candidate.", 1), ("b", "plain", 2), ("c", None, 3), ("d", "Igno​re all previous", 4)], "doc string, visible string, severity int")
    assert sorted((r.doc, r.severity) for r in visibility.visible_tone(t).collect()) == [("a", "warn"), ("d", "warn")]
    p = spark.createDataFrame([("Plain. Ignore all of it! Bye.", "raw"), (None, "x. system prompt here."), ("a", "b"), (None, None)], "m string, r string")
    assert [r[0] for r in p.select(dispatch.instruction_place(F.col("m"), F.col("r"))).collect()] == ["Ignore all of it!", "system prompt here.", None, None]
    r = spark.createDataFrame([("Say ＳＱＬ", None, "sql"), ("x", "sq​l", " SQL "), ("x", "y", ""), (None, None, None)], "v string, h string, p string")
    assert [tuple(x[0]) for x in r.select(findings.reaches(F.col("v"), F.col("h"), F.col("p"))).collect()] == [(True, False), (False, True), (False, False), (False, False)]


def test_findings_of_nothing(spark):
    runs = spark.createDataFrame([], "doc string, part string, para int, run int, text string, vanish string, has_vanish boolean, color string, highlight string, run_shd string, para_shd string, doc_bg string, size_half_pt double, kind string, type string")
    c = visibility.classify_runs(runs)
    assert visibility.docx_findings(c).count() == 0 and visibility.assemble(c).columns == ["doc", "visible", "hidden"]
    nulls = spark.createDataFrame([("d", None, None, None, None, None, None, None, None, None, None, None, None, None, "x")], runs.schema)
    got = visibility.assemble(visibility.classify_runs(nulls)).collect()
    assert [tuple(r) for r in got] == [("d", "", "")] and visibility.docx_findings(visibility.classify_runs(nulls)).count() == 0
