import pytest

from quillsieve.common import table
from quillsieve.llm import canon, langid


@pytest.fixture(scope="module")
def m(spark, sf):
    return canon.matcher(table(spark, sf, "ref_values"))


@pytest.mark.parametrize(
    "kind,value,ref",
    [("skill", "  pythan3", "skill-python"), ("skill", "C++ ", "skill-cpp"), ("skill", "c# (advanced)", "skill-csharp"), ("skill", "C", "skill-c"), ("skill", "basics of Java Script", "skill-javascript"), ("skill", "react-naative apps", "skill-react_native"),
     ("skill", "Ostra forma suite", "none"), ("skill", "cooking", "none"), ("skill", "-", "none"), ("lang", "anglrcky", "lang-en"), ("lang", "slovenčiina", "lang-sk"), ("lang", "slovinsky", "lang-sl"), ("lang", "romani čhib", "none"), ("lang", "Halmosysština", "none"),
     ("lang", "language: German", "lang-de"), ("level", "úroveň: Annfänger", "level-a1"), ("level", "B2 / FCE", "level-b2"), ("level", "near nnative", "level-c2"), ("level", "ref. 2863", "none"), ("edu", "SŠ s maaturitou (2014)", "edu-secondary"), ("edu", "PhD stunies completed", "edu-phd"), ("edu", "life", "none")],
)
def test_matches(m, kind, value, ref):
    assert m.match(kind, value) == ref


def test_index_finds_all_within_bound(m):
    """Symmetric deletion against comparing with every form."""
    forms = [f for k, f in m.exact if k == "skill" and len(f) >= 8][:40]
    for f in forms:
        for typo in (f[:3] + f[4:], f[:5] + "x" + f[5:], f[:2] + f[3] + f[2] + f[4:]):
            brute = {r for (k, o), r in m.exact.items() if k == "skill" and len(o) >= 4 and canon.distance(typo, o, min(canon.bound(len(typo)), canon.bound(len(o)))) < 9}
            if m.exact.get(("skill", typo)) is None and brute:
                assert m.near("skill", typo)[1] in brute


def test_mapped_table(spark, sf):
    ref = table(spark, sf, "ref_values")
    q = spark.createDataFrame([(1, "Python", "a"), (1, "Python", "a"), (2, None, "b"), (3, " \t", "c"), (None, "Java", "d"), (4, "zz" * 5000, "e")], "row_id bigint, name string, value string")
    got = canon.mapped({"q_skills": q}, ref)
    assert sorted((r.row_id, r.ref_id) for r in got.collect()) == [(1, "skill-python"), (4, "none")]
    assert canon.misses(got).count() == 1
    assert canon.mapped({"q_skills": q.limit(0)}, ref).count() == 0
    assert {r.ref_id for r in canon.mapped({"q_skills": q}, ref.limit(0)).collect()} == {"none"}


def test_both_joins_agree(spark, monkeypatch):
    """The map of a hot value is salted where it is too large to be broadcast; no row is lost or repeated."""
    values = spark.createDataFrame([("skill_name", i, "skill", "Python" if i % 3 else f"v{i}") for i in range(300)], "src string, row_id bigint, kind string, value string")
    found = canon.distinct_values(values).withColumn("ref_id", canon.F.concat(canon.F.lit("r-"), "value"))
    monkeypatch.setattr(canon, "HOT_ROWS", 7)
    small, large = (sorted(map(tuple, canon.joined_back(values, found, s).collect())) for s in (True, False))
    assert small == large and len(small) == 300


def test_frequency_counts_folded_forms(spark, sf):
    m = canon.matcher(table(spark, sf, "ref_values"))
    assert m.exactly("lang", "NĚMČINA ") == "lang-de" and m.exactly("lang", "nemcina") == "lang-de"
    exact = spark.createDataFrame([("lang", "němčina", 3, "lang-de"), ("lang", "nemcina", 2, "lang-de"), ("lang", "x", 9, None)], "kind string, value string, n bigint, ref_id string")
    assert canon.with_frequency(m, exact).frequency == {"lang-de": 5}


@pytest.mark.parametrize(
    "kind,value,want",
    [
        ("lang", "NJ", "lang-de"), ("lang", "ungarisch", "lang-hu"), ("lang", "słowacki", "lang-sk"), ("lang", "日本語", "lang-ja"), ("lang", "Norwegian Bokmål", "lang-no"), ("lang", "Klingon", "none"),
        ("skill", "c plus plus", "skill-cpp"), ("skill", "GH Actions", "skill-github_actions"), ("skill", "SQL Server", "skill-microsoft_sql_server"), ("skill", "Oracle 12c", "skill-oracle_database"),
        ("skill", "Win Server", "skill-windows_server"), ("skill", "project mgmt", "skill-project_management"), ("skill", "AWS cloud", "skill-amazon_web_services"), ("skill", "AngularJS", "skill-angular"),
        ("level", "absolute beginner", "level-a1"), ("level", "základní znalosti", "level-a2"), ("level", "not tested", "none"),
        ("edu", "Bachelor of Laws", "edu-bachelor"), ("edu", "SŠ", "edu-secondary"), ("edu", "evening course", "edu-course"), ("edu", "university of life", "none"),
    ],
)
def test_rules(spark, sf, kind, value, want):
    """Derivations by rule, none of which the reference list or the table of synonyms gives."""
    test_rules.matcher = m = getattr(test_rules, "matcher", None) or canon.matcher(table(spark, sf, "ref_values"))
    assert m.match(kind, value) == want


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_held_out_accuracy(spark, model):
    """Documents that the sample can't hold, the labels of real texts at least."""
    from quillsieve.llm.residue import judge

    docs = [r for r in table(spark, "/root/testdata/sf0.1", "documents").where("lang IS NOT NULL AND length(text) > 100 AND doc_id > 5000").collect() if judge(r.text)[0] is None]
    got = langid.segments([r.text for r in docs], model)
    assert sum(g[0] == r.lang for g, r in zip(got, docs)) >= 0.98 * len(docs)


def test_probabilities_sum_to_at_most_one(model):
    import numpy as np

    words = ["a" + chr(c) for c in range(97, 123)]
    p = np.exp(model.score_words(words).astype(float))
    assert (p.sum(0) < 1.0).all()


def test_labels_and_lines(spark, model):
    cs = "Dávám přednost krátkým poradám, písemným závěrům a otevřené zpětné vazbě.\nVe volném čase opravuji stará kola a pomáhám v místní knihovně."
    en = "In my free time I repair old bicycles and help at the local library. The notice period is two months."
    rows = [(1, f"{cs}\n{en}", "cs-CZ"), (1, f"{cs}\n{en}", "cs-CZ"), (2, cs, "en"), (3, cs.upper(), "ces"), (4, None, None), (5, "  ", None), (6, en, None), (7, langid.strip(cs), "čeština"), (None, cs, "en")]
    scans = spark.createDataFrame(rows, "scan_id bigint, visible_text string, lang_label string")
    got = sorted(map(tuple, langid.found(scans, None, model).collect()))
    assert got == [(1, 2, "en"), (2, -1, "cs"), (6, -1, "en")]
    assert langid.found(scans.limit(0), None, model).count() == 0
    assert [langid.label_language(x) for x in ("EN", "en_US", "de-AT", "ukr", "xx", "", None, "nl", "UK")] == ["en", "en", "de", "uk", None, None, None, None, "uk"]


def test_unknown_languages_are_rejected(spark, model):
    """Texts in languages without a model have no main language; lines of them aren't taken for another of the eight."""
    none = [
        "Tämä on suomenkielinen lause, jossa puhutaan työkokemuksesta ja osaamisesta eri aloilla.",
        "Ez egy magyar nyelvű mondat, amely a munkatapasztalatról és a készségekről szól.",
        "Detta är en svensk mening som handlar om arbetslivserfarenhet och kompetens inom olika områden.",
    ]
    assert [s[0] for s in langid.segments(none, model)] == [None] * 3
    cs = "Dávám přednost krátkým poradám, písemným závěrům a otevřené zpětné vazbě.\nVe volném čase opravuji stará kola a pomáhám v místní knihovně."
    main, _, others = langid.segments([f"{cs}\n{none[0]}"], model)[0]
    assert main == "cs" and all(rejected for _, _, _, rejected in others)
    scans = spark.createDataFrame([(1, none[0], None), (2, cs, None)], "scan_id bigint, visible_text string, lang_label string")
    assert [tuple(r) for r in langid.found(scans, None, model).collect()] == [(2, -1, "cs")]


def test_short_foreign_lines(model):
    """A line's length doesn't decide whether it is in another language; names and addresses aren't."""
    cs = "Dávám přednost krátkým poradám, písemným závěrům a otevřené zpětné vazbě.\nVe volném čase opravuji stará kola a pomáhám v místní knihovně."
    got = langid.segments([f"{cs}\nWe repair old bicycles.", f"{cs}\nReferenz: Lukas Falkenlechner, Abteilungsleitung, Tel. 04066969176."], model)
    assert [[(k, code) for k, code, _, no in others if not no] for _, _, others in got] == [[(2, "en")], []]


def test_sample_by_keys(spark):
    """Repeated and null keys neither fail nor swell the sample; without labelled texts there is no model."""
    text = "Dávám přednost krátkým poradám, písemným závěrům a otevřené zpětné vazbě. " * 3
    docs = spark.createDataFrame([(1, text, "cs"), (1, text, "cs"), (None, text, "cs"), (2, None, "cs"), (3, text, None)], "doc_id bigint, text string, lang string")
    assert langid.train(docs).languages == ["cs"]
    with pytest.raises(ValueError):
        langid.train(docs.limit(0))
