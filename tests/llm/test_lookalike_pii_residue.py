import unicodedata

import pytest

from quillsieve.common import table
from quillsieve.llm import damage, lookalike, pii, residue


@pytest.mark.parametrize(
    "given,want",
    [("реорlе", "peoplе".replace("е", "e")), ("ｄａｔａｂáｚｉ", "databázi"), ("𝐩𝐫𝐚𝐜ę", "pracę"), ("pro​fil", "profil"), ("café", "café"), ("a b", "a b"), ("oﬃce", "office"), ("λ-calculus", "λ-calculus"), ("людина", "людина"),
     ("250 m²", "250 m²"), ("👨‍🔧.", "👨‍🔧."), ("“x” – …", "“x” – …"), ("Ω", "Ω"), ("\U000e0073\U000e0063x", "x"), ("São", "São"), ("plain", "plain")],
)
def test_alike(given, want):
    assert lookalike.alike(given) == want


def test_lookalike_tables(spark):
    r = damage.fit([])
    scans = spark.createDataFrame([(1, "the рrofile is ok", None), (1, "the рrofile is ok", None), (2, "the profile is ok", "x​y"), (3, None, ""), (None, "p­q", None)], "scan_id bigint, visible_text string, hidden_text string")
    flags = spark.createDataFrame([(5, "ｔｅｓｔ"), (6, "50 000 done"), (7, None)], "flag_id bigint, evidence string")
    src = lookalike.sources_of(scans, flags)
    got = lookalike.variants(src, r)
    assert sorted((x.src, x.rec_id, x.canonical) for x in got.collect()) == [("evidence", 5, "test"), ("evidence", 6, "50 000"), ("hidden_text", 2, "xy"), ("visible_text", 1, "profile")]
    assert lookalike.variants([(s, df.limit(0), k, c) for s, df, k, c in src], r).count() == 0


def test_pattern_holds_every_stand_in(spark):
    """What cuts texts into values, and the pattern that runs in the JVM, must let through whatever ``alike`` would change."""
    odd = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000 and chr(c) not in "\t\n\r " and unicodedata.normalize("NFC", chr(c)) == chr(c) and lookalike.alike("a" + chr(c)) != "a" + chr(c)]
    df = spark.createDataFrame([("a" + c,) for c in odd], "text string")
    assert len(odd) > 500 and all(lookalike.pieces(f"x a{c} y") == ["a" + c] for c in odd)
    assert df.where(f"NOT (text RLIKE '{lookalike.any_pattern()}')".replace("\\", "\\\\")).count() == 0


@pytest.fixture(scope="module")
def lex(spark):
    sf = "/root/testdata/sf0.01"
    return pii.fit(table(spark, sf, "scans"), table(spark, sf, "extractions"))


def items(lex, text):
    return [(k, text[a:b]) for a, b, k in pii.find(text, lex)]


@pytest.mark.parametrize(
    "text,want",
    [("E-mail: nora.wend[at]post (dot) pivolex (dot) test, tel.: 02079460421", [("email", "nora.wend[at]post (dot) pivolex (dot) test"), ("phone", "02079460421")]), ("Please reply to a.b+c@mail.x.example or call me on +49 (0) 406 696 937 9 after five.", [("email", "a.b+c@mail.x.example"), ("phone", "+49 (0) 406 696 937 9")]),
     ("Invoice 204073472011, batch 63663 63663, package react@18.9.0 and @lumatrix/forms@2.4.1", []), ("IČO 109478666, objednávka 450049388479", []), ("r. č. 690513/9043", [("id_number", "690513/9043")]), ("National insurance no. QQ043375C", [("id_number", "QQ043375C")]),
     ("Permanent address: Flat 2, 132 Millbeck Street, Eastmere", [("address", "Flat 2, 132 Millbeck Street")]), ("The reviewer, Nora Holloden, asked for two corrections.", [("name", "Nora Holloden")]), ("CV: Wendridge, Nora", [("name", "Wendridge, Nora")]), ("Ing. JANA KOLDOTOVÁ", [("name", "JANA KOLDOTOVÁ")]),
     ("The position is based in Velká Jedlina since 2013 (see page 4).", []), ("call six zero zero one two three four five six today", [("phone", "six zero zero one two three four five six")])],
)
def test_items(lex, text, want):
    assert items(lex, text) == want


def test_places_survive_disguise(lex):
    text = "​​X ｔｅｌ．: +44 207 946 048 3 and n​ora@x.test"
    got = pii.find(text, lex)
    assert [(k, text[a:b]) for a, b, k in got] == [("phone", "+44 207 946 048 3"), ("email", "n​ora@x.test")]
    assert pii.redact(text, got) == "​​X ｔｅｌ．: [PHONE] and [EMAIL]"


def test_pii_table(spark, lex):
    df = spark.createDataFrame([(1, "a@b.test", "k"), (1, "a@b.test", "k"), (2, None, "l"), (3, "", "m"), (4, "x " * 20000 + "c@d.test", "n")], "scan_id bigint, visible_text string, kind string")
    assert sorted((r.scan_id, r.kind, r.start_pos) for r in pii.items(df, lex).distinct().collect()) == [(1, "email", 0), (4, "email", 40000)]
    assert {r.scan_id: r.visible_text for r in pii.items(df, lex, redacted=True).collect()}[1] == "[EMAIL]"
    assert pii.items(df.limit(0), lex).count() == 0


@pytest.mark.parametrize(
    "text,kind",
    [("Error E37: the document could not be converted. Please try again later. Reference 71.", "error"), ("<html><body><h1>ACCESS DENIED.</h1><hr>X Ltd</body></html>", "error"), ("Please enable JavaScript to view this job advert.", "script"), ("Увімкніть JavaScript, щоб побачити оголошення.", "script"),
     ("A real line about work here.\nbla bla bla bla bla bla bla bla", "filler"), ("Elitum dolan tempore nisum ullamor magnum incidunt sitem labora nostra.", "filler"), ("Dear {{ first_name }}, we thank you.", "placeholder"), ("Dear [Your Name], welcome to __COMPANY__.", "placeholder"),
     ("Our team handled session expired messages and 503 incidents at Tavinova. We also like long walks in the hills.", None), ("I maintained mail templates in which {{ first_name }} is filled in at sending time.", None), ("See the notes [1], [2] and salary [confidential].", None), ("JavaScript is required knowledge for this job, and much more besides that.", None), (None, None), ("", None), (" \n\t", None)],
)
def test_residue(text, kind):
    assert residue.judge(text)[0] == kind


def test_residue_table(spark):
    df = spark.createDataFrame([(1, "404 Not Found", "a"), (1, "404 Not Found", "a"), (2, "A real text about work.", "b"), (3, None, "c"), (None, "404 Not Found", "d")], "doc_id bigint, text string, kind string")
    assert [r.doc_id for r in residue.found(df).collect()] == [1]
    assert sorted(str(r.doc_id) for r in residue.cleaned(df).collect()) == ["2", "3", "None"]
    assert residue.found(df.limit(0)).count() == 0


def test_pii_names_beyond_a_sample(spark):
    """A name of one identity among 25 000, and one of three words that only its own scan states."""
    ids = spark.range(25_000).selectExpr("id AS extraction_id", "id AS scan_id", "named_struct('full_name', concat('Xa', translate(id, '0123456789', 'abcdefghij'), ' Qo', translate(id, '0123456789', 'abcdefghij'))) AS identity_info")
    ids = ids.unionByName(spark.createDataFrame([(-1, -1, ("Yta van Ubberlo",))], "extraction_id bigint, scan_id bigint, identity_info struct<full_name:string>"))
    odd = lambda n: f"The reviewer, Xa{n} Qo{n}, agreed."
    name = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    scans = spark.createDataFrame([(i, odd(name(i))) for i in range(0, 25_000, 50)] + [(-1, "Yta van Ubberlo, engineer"), (-2, "Yta van Ubberlo, engineer")], "scan_id bigint, visible_text string")
    got = pii.found(scans, ids).where("kind = 'name'").collect()
    assert {r.scan_id for r in got} == {*range(0, 25_000, 50), -1}
    assert pii.redacted(scans, ids).where("scan_id = -1").first().visible_text == "[NAME], engineer"


def test_pii_lexicon_bound_fails(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEXICON_MOST", 1)
    ids = spark.createDataFrame([(("Nora Holloden",),)], "identity_info struct<full_name:string>")
    with pytest.raises(ValueError):
        pii.fit(spark.createDataFrame([], "scan_id bigint, visible_text string"), ids)


@pytest.mark.parametrize("words", ["six zero zero four eight one six zero eight", "sest nula nula ctyri osm jedna sest nula osm", "šesť nula nula štyri osem jeden šesť nula osem", "sześć zero zero cztery osiem jeden sześć zero osiem", "SIX ZERO ZERO FOUR EIGHT ONE SIX ZERO EIGHT", "six-zero-zero-four-eight-one-six-zero-eight"])
def test_spelled_numbers_of_few_kinds(lex, words):
    assert items(lex, f"call {words} today") == [("phone", words)]


@pytest.mark.parametrize("street", ["14 Millbeck Rd", "14 Millbeck St.", "14 Millbeck Ave", "Stubenring 5", "osiedle Lipowe 7", "plac Lipowy 7", "площа Ринок 7"])
def test_streets_without_another_hint(lex, street):
    assert ("address", street) in items(lex, f"Nothing else here: I live at {street} now.") or ("address", street) in items(lex, f"I live at {street}, thanks")


@pytest.mark.parametrize("text", ["We demonstrate 3 tools.", "Площа складу становила 250 м², і все.", "Training in 2019 and during 2020, engineering 5 modules, monitoring 12 sites."])
def test_no_streets(lex, text):
    assert items(lex, text) == []


def test_email_beside_a_street_word(lex):
    assert items(lex, "see row nora (at) posta (dot) example") == [("email", "nora (at) posta (dot) example")]


def test_place_decides_placeholders_and_coverage_filler():
    """Words for templates and code near a place make it a mention; other wording doesn't."""
    long = "Together with a team of two people we moved the portal to another database in time. " * 100
    for text in ("Our checklist for {{candidate_name}} is ready.", "We reviewed it: Dear {{ first_name }}, welcome.", long + "Signature: ________ " + long, "The bugs are fixed and the whole team looks forward to meeting {{candidate_name}} soon."):
        assert residue.judge(text)[0] == "placeholder" and residue.judge(text)[1] > 0
    for text in ("I wrote templates in which {{ first_name }} is replaced.", "He fixed a bug that printed [object Object] in reports.", "Ich pflegte Vorlagen, in denen {{anrede}} ersetzt wird.", "Šablony, kde se {{jmeno}} doplňuje."):
        assert residue.judge(text)[0] is None
    assert residue.judge("Sample text goes here.")[0] == "filler"
    assert residue.judge("Last week the designers replaced the sample text goes here of the page header in every mock-up before the launch party.")[0] is None


def test_cleaned(spark):
    docs = spark.createDataFrame([(1, "Dear {{name}}, welcome.", "a"), (1, "Dear {{name}}, welcome.", "a"), (2, "Real text.", "b"), (None, "Real text.", "c"), (3, None, "d")], "doc_id bigint, text string, kind string")
    assert sorted(str(r.doc_id) for r in residue.cleaned(docs).collect()) == ["2", "3", "None"]
    assert residue.cleaned(docs.limit(0)).columns == ["doc_id", "text", "kind"]


def test_own_identity(spark):
    """What the scan's own identity has is found where no pattern or caption shows it, in any notation."""
    lex = pii.Lexicon({}, {}, {})
    text = "Code 602 123 456 and Jan Xyzzy or jan.xyzzy@intranet there"
    show = lambda own: [(k, text[a:b]) for a, b, k in pii.find(text, lex, own)]
    assert show(None) == []
    assert show(["phone:+420602123456", "name:Jan Xyzzy", "email:jan.xyzzy@intranet"]) == [("phone", "602 123 456"), ("name", "Jan Xyzzy"), ("email", "jan.xyzzy@intranet")]
    rows = [(1, ("Jan Xyzzy", ["jan.xyzzy@intranet", None], ["+420602123456"])), (1, ("Jan Xyzzy", None, [])), (2, None), (None, ("A Bcd", ["a@b"], None))]
    extractions = spark.createDataFrame(rows, "scan_id bigint, identity_info struct<full_name string, emails array<string>, phones array<string>>")
    scans = spark.createDataFrame([(1, text), (2, text), (3, None)], "scan_id bigint, visible_text string")
    got = pii.items(scans, lex, own=pii.own_items(extractions, lex)).collect()
    assert sorted((r.scan_id, r.kind) for r in got) == [(1, "email"), (1, "name"), (1, "phone")]


def test_lookalike_model_of_all_texts(spark):
    """Which texts are damaged, and so no cases, is told by a model of all texts, long ones too."""
    long = "Ich war tätig und fähig, später täglich für ähnliche Aufträge zuständig. " * 400
    scans = spark.createDataFrame([(1, long, None)], "scan_id bigint, visible_text string, hidden_text string")
    flags = spark.createDataFrame([(7, "Ich war t‰tig und f‰hig dabei"), (8, "Ich war dabei und dort"), (9, "Vo vo�nom čase")], "flag_id bigint, evidence string")
    assert [tuple(r) for r in lookalike.found(scans, flags).collect()] == [("evidence", 8)]
