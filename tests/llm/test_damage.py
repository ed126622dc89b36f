import random

import pytest

from quillsieve.llm import damage as d

TEXTS = {
    "cs": "Příliš žluťoučký kůň pěl ďábelské ódy, zatímco dělníci řešili údržbu strojů a účetní počítala měsíční závěrku.",
    "de": "Die Straße führt über größere Hügel, und wir können später für längere Zeit in München übernachten.",
    "fr": "L'élève a reçu une lettre très brève après la réunion, où le garçon était déjà fatigué.",
    "es": "El niño comió en la montaña después de la reunión, según explicó el señor García.",
    "pl": "Zażółć gęślą jaźń, a następnie wyjaśnię, dlaczego księgowość skróciła zamknięcie miesiąca.",
    "uk": "Протягом семи років я працював у компанії та відповідав за внутрішнє навчання нових колег.",
}
PLAIN = ["São Vitor, 250 m², −20 °C … and 40 Ω", "¿Por qué no? ¡Señalé 250 m²!", "ÄÖÜ-Prüfung mit Maß und Ziel", "Prilis zlutoucky kun", "dva kolegy 👨‍🔧", "naïve café", "", "plain ASCII text?"]


@pytest.fixture(scope="module")
def repairer(spark, sf):
    from quillsieve.common import table

    return d.repairer_for((table(spark, sf, "scans"), "scan_id", "visible_text"), (table(spark, sf, "flags"), "flag_id", "evidence"))


def read_as(text, true, wrong):
    return "".join([d.codecs.decode(bytes([b]), wrong) if d._char(wrong, b) != b or b < 128 else chr(b) for b in text.encode(true)])


CASES = [("utf_8", w) for w in ("cp1252", "latin_1", "cp1250", "mac_roman", "cp437", "cp852")]


@pytest.mark.parametrize("true,wrong", CASES)
@pytest.mark.parametrize("lang", ["cs", "de", "fr", "es", "pl"])
def test_round_trip_utf8(repairer, lang, true, wrong):
    text = f"Intro line. {TEXTS[lang]}"
    ((fixed, bad, lost),) = repairer.repair([read_as(text, true, wrong)])
    assert bad and not lost and fixed == text


@pytest.mark.parametrize("lang,true,wrong", [("de", "cp1252", "cp437"), ("de", "cp1252", "cp850"), ("fr", "cp1252", "mac_roman"), ("es", "mac_roman", "cp1252"), ("cs", "cp1250", "cp852"), ("cs", "cp852", "cp1250"), ("pl", "cp1250", "cp1252"), ("uk", "cp1251", "cp1252"), ("uk", "koi8_u", "cp1251"), ("uk", "cp1251", "cp866")])
def test_round_trip_single_byte(repairer, lang, true, wrong):
    text = TEXTS[lang]
    ((fixed, bad, _),) = repairer.repair([read_as(text, true, wrong)])
    assert bad
    assert sum(a == b for a, b in zip(fixed, text)) > 0.95 * len(text)


def test_twice_and_lost(repairer):
    text = TEXTS["de"]
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert repairer.repair([twice])[0][:2] == (text, True)
    assert [x[1:] for x in repairer.repair(["Vo vo�nom čase", "Hled?me kolegu na m?sto", "see a?b=c&d=1 and why?"])] == [(True, True), (True, True), (False, False)]


def test_intact_texts_stay(repairer):
    texts = PLAIN + list(TEXTS.values())
    assert [(f, b) for f, b, _ in repairer.repair(texts)] == [(t, False) for t in texts]


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        g = np.array([[rng.uniform(-6, 8) for _ in range(6)] for _ in range(2)])

        def cost(path):
            total, now = 0.0, -1
            for t, s in enumerate(path):
                total += (g[s, t] if s >= 0 else 0) - (d.ENTER if s >= 0 and s != now else 0) - (d.LEAVE if now >= 0 and s != now else 0)
                now = s
            return total - (d.LEAVE if now >= 0 else 0)

        best = max(cost(p) for p in itertools.product((-1, 0, 1), repeat=6))
        path = [-1] * 6
        for a, b, s in d._viterbi(g):
            path[a:b] = [s] * (b - a)
        assert abs(cost(path) - best) < 1e-9


def test_table(spark, repairer):
    bad = read_as(TEXTS["cs"], "utf_8", "cp1252")
    scans = spark.createDataFrame([(1, bad, 0), (1, bad, 1), (2, None, 2), (3, "", 3), (None, bad, 4), (4, TEXTS["cs"] * 300, 5)], "scan_id bigint, visible_text string, restored int")
    flags = spark.createDataFrame([(7, "L��cken", "x"), (8, None, "y")], "flag_id bigint, evidence string, damaged string")
    assert sorted(map(tuple, d.found(scans, flags, repairer).collect())) == [("flag", 7), ("scan", 1)]
    assert d.found(scans.limit(0), flags.limit(0), d.fit([])).count() == 0


def test_restored_covers_scans_and_flags(spark, repairer):
    bad, torn = read_as(TEXTS["cs"], "utf_8", "cp1252"), "Hled?me kolegu na m?sto"
    scans = spark.createDataFrame([(1, bad), (1, bad), (2, TEXTS["cs"]), (3, None)], "scan_id bigint, visible_text string")
    flags = spark.createDataFrame([(7, bad), (8, torn), (9, TEXTS["de"]), (10, None)], "flag_id bigint, evidence string")
    got = d.restored(scans, flags, repairer)
    assert got.columns == ["src", "rec_id", "restored", "lost"]
    assert sorted(map(tuple, got.collect())) == [("flag", 7, TEXTS["cs"], False), ("flag", 8, torn, True), ("scan", 1, TEXTS["cs"], False)]


def test_restored_query_gives_back_what_found_names(spark, sf):
    from quillsieve.llm.queries import QUERIES

    named = {tuple(r) for r in QUERIES["p1_found"](spark, sf).collect()}
    assert {(r.src, r.rec_id) for r in QUERIES["p1_restored"](spark, sf).collect() if r.rec_id is not None} == named and {s for s, _ in named} == {"scan", "flag"}


def test_no_gate_before_the_pass(repairer):
    """The bounds rule out no pair that a pass over all pairs would label."""
    texts = [read_as(TEXTS[k], true, wrong) for k, true, wrong in (("de", "cp1252", "cp850"), ("uk", "cp1251", "cp1252"), ("pl", "utf_8", "cp1250"))] + list(TEXTS.values()) + PLAIN
    want = repairer.label(texts)
    every, best = d.np.arange(len(repairer._single_pairs)), d._best_span
    d._best_span = lambda gains: d.np.full(len(gains), 1e9)
    bounds = repairer._bounds
    repairer._bounds = lambda *a: (d.np.full((a[-1], len(every)), 1e9), bounds(*a)[1])
    try:
        got = repairer.label(texts)
    finally:
        d._best_span = best
        del repairer._bounds
    assert [[x[:2] for x in t] for t in got] == [[x[:2] for x in t] for t in want]


def test_lost_state_and_lone_letters(spark, repairer):
    assert repairer.lost("Hled?me kolegu na m?sto, na�e") == [(4, 5), (19, 20), (27, 28)]
    assert repairer.lost("Why? Who? see http://a.test/x?id=1 or a?") == []
    from quillsieve.common import table

    at = "/root/testdata/sf0.1"
    repairer = d.repairer_for((table(spark, at, "scans"), "scan_id", "visible_text"), (table(spark, at, "flags"), "flag_id", "evidence"))
    cases = ["The report was handed over in 2016 û two weeks early and on budget û says the client.", "La tarea, y tambiÈn conozco otras."]
    assert [bad for _, bad, _ in repairer.repair(cases)] == [True] * 2
    assert [bad for _, bad, _ in repairer.repair(["Il va à Paris, où il a dû attendre à la gare.", "Он й я є у місті."])] == [False] * 2


def test_model_of_all_texts(spark):
    """Every text counts, long ones and those beyond the first thousands too; damaged ones are taken off whole."""
    scans = [(i, f"Line {i} of the report") for i in range(2300)] + [(2300, "La ĝardeno estas ĉarma. " * 1100), (2301, None), (2302, ""), (None, "Ŝi iras 的 🙂 hejmen.")]
    flags = [(1, read_as(TEXTS["cs"], "utf_8", "cp1252")), (2, "Hled?me kolegu na m?sto"), (3, TEXTS["de"])]
    tables = (spark.createDataFrame(scans, "scan_id bigint, visible_text string").repartition(5), "scan_id", "visible_text"), (spark.createDataFrame(flags, "flag_id bigint, evidence string"), "flag_id", "evidence")
    got, want = d.repairer_for(*tables).model, d.fit([t for _, t in scans + flags if t]).model
    assert ord("ĝ") in got.chars and got.chars == want.chars
    assert (got.log == want.log).all() and (got.extra == want.extra).all()


def test_counts_of_parts_add_up():
    texts = list(TEXTS.values()) + PLAIN
    whole = d.count([t for t in texts if t])
    parts = d.added([d.count([t]) for t in texts if t])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].sum() == sum(len(t) + 1 for t in texts if t)
    left = d.added([whole, (d.count([texts[0]])[0], -d.count([texts[0]])[1])])
    want = d.count([t for t in texts[1:] if t])
    assert (left[0] == want[0]).all() and (left[1] == want[1]).all()
    assert [len(x) for x in (*d.count([]), *d.added([]))] == [0] * 4
    many = "".join(map(chr, range(0xA0, 0x2F00)))
    assert d.count([many])[1].sum() == len(many) + 1


def test_damaged_agrees_with_repair(repairer):
    texts = [read_as(TEXTS[k], true, wrong) for k, true, wrong in (("de", "cp1252", "cp850"), ("uk", "cp1251", "cp1252"), ("pl", "utf_8", "cp1250"))] + list(TEXTS.values()) + PLAIN + ["Hled?me kolegu", "Vo vo�nom"]
    assert repairer.damaged(texts) == [bad for _, bad, _ in repairer.repair(texts)] and any(repairer.damaged(texts))
