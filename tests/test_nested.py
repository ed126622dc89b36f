import json

from quillsieve.operators import nested as n


def entries(raw):
    return sorted((r[0], r[3], r[5]) for r in n.shred(raw) if r[6])


def test_wrappings_and_ordinals():
    q = {"experience": [None, {"title": "A"}, {"title": " "}], "skills": ["x", "", {"name": "y"}, {"category": "z"}], "education": {"year": 1}, "languages": "cs"}
    want = [(0, "education", 0), (0, "experience", 1), (0, "languages", 0), (0, "skills", 0), (0, "skills", 2)]
    text = json.dumps(q)
    for raw in (text, json.dumps({"qualification": q}), json.dumps({"response": {"result": {"qualification": q}}}), json.dumps({"qualification": text}), f"```json\n{text}\n```", f"Here it is: {text}\nBye."):
        assert entries(raw) == want
    many = json.dumps({"candidate": {"documents": [{"extract": None}, {"extract": q}, {"extract": {"qualification": {"skills": ["k"]}}}], "count": 3}})
    assert entries(many) == sorted([(1, b, o) for _, b, o in want] + [(2, "skills", 0)])


def test_unreadable_and_empty():
    for raw in (None, "", "  ", "no data", "null", "{}", "[]", '{"skills": ["a"', "[" * 5000 + "]" * 5000):
        assert n.shred(raw) == []
    assert [r[1] for r in n.shred('{"skills": null}')] == [-1]  # a document without entries


def test_equal_subtrees_have_one_identity():
    rows = n.shred(json.dumps({"education": [{"level": "a", "x": {"y": [1, 2.0]}}, {"x": {"y": [1, 2]}, "level": "a"}, {"level": "b", "x": {"y": [2, 1]}}]}))
    top = [r[8] for r in rows if r[2] == -1]
    assert top[0] == top[1] != top[2]


def rebuild(rows, objects, node):
    def full(body):
        v = json.loads(body)
        return expand(v)

    def expand(v):
        if isinstance(v, dict):
            return full(objects[v["$ref"]]) if set(v) == {"$ref"} else {k: expand(x) for k, x in v.items()}
        return [expand(x) for x in v] if isinstance(v, list) else v

    return full(objects[node])


def test_round_trip():
    q = {"skills": ["x", {"name": "é", "tags": [{"a": [1, [2, {"b": None}]]}, "t"]}], "education": [{"level": None, "ok": True}]}
    rows = n.shred(json.dumps(q))
    objects = {r[8]: r[9] for r in rows}
    got = {}
    for r in rows:
        if r[2] == -1:
            got.setdefault(r[3], []).append(rebuild(rows, objects, r[8]))
    assert got == q


def test_tables(spark):
    raw = json.dumps({"skills": ["x", {"name": "y", "level": 3, "deep": {"a": 1}}], "certifications": ["c"]})
    df = spark.createDataFrame([(1, raw, "k"), (1, raw, "k"), (2, None, None), (None, raw, "z")], "extraction_id bigint, qualification_json string, ord string")
    assert n.entries(df).where("extraction_id = 1").count() == 3
    found = n.occurrences(df)
    skills = n.flat(n.bridge(found), n.objects(found), "skills").where("extraction_id = 1").distinct().orderBy("ord").collect()
    assert [(r.ord, r.skills_name, r.skills_level) for r in skills] == [(0, "x", None), (1, "y", "3")]
    assert n.objects(found).count() == 5  # the document, two skills, a nested object, a certification
    assert n.entries(df.limit(0)).count() == 0


def test_prose_before_and_after():
    q = json.dumps({"skills": ["Python"]})
    for raw in (f"Answer [see below]: {q}", f"Use {{braces}} or [1]: {q} and [2].", f'He said {{"a": 1}} then {q}', f"{q} (see [3])"):
        assert entries(raw) == [(0, "skills", 0)], raw
    for raw in ('{"qualification": {"skills": ["a"]}, bad}', 'x {"documents": [{"qualification": {"skills": ["a"]}}, {"qual', "[see below]", "[" * 3000 + "]" * 2999):
        assert n.shred(raw) == [], raw


def test_document_is_the_root():
    one, two = n.shred(json.dumps({"skills": ["x"], "years": 1})), n.shred(json.dumps({"years": 2, "skills": ["x"]}))
    for rows in (one, two):
        ids = {r[8] for r in rows}
        assert all(r[7] in ids for r in rows if r[1] != -1) and rows[0][1] == -1 and rows[0][2] is None
    assert one[0][8] != two[0][8] and one[1][8] == two[1][8]
    assert json.loads(one[0][9]) == {"skills": [{"$ref": one[1][8]}], "years": 1}


def test_deep_nesting_keeps_the_document():
    deep = cur = {}
    for _ in range(n.DEEPEST + 50):
        cur["a"] = {}
        cur = cur["a"]
    rows = n.shred(json.dumps({"skills": [{"name": "x", "deep": deep}, "y"]}))
    assert [(r[3], r[5]) for r in rows if r[6]] == [("skills", 0), ("skills", 1)] and any('"$json"' in r[9] for r in rows)


def test_hot_objects_are_salted(spark):
    from quillsieve.common import join_counted

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "id bigint, k string")
    counted = rows.groupBy("k").count()
    assert sorted(map(tuple, join_counted(rows, counted, ["k"], "count", ["id"], 10).select("id", "count").collect())) == sorted(map(tuple, rows.join(counted, "k").select("id", "count").collect()))
