import random

import pytest

from sedimenta.operators import cue_tables as C


def test_counts_equal_str_count():
    draw = random.Random(3)
    for _ in range(300):
        letters = draw.choice(["ab", "abc", "数据ab"])
        rules = {f"k{i}": ["".join(draw.choices(letters, k=draw.randint(1, 4))) for _ in range(draw.randint(0, 6))] for i in range(3)}
        cues = C.Cues(rules)
        for n in (0, 1, 7, 200):
            text = "".join(draw.choices(letters, k=n))
            assert cues.counts(text) == [sum(text.count(w) for w in ws) for ws in rules.values()]
    assert C.Cues({}).counts("x") == [] and C.Cues({"a": []}).counts("x") == [0] and C.Cues({"a": ["x"]}).counts(None) == [0]


def test_rules_are_read_anew(spark, tmp_path):
    path = tmp_path / "cues.json"
    rows = spark.createDataFrame([(1, "aaaa Ab", "x"), (1, None, "x"), (2, "", "x"), (1, "aaaa Ab", "x")], "id long, body string, text string")
    path.write_text('{"a": ["aa", "", "b"], "两": ["Ab", "aa", "aa"]}')
    rules = C.load_cues(spark, str(path))
    got = sorted(map(tuple, C.count_cues(rows, "body", ["id", "text"], rules).collect()))
    assert got == [(1, "x", 0, 0), (1, "x", 3, 5), (1, "x", 3, 5), (2, "x", 0, 0)]
    assert sorted((r.id, r["category"], r.n, r["rank"]) for r in C.signals(C.count_cues(rows, "body", ["id"], rules), "id", list(rules)).collect()) == [(1, "a", 3, 2), (1, "a", 3, 2), (1, "两", 5, 1), (1, "两", 5, 1)]
    path.write_text('{"c": ["a a", " ab"]}')
    again = C.load_cues(spark, str(path))
    assert sorted(r.c for r in C.count_cues(rows, "body", ["id"], again, lower=True).collect()) == [0, 0, 2, 2]
    assert C.count_cues(rows.limit(0), "body", ["id"], again).count() == 0
    for bad in ('["a"]', '{"a": "b"}', '{"a": [1]}', "{"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            C.load_cues(spark, str(path))
