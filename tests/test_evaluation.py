import json

from sedimenta.operators import evaluation as E


def artifacts(spark, rows):
    return spark.createDataFrame([(i, t, b if b is None or isinstance(b, str) else json.dumps(b)) for i, (t, b) in enumerate(rows)], "seq long, type_id string, body string")


def test_rates_of_known_counters(spark):
    # 63 text fields of which 19 are thin; 95 items of which 91 are too short for the index
    long, thin = "x" * 40, "short"
    levels = [{"id": f"p{i}", "description": thin if i < 19 else f"{long}{i}"} for i in range(63)]
    rows = artifacts(spark, [("diagrams.dfd.levels", {"leveling_principles": levels}), ("diagrams.dfd.templates", {"categories": [{"id": str(i), "name": f"{'n' * (40 if i < 4 else 20)}{i}", "templates": []} for i in range(95)]})])
    got = {r.type_id: r for r in E.quality_report(rows, "type_id").collect()}
    assert got["diagrams.dfd.levels"].low_info_rate == 0.3016
    assert got["diagrams.dfd.templates"].indexable_fail_rate == 0.9579
    assert got["diagrams.dfd.templates"].missing_rate == 0.3333


def test_items_of_odd_bodies(spark):
    rows = artifacts(
        spark,
        [
            ("diagrams.dfd.concepts", {"concepts": [{"id": 1, "name": "暂无", "definition": ["a", "b"]}, "no object", None], "elements": "no list"}),
            ("diagrams.dfd.concepts", {"elements": [], "concepts": [{"id": 1}]}),
            ("diagrams.dfd.templates", {"categories": [{"id": "c", "templates": [{"id": "t"}, {"id": "u"}]}, 5]}),
            ("domain", {"name": "n"}),
            ("domain", None),
            ("schema", "no json"),
            ("unknown", {"a": 1}),
        ],
    )
    got = {}
    for r in E.item_metrics(rows).collect():
        got.setdefault(r.seq, []).append((r.missing, r.required, r.low_info, r.text_fields, r.index_failures, r.dup_text))
    assert sorted(got[0], key=str) == [(0, 0, 0, 0, 0, None), (0, 0, 0, 0, 0, None), (0, 3, 2, 2, 1, "a b")]
    assert 1 not in got and 6 not in got
    assert len(got[2]) == 4 and len(got[3]) == 1
    assert got[3] == [(2, 3, 2, 2, 1, None)]


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"type": "array", "minItems": 2}, "c": {"enum": ["x", "y"], "pattern": "^.$"}}}
    rows = artifacts(spark, [("t", x) for x in ({"a": 5, "b": [1, 2], "c": "x"}, {"a": 1, "b": [1], "c": "zz"}, {"b": {}}, [1], None)])
    got = [r.e for r in rows.select("seq", E.schema_errors("body", schema).alias("e")).orderBy("seq").collect()]
    assert got == [[], ["$.a: too small", "$.b: too few items", "$.c: not one of the values", "$.c: no match of the pattern"], ["$: a is required", "$.b: not of type array"], ["$: not of type object", "$: a is required"], ["$: no JSON"]]
