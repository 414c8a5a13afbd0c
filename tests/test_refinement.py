import json

from pyspark.sql import functions as F

from sedimenta.operators import refinement as R

OLD = {"description": "core", "elements": [{"id": "external_entity", "name": "外部实体", "definition": "old"}, {"id": "process", "name": "处理"}]}
NEW = {"description": "core elements of diagrams", "elements": [{"id": "External_Entity", "name": "外部实体", "definition": "new"}, {"id": "process", "name": "处理"}, {"id": "data_flow", "name": "数据流"}, {"definition": "no key"}]}


def test_overlap_increment_and_merge(spark):
    df = spark.createDataFrame([(json.dumps(NEW), json.dumps(OLD))], "body string, old string")
    pairs = [(R.key_values("body", p), R.key_values("old", p)) for p in R.KEY_FIELDS[R.CONCEPTS][0]]
    added, enriched = R.increments("body", "old", R.CONCEPTS)
    got = df.select(R.field_overlap(pairs).alias("o"), added.alias("a"), enriched.alias("e"), R.simple_merge("old", "body", "elements").alias("m"), R.simple_merge("old", "body", "rules").alias("none")).first()
    assert round(got.o, 4) == 0.6667
    assert got.a == ["elements[].id=data_flow", "elements[].name=数据流"] and got.e == ["description"]
    merged = [json.loads(x) for x in got.m]
    assert [x["id"] for x in merged] == ["external_entity", "process", "data_flow"] and merged[0]["definition"] == "old"
    assert got.none is None


def test_values_at_paths(spark):
    body = {"a": {"b": [1, "x", {"k": 2}]}, "c": [{"d": [{"e": "p"}, {"e": None}]}, {"d": []}, {}], "f": {"g": "v", "h": 3}, "t": True, "s": "[no list", "z": ""}
    df = spark.createDataFrame([(json.dumps(body),), (None,), ("no json",), ("[]",)], "body string")
    paths = {"a.b": ["1", "x", '{"k":2}'], "c[].d[].e": ["p"], "f.*": ["g", "h"], "f": ["v", "3"], "t": ["true"], "s": ["[no list"], "z": [""], "c[].x": [], "none": [], "a.*": ["b"]}
    rows = df.select(*(R.values_at("body", p).alias(f"p{i}") for i, p in enumerate(paths))).collect()
    assert list(rows[0]) == list(paths.values())
    assert all(x == [] for r in rows[1:] for x in r)


def test_decisions_follow_order_and_ties(spark):
    bodies = [OLD, NEW, OLD, {"elements": []}, {"elements": []}, None, NEW]
    df = spark.createDataFrame([(i, "u", None if b is None else json.dumps(b)) for i, b in enumerate(bodies)], "seq long, source_url string, body string")
    got = {r.seq: (r.match, r.decision) for r in R.decisions(df, R.CONCEPTS).collect()}
    assert got == {0: (None, "add"), 1: (0, "merge"), 2: (0, "skip"), 3: (None, "add"), 4: (None, "add"), 5: (None, "add"), 6: (1, "skip")}
    assert R.decisions(df.limit(0), R.CONCEPTS).count() == 0


def test_provenance(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b"), (None, None)], "o string, n string")
    got = [[tuple(s) for s in r.p] for r in rows.select(R.provenance(F.col("o"), F.col("n")).alias("p")).collect()]
    assert got == [[("a", "existing"), ("b", "new")], [("a", "existing")], [("b", "new")], []]
