import json

from sedimenta import cli


def test_commands(spark, tmp_path):
    body = {"description": "d", "elements": [{"id": "a", "name": "A", "definition": "x" * 40}]}
    rows = [(0, "diagrams.dfd.concepts", "u", body), (1, "diagrams.dfd.concepts", "v", body), (2, "theory", "w", {"concepts": []}), (3, "odd", None, {})]
    source = str(tmp_path / "in")
    spark.createDataFrame([(s, t, u, json.dumps(b)) for s, t, u, b in rows], cli.SCHEMA).write.json(source)
    for command in cli.COMMANDS:
        cli.main([command, source, str(tmp_path / command)], spark)
    read = lambda name: spark.read.json(str(tmp_path / name)).collect()
    assert {r.type_id: r["items"] for r in read("evaluate")} == {"diagrams.dfd.concepts": 2}
    assert {r.seq: r.decision for r in read("refine")} == {0: "add", 1: "skip", 2: "add"}
    assert sorted(r.chunk_id for r in read("index")) == ["concepts_0_a", "concepts_1_a", "odd_3_overview", "theory_2_overview"]
    assert {(r.type_id, r.file_name): r.sources for r in read("merge")} == {("diagrams.dfd.concepts", "concepts_unknown.json"): ["u"], ("theory", "theory_unknown.json"): ["w"], ("odd", "odd_unknown.json"): []}
