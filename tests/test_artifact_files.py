import json

from sedimenta.sources import artifact_files as A


def tree(spark, root):
    day, other = "2024/01/15/10_30/a.com/x y+z", "2024/01/16/09_05/b.org/s"
    rows = [
        (f"{day}/dfd_rules_a_x_1.json", json.dumps({"rules": []}, indent=2)),
        (f"{day}/theory_a.json", '{"cut": '),
        (f"{day}/notes.json", "{}"),
        (f"{day}/metadata.json", '{"url": "http://a.com/x"}'),
        (f"{day}/parsed.json", '{"source_url": "http://parsed"}'),
        (f"{day}/trace.json", "no json"),
        ("2024/01/15/11_00/a.com/t/domain_a.json", "{}"),
        ("2024/01/15/11_00/a.com/t/metadata.json", "cut {"),
        ("2024/01/15/11_00/a.com/t/parsed.json", '{"url": "http://by-url"}'),
        (f"{other}/schema_b.json", "[1]"),
        (f"{other}/mappings_b.json", "  "),
        (None, "{}"),
    ]
    return A.write_files(spark.createDataFrame(rows, "path string, content string"), root), day, other


def test_scan_of_a_tree(spark, tmp_path):
    root = str(tmp_path / "artifacts")
    n, day, other = tree(spark, root)
    assert n == 11
    found, bad = A.scan_artifacts(spark, root)
    assert sorted((r.path, r.type_id, r.source_url) for r in found.collect()) == [
        (f"{day}/dfd_rules_a_x_1.json", "diagrams.dfd.rules", "http://a.com/x"),
        ("2024/01/15/11_00/a.com/t/domain_a.json", "domain", "http://by-url"),
        (f"{other}/schema_b.json", "schema", ""),
    ]
    assert sorted(r.path for r in bad.collect()) == [f"{day}/theory_a.json", f"{other}/mappings_b.json"]
    assert json.loads(found.where("type_id = 'diagrams.dfd.rules'").first().body) == {"rules": []}


def test_days_and_times_narrow_what_is_opened(spark, tmp_path):
    root = str(tmp_path / "artifacts")
    _, day, _ = tree(spark, root)
    files = A.json_files(spark, root, "2024-01-15")
    assert len(files.inputFiles()) == 9 and all("/2024/01/15/" in f for f in files.inputFiles())
    found, bad = A.scan_artifacts(spark, root, "2024/01/15", "10:30")
    assert [r.type_id for r in found.collect()] == ["diagrams.dfd.rules"] and bad.count() == 1
    assert A.scan_artifacts(spark, root, "2023-01-01")[0].count() == 0


def test_files_written_again_are_the_same(spark, tmp_path):
    root = str(tmp_path / "artifacts")
    assert tree(spark, root)[0] == tree(spark, root)[0]
    assert A.json_files(spark, root).count() == 11 and not [p for p in (tmp_path / "artifacts").rglob("*") if p.is_file() and p.suffix != ".json"]
