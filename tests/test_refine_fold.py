"""Refinement in order, held against one plain loop over all artifacts."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from sedimenta.operators import refine_fold as R
from sedimenta.sources.pages import concept_artifacts
from sedimenta.sources.versions import VersionedTable

from .conftest import SF

CONCEPTS = "diagrams.dfd.concepts"


def looped(rows):
    """(seq, decision, match) and the entries of one loop over rows(seq, type, url, body) of types that hold elements alone."""
    entries, out = [], []
    ids = lambda d: ({str(e["id"]).lower() for e in d["elements"] if e.get("id")}, {str(e["name"]).lower() for e in d["elements"] if e.get("name")})
    for seq, _, _, body in sorted(rows):
        new, best, at = json.loads(body), 0.0, None
        for k, (_, old) in enumerate(entries):
            shares = [len(a & b) / len(a | b) for a, b in zip(ids(new), ids(old), strict=True) if a | b]
            if shares and sum(shares) / len(shares) > best:
                best, at = sum(shares) / len(shares), k
        if best < 0.6:
            entries.append([str(seq), new])
            out.append((seq, "add", None))
            continue
        name, old = entries[at]
        more = any(a - b for a, b in zip(ids(new), ids(old), strict=True)) or len(new.get("description", "")) > 1.2 * len(old.get("description", ""))
        out.append((seq, "merge" if more else "skip", name))
        if more:
            have = {str(e.get("id") or e.get("name") or "").lower() for e in old["elements"]}
            entries[at][1] = old | {"elements": old["elements"] + [e for e in new["elements"] if (e.get("id") or e.get("name")) and str(e.get("id") or e.get("name")).lower() not in have]}
    return out, [(n, json.dumps(e, sort_keys=True)) for n, e in entries]


def artifact(names, description=""):
    return json.dumps({"description": description, "elements": [{"id": n, "name": n.upper()} for n in names]})


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "seq long, type_id string, source_url string, body string").repartition(3)
    decided, left = R.refine(df, **options)
    got = Counter((r.seq, r.decision, r.match) for r in decided.collect()), Counter((r.entry, json.dumps(json.loads(r.body), sort_keys=True)) for r in left.collect())
    want = looped(rows)
    assert got == (Counter(want[0]), Counter(want[1]))
    return want


def test_a_merge_makes_a_duplicate_of_another_part(spark):
    # 2 makes abcdef of 0; 3 is half like 0 and half like 2, but 0.67 like what the merge made
    rows = [(0, CONCEPTS, "u0", artifact("abcde")), (1, CONCEPTS, "u1", artifact("vwxyz")), (2, CONCEPTS, "u2", artifact("abcdf")), (3, CONCEPTS, "u3", artifact("abef"))]
    decided, _ = check(spark, rows)
    assert [d for _, d, _ in decided] == ["add", "add", "merge", "skip"]
    check(spark, rows, crowd=0)


def test_random_artifacts_equal_the_loop(spark):
    draw = random.Random(5)
    pool = [f"n{i}" for i in range(60)]
    rows = [(i, CONCEPTS, f"u{i}", artifact(draw.sample(pool[(s := draw.randrange(0, 52, 4)) : s + 9], draw.randint(2, 8)), "x" * draw.randint(0, 9))) for i in range(250)]
    decided, _ = check(spark, rows)
    assert len({d for _, d, _ in decided}) == 3
    check(spark, rows, crowd=3)


def test_copies_by_hundreds_share_one_part(spark):
    rows = [(i, CONCEPTS, "u", artifact("abcd" if i % 3 else ["p", f"q{i}"])) for i in range(400)]
    check(spark, rows)


def test_hard_rows(spark):
    bodies = [None, "no json", "[]", "{}", '{"elements": 3}', '{"elements": [null, 1, "x", {}]}', '{"elements": [{"id": 0, "name": ""}]}', '{"elements": [{"id": 1.5, "name": true}]}', '{"elements": [{"id": "1.5", "name": "TRUE"}]}']
    rows = [(i, CONCEPTS, None, b) for i, b in enumerate(bodies)] + [(None, None, None, None), (7, "unknown", "u", '{"a": 1}')]
    df = spark.createDataFrame(rows, "seq long, type_id string, source_url string, body string")
    decided, left = R.refine(df)
    got = {(r.seq, r.type_id): r.decision for r in decided.collect()}
    assert got.pop((8, CONCEPTS)) == "skip" and set(got.values()) == {"add"} and len(got) == 10
    assert left.count() == 10
    decided, left = R.refine(df.limit(0))
    assert decided.count() == left.count() == 0


def test_given_artifacts_equal_the_loop(spark):
    rows = [(r.seq, r.type_id, r.source_url, r.body) for r in concept_artifacts(spark, SF).collect()]
    want, entries = looped(rows)
    assert Counter((r.seq, r.decision, r.match) for r in R.r03_refined_in_order(spark, SF).collect()) == Counter(want)
    got = {r.entry: r.elements for r in R.r03_refined_entries(spark, SF).collect()}
    assert got == {n: len(json.loads(e)["elements"]) for n, e in entries}


def test_saved_knowledge_comes_first_and_a_dry_run_saves_nothing(spark, tmp_path):
    saved = VersionedTable(spark, str(tmp_path / "kb"), R.ENTRIES)
    make = lambda rows: spark.createDataFrame(rows, "seq long, type_id string, source_url string, body string")
    first = make([(1, CONCEPTS, "u1", json.dumps(json.loads(artifact("abc")) | {"content_slug": "one two"}))])
    assert [r.decision for r in R.refine_and_save(first, saved, dry_run=True).collect()] == ["add"] and saved.version() == 0
    R.refine_and_save(first, saved)
    again = R.refine_and_save(make([(1, CONCEPTS, "u2", artifact("abcd")), (2, CONCEPTS, "u3", artifact("ab"))]), saved)
    assert {(r.seq, r.decision, r.match) for r in again.collect()} == {(1, "merge", "concepts_one_two.json"), (2, "add", None)}
    kept = {r.file_name: (len(json.loads(r.body)["elements"]), r.sources) for r in saved.read().collect()}
    assert kept == {"concepts_one_two.json": (4, ["u1", "u2"]), "concepts_unknown.json": (2, ["u3"])}
    assert saved.version() == 2 and saved.read().where(F.col("type_id") != CONCEPTS).count() == 0
