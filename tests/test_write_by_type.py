"""Knowledge by type is packed: what lies on disk is far less than the bodies."""

from pathlib import Path

from pyspark.sql import functions as F

from sedimenta.session import shared_folder
from sedimenta.sources import stores
from sedimenta.sources.pages import artifacts

SF = "/root/testdata/sf0.001"


def folders(spark):
    return set(Path(shared_folder(spark).removeprefix("file:")).glob("knowledge-*"))


def test_load_type_is_packed(spark):
    before = folders(spark)
    assert len(stores.s03_load_type(spark, SF).collect()) == 150
    (path,) = folders(spark) - before
    held = sum(p.stat().st_size for p in path.rglob("part-*"))
    assert held * 4 < artifacts(spark, SF).agg(F.sum(F.octet_length("body"))).first()[0]
    assert len([p for p in path.iterdir() if p.name.startswith("type_id=")]) == 10


def test_types_of_all_kinds_come_back(spark, tmp_path):
    rows = [(1, "theory", '{"a":"b\\n"}'), (2, "theory", None), (3, "other", "x"), (4, None, "y"), (5, "domain", "é")]
    stores.write_by_type(spark.createDataFrame(rows, "seq long, type_id string, body string"), f"{tmp_path}/k")
    back = stores.scan_knowledge(spark, f"{tmp_path}/k", "seq long, body string, type_id string", ("type_id",))
    assert sorted((r.seq, r.type_id, r.body) for r in back.collect()) == rows
