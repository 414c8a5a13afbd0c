from sedimenta.llm import common


def test_only_plain_scans_are_read_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert common.scanned(docs) is docs
    assert common.scanned(docs.where("lang = 'en'") if "lang" in docs.columns else docs.where("doc_id > 3")).inputFiles() == docs.inputFiles()
    for other in (docs.repartition(3), docs.dropDuplicates(), docs.orderBy("text"), docs.limit(5), docs.mapInArrow(lambda b: b, docs.schema), spark.createDataFrame([(1, "a")], "doc_id long, text string")):
        kept = common.scanned(other)
        assert kept.inputFiles() != docs.inputFiles() and kept.count() == other.count()
