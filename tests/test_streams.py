"""The state of seen addresses: visits renew it, it ends, and a restarted stream goes on with it."""

import datetime as dt

from sedimenta.streaming import dedup

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
SCHEMA = "url string, ts timestamp"


def deliver(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")


def run(spark, folder):
    """Start the stream from its checkpoint, take what has arrived, and end it."""
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = dedup.first_visits(stream, ["url"], "ts", dt.timedelta(days=30))
    found.writeStream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.url or "", (r.ts - DAY(0)).days, (r.first_seen - DAY(0)).days, r.visits) for r in spark.read.parquet(f"{folder}/out").collect())


def test_visits_renew_the_time_to_live(spark, tmp_path):
    deliver(spark, tmp_path, 1, [("a", DAY(0)), ("b", DAY(0)), ("b", DAY(0)), (None, DAY(1)), ("n", None)])
    assert run(spark, tmp_path) == [("", 1, 1, 0), ("a", 0, 0, 0), ("b", 0, 0, 0)]
    deliver(spark, tmp_path, 2, [("a", DAY(25))])
    assert len(run(spark, tmp_path)) == 3
    deliver(spark, tmp_path, 3, [("a", DAY(50)), ("b", DAY(50))])
    out = run(spark, tmp_path)
    assert ("b", 50, 0, 2) in out and len(out) == 4  # the visit of day 25 kept a
    deliver(spark, tmp_path, 4, [("a", DAY(81)), ("a", DAY(82)), ("a", DAY(120))])
    assert [r[1] for r in run(spark, tmp_path) if r[0] == "a"] == [0, 81, 120]
