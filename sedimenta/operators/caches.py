"""Crawl caches and joins: seen keys with a time to live, upserts, splits of new and seen rows, trends, structural duplicates.

Events stand for visits: a user and an event type are a cache key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import NORMALIZED_SQL, normalized
from ..session import table

KEY = ["user_id", "event_type"]


def with_seen(visits: DataFrame, keys: list[str], ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """Adds `seen`: whether the same key was visited within the time to live before (each visit renews it).

    A visit within reach lies in the same bucket of ttl_seconds or the one before, so that a key of a third
    of all rows is dealt by bucket too: the last visit of each bucket is a maximum.
    """
    rows = visits.withColumn("bucket", F.expr(f"unix_micros(cast({ts} as timestamp)) div {ttl_seconds * 1_000_000}"))
    last = rows.groupBy(*keys, (F.col("bucket") + 1).alias("bucket")).agg(F.max(ts).alias("_before"))
    within = Window.partitionBy(*keys, "bucket").orderBy(ts, tie)
    rows = rows.withColumn("_previous", F.lag(ts).over(within)).join(last, [*keys, "bucket"], "left")
    near = F.expr(f"unix_micros(cast({ts} as timestamp)) - unix_micros(cast(coalesce(_previous, _before) as timestamp)) <= {ttl_seconds * 1_000_000}")
    return rows.withColumn("seen", F.coalesce(near, F.lit(False))).drop("bucket", "_before", "_previous")


def d01_ttl_duplicates(spark: SparkSession, sf_dir: str, ttl_seconds: int = 6 * 3600) -> DataFrame:
    return with_seen(table(spark, sf_dir, "events"), KEY, "ts", "event_id", ttl_seconds).select("event_id", "seen")


def d07_cache_stats(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """Keys in all, those last visited within `days` days of the newest visit or before, distinct contents, and the setting: partial sums."""
    last = table(spark, sf_dir, "events").groupBy(*KEY).agg(F.max("ts").alias("last"))
    newest = table(spark, sf_dir, "events").agg(F.max("ts").alias("newest"))  # one row
    live = F.expr(f"last > newest - interval {days} days")
    return last.join(F.broadcast(newest), F.lit(True)).agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(~live).alias("expired")).join(
        F.broadcast(table(spark, sf_dir, "events").agg(F.count_distinct("props").alias("contents"), F.lit(days).alias("ttl_days"))), F.lit(True)
    )  # one row each


def k11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after all visits: a visit after the time to live of 6 hours replaces the row, any other counts it up."""
    runs = table(spark, sf_dir, "events").groupBy(*KEY, F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("crawl_count"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    kept = runs.groupBy(*KEY).agg(F.max(F.struct("first", "last", "crawl_count")).alias("r"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return kept.select(*KEY, F.date_format("r.first", stamp).alias("first_crawled"), F.date_format("r.last", stamp).alias("last_crawled"), "r.crawl_count")


def j01_new_or_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose canonical URL an earlier page has are skipped."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2(normalized(), 256).alias("url_hash"))
    cache = pages.groupBy("url_hash").agg(F.min("page_id").alias("first_page_id"))
    return pages.join(cache, "url_hash").select("page_id", F.expr("if(page_id = first_page_id, 'new', 'skipped')").alias("status"))


def j13_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each event type from the middle of January on against those before; only types of both."""
    now, base = (F.expr(f"ts {op} timestamp '2024-01-16 00:00:00'") for op in (">=", "<"))
    mean = {k: F.avg(F.when(c, F.col("value"))) for k, c in (("now", now), ("base", base))}
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(now).alias("n_now"), F.count_if(base).alias("n_base"), F.round(mean["now"] - mean["base"], 4).alias("mean_delta"))
    return rows.where("n_now > 0 and n_base > 0").selectExpr("event_type", "n_now - n_base as count_delta", "mean_delta")


def structural_duplicates(items: DataFrame, least: float) -> DataFrame:
    """item_id, match_id, similarity: of each item with a set of values, the most similar earlier item by Jaccard.

    items: (item_id, value). Equal sets are one class, of its smallest id; classes are compared by an equi-join
    on prefixes of their rarest values, which any two sets of the least similarity share. Items of a class
    other than its smallest match that one; ties go to the smaller id; items without a match are left out.
    """
    frequency = items.groupBy("value").agg(F.count("*").alias("f"))
    sets = items.join(frequency, "value").groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("f", "value"))).alias("s"))
    sets = sets.select("item_id", F.expr("transform(s, x -> x.value)").alias("s"))
    classes = sets.groupBy("s").agg(F.min("item_id").alias("class_id"))
    members = sets.join(classes, "s").where("item_id <> class_id").selectExpr("item_id", "class_id as match_id", "1.0D as similarity")
    prefix = F.expr(f"slice(s, 1, size(s) - cast(ceil({least} * size(s)) as int) + 1)")
    marks = F.expr("aggregate(s, 0L, (m, v) -> m | shiftleft(1L, cast(pmod(xxhash64(v), 64) as int)))")
    keyed = classes.select("class_id", "s", marks.alias("m"), F.posexplode(prefix).alias("i", "value"))
    a = keyed.select("value", "i", F.col("m").alias("ma"), F.col("class_id").alias("item_id"), F.col("s").alias("sa"))
    b = keyed.select("value", F.col("i").alias("j"), F.col("m").alias("mb"), F.col("class_id").alias("match_id"), F.col("s").alias("sb"))
    # two sets share what is left of them from this value on at most, and no more than their marks have in common, but for values that share a mark
    shared = "least(size(sa) - i, size(sb) - j, bit_count(ma & mb) + size(sa) - bit_count(ma))"
    left = f"{shared} >= {least / (1 + least)} * (size(sa) + size(sb)) - 1e-9"
    near = f"match_id < item_id and size(sa) >= {least} * size(sb) and size(sb) >= {least} * size(sa) and {left}"
    pairs = a.join(b, "value").where(near)
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).withColumn("similarity", F.expr("cast(shared as double) / (size(sa) + size(sb) - shared)"))
    best = pairs.where(F.col("similarity") >= least).groupBy("item_id").agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("m"))).alias("b"))
    return members.unionByName(best.selectExpr("item_id", "-b.m as match_id", "b.similarity"))


def j06_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose suppliers are those of an earlier order to six tenths or more."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("value")).distinct()
    return structural_duplicates(items, 0.6).withColumn("similarity", F.round("similarity", 4))


QUERIES = {q.__name__: q for q in (d01_ttl_duplicates, d07_cache_stats, k11_upsert, j01_new_or_skipped, j13_trend, j06_structural)}
ORACLES = {
    "d01_ttl_duplicates": "SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 6 HOURS, false) AS seen FROM events",
    "d07_cache_stats": """WITH l AS (SELECT max(ts) AS last FROM events GROUP BY user_id, event_type), n AS (SELECT *, (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AS cut FROM l)
      SELECT count(*) AS total, count(*) FILTER (last > cut) AS active, count(*) FILTER (last <= cut) AS expired, (SELECT count(DISTINCT props) FROM events) AS contents, 7 AS ttl_days FROM n""",
    "k11_upsert": """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events),
      s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM p),
      r AS (SELECT user_id, event_type, run, min(ts) AS f, max(ts) AS l, count(*) AS crawl_count FROM s GROUP BY 1, 2, 3)
      SELECT user_id, event_type, strftime(f, '%Y-%m-%d %H:%M:%S') AS first_crawled, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_crawled, crawl_count FROM r
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY run DESC) = 1""",
    "j01_new_or_skipped": NORMALIZED_SQL + " SELECT page_id, CASE WHEN page_id = min(page_id) OVER (PARTITION BY normalized_url) THEN 'new' ELSE 'skipped' END AS status FROM n WHERE normalized_url IS NOT NULL",
    "j13_trend": """WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS now FROM events), t AS (SELECT event_type, count(*) FILTER (now) AS a, count(*) FILTER (NOT now) AS b,
      round(avg(value) FILTER (now) - avg(value) FILTER (NOT now), 4) AS mean_delta FROM e GROUP BY 1) SELECT event_type, a - b AS count_delta, mean_delta FROM t WHERE a > 0 AND b > 0""",
    "j06_structural": """WITH i AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem), n AS (SELECT k, count(*) AS n FROM i GROUP BY 1),
      c AS (SELECT a.k AS item_id, b.k AS match_id, count(*) AS c FROM i a JOIN i b ON a.v = b.v AND b.k < a.k GROUP BY 1, 2),
      j AS (SELECT item_id, match_id, c / CAST(x.n + y.n - c AS DOUBLE) AS s FROM c JOIN n x ON x.k = item_id JOIN n y ON y.k = match_id)
      SELECT item_id, match_id, round(s, 4) AS similarity FROM j WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, match_id) = 1""",
}
