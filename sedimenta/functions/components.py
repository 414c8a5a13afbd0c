"""Connected components of a link table by contraction along random priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for both ends of links(a, b) of long ids; a component is named by one of its nodes.

    In each round every node takes the neighbour of the least hash, itself included, for its parent, and links
    join parents from then on: a constant share of the nodes goes in a round, whatever the shape. A node of any
    degree is only pre-aggregated and joined. Null ends and loops count as no links, but a loop names its node.
    """
    ends = links.where("a is not null and b is not null")
    place = written(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "places")
    edges = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        parent = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["v"].alias("up")), "parents")
        place = written(place.join(parent.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "places")
        moved = edges.join(parent.withColumnRenamed("up", "x"), "a").join(parent.selectExpr("a as b", "up as y"), "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return place
