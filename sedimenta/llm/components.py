"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.storage import drop_dir, fresh_dir


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Large stars (``both``: every node links its larger neighbours to its least one) or small stars (its smaller ones and itself).

    The least neighbour is a partial aggregate and comes back by a join, so
    a node with very many links is one row in it and never one task's list.
    """
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.unionByName(swapped) if both else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = seen.join(least, "a")
    if both:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    others = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end of another."""
    ends = edges.groupBy(F.col("a").alias("x")).agg(F.count(F.lit(1)).alias("up")).withColumn("down", F.lit(0)).unionByName(edges.select(F.col("b").alias("x")).distinct().withColumns({"up": F.lit(0).cast("long"), "down": F.lit(1)}))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges(a, b)`` the least node it is linked to, directly or not.

    Nodes are of any ordered type. Links with a null end and loops say
    nothing; repeated links count once; no links give no rows. A node that is
    in no link is not returned: it is its own component. Each round writes
    the remaining links to the shared folder and drops the round before; the
    links are done when they are stars, whose centres are their least nodes.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    schema, last = edges.schema, None
    while True:
        path = fresh_dir(spark, "components")
        edges.write.parquet(path)
        edges = spark.read.schema(schema).parquet(path)
        if last:
            drop_dir(spark, last)
        last = path
        if _are_stars(edges):
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
        edges = _stars(_stars(edges, True), False)
