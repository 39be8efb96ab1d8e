"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import WRITTEN, materialize, release


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another one.

    A component is named by its smallest node. Large-star and small-star steps
    alternate: each links a node's neighbours to the smallest among them, with
    aggregates and joins only. A node with very many neighbours is found by aggregates
    that combine before the shuffle, and its edges are joined in SALTS parts. The edges
    are written to the shared folder after each round, and those of the round before
    removed.
    """
    spark, since = edges.sparkSession, len(WRITTEN)
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _joined(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, low).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(spark, since, keep=[e])
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: The edges of a node are joined with what is known of it in so many parts.
SALTS = 8


def _joined(e: DataFrame, low: DataFrame) -> DataFrame:
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])


def _are_stars(e: DataFrame) -> bool:
    """Whether each node above has one node below, which is below all its neighbours."""
    ends = e.select(F.col("u").alias("n"), "v").unionByName(e.select(F.col("v").alias("n"), F.lit(None).cast("long").alias("v")))
    each = ends.groupBy("n").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("up"), F.count("*").alias("all"))
    return each.where("up > 0 and (up < all or low < high)").isEmpty()
