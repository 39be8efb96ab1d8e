"""Per-entity and per-author measures that several analyses are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.columns import logical_rev, percent
from changelens.options import Options


NO_COUNTS = "analysis requires numstat line counts; use `-c git2` or a numstat log"


def missing() -> Column:
    """How many rows lack a count, for aggregates."""
    return F.count_if(F.col("added").isNull() | F.col("deleted").isNull()).alias("missing")


def complete(condition: Column | None = None) -> Column:
    """A condition on groups that have ``missing()``: it stops the run where a row lacks a
    count. Being above the aggregate it is tried for every group, in the same pass."""
    return F.when(F.col("missing") > 0, F.raise_error(F.lit(NO_COUNTS))).otherwise(F.lit(True) if condition is None else condition)


def revisions(changes: DataFrame, rev: Column | None = None) -> DataFrame:
    """(entity, n_revs)"""
    return changes.groupBy("entity").agg(F.countDistinct(F.col("rev") if rev is None else rev).alias("n_revs"))


def author_revisions(changes: DataFrame, rev: Column | None = None) -> DataFrame:
    """(entity, author, author_revs)"""
    return changes.groupBy("entity", "author").agg(F.countDistinct(F.col("rev") if rev is None else rev).alias("author_revs"))


def often_changed(changes: DataFrame, options: Options, counted: bool = False) -> DataFrame:
    """(entity) of those with at least ``min_revs`` commits; with ``counted`` the run stops
    where a row lacks a count, whatever its entity."""
    often = F.col("n_revs") >= options.min_revs
    if not counted:
        return revisions(changes).where(often).select("entity")
    return changes.groupBy("entity").agg(F.countDistinct("rev").alias("n_revs"), missing()).where(complete(often)).select("entity")


def memberships(changes: DataFrame, options: Options) -> DataFrame:
    """(lrev, entity, size): each entity of each logical commit, with how many it has."""
    return sized(changes.select(logical_rev(options.temporal_period).alias("lrev"), "entity").distinct())


def sized(pairs: DataFrame) -> DataFrame:
    """Pairs (lrev, entity) with how many entities the commit has.

    Sizes come from an aggregate and a join, not from gathering commits: one commit may
    touch very many entities.
    """
    return pairs.join(pairs.groupBy("lrev").agg(F.count("*").alias("size")), "lrev")


def sum_of_coupling(members: DataFrame, options: Options) -> DataFrame:
    """(entity, soc) over the commits that aren't too large; other entities are absent."""
    return members.where(F.col("size") <= options.max_changeset_size).groupBy("entity").agg(F.sum(F.col("size") - 1).alias("soc"))


def fragmentation(by_author: DataFrame, totals: DataFrame, *more: Column) -> DataFrame:
    """(entity, n_revs, fragmentation, more): 100 * (1 - sum of squared shares of authors),
    and other aggregates over the authors.

    Squares are added in order of author name, so the last bit doesn't depend on the
    shuffle: by a running sum, whose last value counts, so no entity's authors are
    gathered.
    """
    joined = by_author.join(totals, "entity")
    square = F.pow(percent(F.col("author_revs"), F.col("n_revs")) / 100.0, F.lit(2.0))
    order = Window.partitionBy("entity").orderBy("author").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = joined.withColumn("so_far", F.sum(square).over(order)).withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("author")))
    total = so_far.groupBy("entity").agg(F.any_value("n_revs").alias("n_revs"), F.max_by("so_far", "place").alias("total"), *more)
    names = [c for c in total.columns if c not in ("entity", "n_revs", "total")]
    return total.select("entity", "n_revs", F.when(F.col("n_revs") == 0, 0.0).otherwise((F.lit(1.0) - F.col("total")) * F.lit(100.0)).alias("fragmentation"), *names)


def largest(value: str, by: str) -> Column:
    """The value with the largest ``by``; of several, the largest value."""
    return F.max_by(value, F.struct(by, value))
