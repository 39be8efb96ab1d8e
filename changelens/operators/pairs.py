"""Pairs of members of the same group, however large the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a block: a group of more is paired block by block, in many tasks.
BLOCK = 512


def pairs_within(members: DataFrame, group: str, member: str, size: Column, block: int = BLOCK) -> DataFrame:
    """(group, a, b, ...) for any two members a < b of a group, with the other columns that
    ``members`` has as a_... and b_...; ``size``: of the group, at least about.

    Members are dealt into blocks by hash, and any two blocks of a group meet in a join
    of their own: no group stands in one task, or in one row.
    """
    blocks = F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    own = members.select("*", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64(F.lit("block"), F.col(member)), F.col("blocks")).cast("int"))
    rest = [c for c in members.columns if c not in (group, member)]
    side = lambda p: [F.col(member).alias(f"{p}_"), *(F.col(c).alias(f"{p}_{c}") for c in rest)]
    left = own.select(group, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *side("l"))
    right = own.select(group, F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *side("r"))
    both = left.join(right, [group, "i", "j"]).where((F.col("l_") != F.col("r_")) & ((F.col("i") < F.col("j")) | (F.col("l_") < F.col("r_"))))
    ordered = F.col("l_") < F.col("r_")
    pick = lambda first, c: F.when(ordered == F.lit(first), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}"))
    return both.select(group, pick(True, "").alias("a"), pick(False, "").alias("b"), *(pick(first, c).alias(f"{p}_{c}") for c in rest for p, first in (("a", True), ("b", False))))
