"""Path filter and layer map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.errors import EngineError
from changelens.functions.columns import LONG_LIST, ancestors, under, under_any


def normal_prefix(prefix: str) -> str:
    """Without white space around it, then without slashes at its end."""
    return prefix.strip().rstrip("/")


def ensure_include(prefixes: tuple[str, ...]) -> list[str]:
    found = [normal_prefix(p) for p in prefixes]
    if not all(found):
        raise EngineError("`--include` prefix must be non-empty")
    return found


def filter_paths(changes: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Keep paths under an include prefix, if there are any, and under no exclude prefix."""
    keep, drop = ensure_include(include), [normal_prefix(p) for p in exclude]
    if drop:
        changes = changes.where(~under_any(F.col("entity"), drop))
    return changes.where(under_any(F.col("entity"), keep)) if keep else changes


def map_layers(changes: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Replace each entity by the layer of the first rule whose prefix it is under.

    A long rule list is a broadcast lookup by ancestor path: a path has as many
    ancestors as it has parts, so no row meets every rule.
    """
    if not rules:
        return changes
    if len(rules) <= LONG_LIST:
        layer = F.when(under(F.col("entity"), rules[0][0]), F.lit(rules[0][1]))
        for prefix, name in rules[1:]:
            layer = layer.when(under(F.col("entity"), prefix), F.lit(name))
        return changes.withColumn("entity", layer.otherwise(F.col("entity")))
    table = changes.sparkSession.createDataFrame([(i, p, n) for i, (p, n) in enumerate(rules)], "rule int, prefix string, layer string")
    table = table.groupBy("prefix").agg(F.min_by("layer", "rule").alias("layer"), F.min("rule").alias("rule"))
    entities = changes.select("entity").distinct()
    found = entities.withColumn("prefix", F.explode(ancestors(F.col("entity")))).join(table, "prefix").groupBy("entity").agg(F.min_by("layer", "rule").alias("layer"))
    columns = [F.coalesce("layer", "entity").alias("entity") if c == "entity" else F.col(c) for c in changes.columns]
    return changes.join(found, "entity", "left").select(*columns)
