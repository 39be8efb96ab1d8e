"""Running an analysis over changes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.errors import EngineError
from changelens.functions.columns import cell
from changelens.operators.analyses import ANALYSES
from changelens.operators.grain import to_functions
from changelens.operators.transforms import filter_paths, map_layers
from changelens.options import Options
from changelens.sources.layers import read_rules

#: Columns shown with two fraction digits.
PERCENTAGES = ("risk", "fragmentation", "ownership")


def analysis_names() -> list[str]:
    return sorted(ANALYSES)


def run(name: str, changes: DataFrame, options: Options = Options(), place: str | None = None) -> DataFrame:
    """The sorted table of an analysis, at most ``rows`` rows of it; percentages are doubles.

    ``place`` names a column for each row's place, from 1. It needs ``rows``: places are
    given in one task, to those rows only.
    """
    if name not in ANALYSES:
        raise EngineError(f"unknown analysis `{name}`; expected one of: {', '.join(analysis_names())}")
    if place and options.rows is None:
        raise EngineError("places are given to a limited number of rows only")
    df, keys = ANALYSES[name](changes, options)
    if keys:
        df = df.orderBy(*keys)
    if options.rows is not None:
        df = df.limit(options.rows)
    if place:
        df = df.withColumn(place, F.row_number().over(Window.orderBy(*keys or [F.lit(0)])).cast("long"))
    return df.drop("k", "pos")


def cells(df: DataFrame) -> DataFrame:
    """The table with its percentages as they are shown."""
    return df.select(*(cell(F.col(c)).alias(c) if c in PERCENTAGES else F.col(c) for c in df.columns))


def prepared(changes: DataFrame, options: Options, diffs: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Path filter, function grain, then layers; and what function grain dropped."""
    changes, dropped = filter_paths(changes, options.include, options.exclude), {"non_rust": 0, "no_overlap": 0}
    if options.grain == "function":
        if diffs is None:
            raise EngineError("function grain requires a table of file diffs")
        changes, dropped = to_functions(changes, diffs)
    if options.group_file:
        changes = map_layers(changes, read_rules(_text(changes.sparkSession, options.group_file)))
    return changes, dropped


@contextmanager
def named_path(what: str, path: str) -> Iterator[None]:
    """A path that can't be read is an error for the user that names it."""
    try:
        yield
    except AnalysisException as e:
        raise EngineError(f"cannot read {what}: {path}") from e


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text; layer maps are written by hand."""
    with named_path("layer map", path):
        rows = spark.read.option("wholetext", True).text(path).limit(1).collect()
    return rows[0]["value"] if rows else ""
