"""Commit logs as tables of changes.

A log is read line by line, in as many splits as it has, whatever files it stands in: one
commit may be spread over many of them.  The header above a line is carried within a
split as its lines stream by; lines before the first header of a split belong to the last
header of the splits before, which one row a split is enough to find.  The same pass
parses the lines, writes them to the shared folder and finds the first bad one, so a log
is read once however many scans an analysis makes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from changelens.errors import EngineError
from changelens.functions.columns import let, valid_date
from changelens.options import MAX_CHANGE_ROWS
from changelens.sources.shared import held, written


def _git2_header(line: Column) -> dict[str, Column]:
    def checked(part: Column) -> Column:
        rev, date, author = (F.coalesce(F.get(part, F.lit(i)), F.lit("")) for i in range(3))
        bad = (
            F.when(F.size(part) < 2, F.lit("git2 header missing date"))
            .when(F.size(part) < 3, F.lit("git2 header missing author"))
            .when((rev == "") | (date == "") | (author == ""), F.concat(F.lit("malformed git2 header: "), line))
            .when(~valid_date(date), F.concat(F.lit("malformed git2 header date (expected YYYY-MM-DD): "), line))
        )
        return F.struct(rev.alias("rev"), author.alias("author"), date.alias("date"), bad.alias("bad"))

    found = let(F.split(F.substring(line, 3, 1 << 30), "--", 3), checked)
    return {k: found[k] for k in ("rev", "author", "date", "bad")}


def _legacy_header(line: Column) -> dict[str, Column]:
    marked = r"(?s)^((?:[^<]* )?)<(\d{4}-\d{2}-\d{2})>(?= |$)"
    bare = r"(?s)^(.*?)(?<![^\s])(\d{4}-\d{2}-\d{2})(?![^\s])"
    two = lambda text, pattern: F.struct(F.regexp_extract(text, pattern, 1).alias("a"), F.regexp_extract(text, pattern, 2).alias("b"))
    opened = two(line, r"(?s)^\[([^\]]*)\](?U:\s*)(.*)$")

    def of_rest(x: Column) -> Column:
        either = let(two(x["b"], marked), lambda m: F.when(m["b"] != "", m).otherwise(two(x["b"], bare)))
        return let(either, lambda y: F.struct(x["a"].alias("rev"), F.regexp_replace(y["a"], r"(?U)^\s+|\s+$", "").alias("author"), y["b"].alias("date")))

    def checked(x: Column) -> Column:
        bad = (
            F.when(~line.contains("]"), F.concat(F.lit("legacy header missing `]`: "), line))
            .when(x["rev"] == "", F.concat(F.lit("legacy header missing rev: "), line))
            .when(x["date"] == "", F.concat(F.lit("legacy header missing date: "), line))
            .when(x["author"] == "", F.concat(F.lit("legacy header missing author: "), line))
            .when(~valid_date(x["date"]), F.concat(F.lit("invalid date `"), x["date"], F.lit("`")))
        )
        return F.struct(x["rev"].alias("rev"), x["author"].alias("author"), x["date"].alias("date"), bad.alias("bad"))

    found = let(let(opened, of_rest), checked)
    return {k: found[k] for k in ("rev", "author", "date", "bad")}


#: What a header line is, and the (rev, author, date, bad) that it holds.
Format = tuple[Callable[[Column], Column], Callable[[Column], dict[str, Column]]]
FORMATS: dict[str, Format] = {"git2": (lambda line: line.startswith("--"), _git2_header), "git": (lambda line: line.startswith("["), _legacy_header)}


def register_format(name: str, is_header: Callable[[Column], Column], header: Callable[[Column], dict[str, Column]]) -> None:
    """Add a format of logs: numstat lines under headers of another form.

    ``header`` gives the columns rev, author, date and bad, the error of a header that
    can't be read and else null, for lines where ``is_header`` holds.
    """
    if name in FORMATS:
        raise EngineError(f"format `{name}` is there already")
    FORMATS[name] = (is_header, header)


def _format(name: str) -> Format:
    if name not in FORMATS:
        raise EngineError(f"unknown vcs `{name}`; expected {' or '.join(f'`{x}`' for x in sorted(FORMATS))}")
    return FORMATS[name]


#: White space of Unicode, as ``\s`` of a pattern with (?U).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_UTF8 = "stream did not contain valid UTF-8"
#: Kinds of rows: a change or header under a known header; a line before the first header
#: of its split; and, once a split, its last header.
HEADED, AHEAD, LAST = 0, 1, 2


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (split, ..., head) with the head of the last header line above them in their
    split, their kind, and a row for the last header of each split."""
    split, head, last = None, None, None

    def rows_of(batch: pa.RecordBatch, heads: pa.Array, kind: np.ndarray) -> pa.RecordBatch:
        columns = {c: batch.column(c) for c in batch.schema.names} | {"head": heads, "kind": pa.array(kind, pa.int32())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    for batch in batches:
        if not batch.num_rows:
            continue
        n, splits, heads = batch.num_rows, batch.column("split").to_numpy(), batch.column("head")
        at = np.arange(n)
        starts = np.concatenate([[split is None or splits[0] != split], splits[1:] != splits[:-1]])
        if starts[0] and last is not None:
            yield rows_of(last, head, np.array([LAST]))
        if starts[0]:
            head = pa.nulls(1, heads.type)
        begun = np.maximum.accumulate(np.where(starts, at, -1))
        found = np.maximum.accumulate(np.where(heads.is_valid().to_numpy(zero_copy_only=False), at, -1))
        known = found >= begun  # a header of this batch, not of another split
        place = np.where(known & (found >= 0), found + 1, np.where(begun <= 0, 0, -1))
        all_heads = pa.concat_arrays([head, heads])
        filled = all_heads.take(pa.array(place, pa.int64(), mask=place < 0))
        yield rows_of(batch, filled, np.where(filled.is_valid().to_numpy(zero_copy_only=False), HEADED, AHEAD))
        ends = np.flatnonzero(starts[1:])  # of splits that end in this batch
        if len(ends):
            yield rows_of(batch.take(pa.array(ends)), filled.take(pa.array(ends)), np.full(len(ends), LAST))
        split, head, last = splits[-1], filled.slice(n - 1, 1), batch.slice(n - 1, 1)
    if last is not None:
        yield rows_of(last, head, np.array([LAST]))


def _numstat(line: Column) -> dict[str, Column]:
    """(entity, added, deleted, fault) of a line under a header; a blank one has no entity
    and no fault. Counts of ``-`` are 0."""
    text = F.rtrim(line, F.lit(SPACES))
    part = F.split(text, "\t", 3)
    get = lambda k: F.get(part, F.lit(k))
    number = lambda k: F.when(get(k) == "-", F.lit(0)).otherwise(F.regexp_extract(get(k), "^[+]?([0-9]+)$", 1).try_cast("long"))
    wrong = lambda k: F.when(number(k).isNull(), F.concat(F.lit("invalid numstat count `"), get(k), F.lit("`")))
    fault = (
        F.when(text == "", None)
        .when(F.size(part) == 1, F.lit("numstat line missing deleted count"))
        .when(F.size(part) == 2, F.lit("numstat line missing path"))
        .when(get(2).contains(" => "), F.concat(F.lit("rename/copy numstat path is unsupported (use --no-renames): "), get(2)))
        .otherwise(F.coalesce(wrong(0), wrong(1)))
    )
    return {"entity": F.when(text != "", get(2)), "added": number(0), "deleted": number(1), "fault": fault}


def parsed(spark: SparkSession, path: str, vcs: str) -> DataFrame:
    """(pos, kind, rev, author, date, entity, added, deleted, line, error) of the lines of
    a log, blank and good header lines left out.

    pos is where a line stands: file, split, and place in it. Lines are stripped of line
    ends, and numstat lines of white space at their end.
    """
    is_header, header = _format(vcs)
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.is_valid_utf8("value").alias("utf8"), F.rtrim("value", F.lit("\r\n")).alias("line"))
    heading = is_header(F.col("line"))
    head = F.struct(*(c.alias(k) for k, c in header(F.col("line")).items()))
    lines = lines.select(F.xxhash64("file", "start").alias("split"), F.struct("file", "start", "id").alias("pos"), "utf8", "line", heading.alias("heading"), F.when(heading, head).alias("head"))
    kinds = {c: t for c, t in lines.dtypes}
    carried = lines.mapInArrow(_carried, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", kind int")
    own = _numstat(F.col("line"))
    error = F.when(F.col("kind") == LAST, None).when(~F.col("utf8"), F.lit(NOT_UTF8)).when(F.col("heading"), F.col("head.bad")).otherwise(own["fault"])
    rows = carried.select("split", "pos", "kind", "heading", "head.rev", "head.author", "head.date", *(own[c].alias(c) for c in ("entity", "added", "deleted")), "line", error.alias("error"))
    said = F.when(F.col("kind") == AHEAD, F.col("line") != "").when(F.col("kind") == HEADED, ~F.col("heading") & F.col("entity").isNotNull()).otherwise(True)
    return rows.where(F.col("error").isNotNull() | said).select("split", "pos", "kind", "rev", "author", "date", "entity", "added", "deleted", F.when(F.col("kind") == AHEAD, F.col("line")).alias("line"), "error")


def _after_splits(rows: DataFrame) -> DataFrame:
    """The lines before the first header of their split, with the last header before it.

    The prefix over the splits is made of one row a split, which one task sorts.
    """
    order = Window.orderBy("pos.file", "pos.start")
    heads = rows.where(F.col("kind") == LAST).select("split", "pos", F.when(F.col("rev").isNotNull(), F.struct("rev", "author", "date")).alias("own"))
    before = heads.select("split", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("own"))
    ahead = rows.where(F.col("kind") == AHEAD).drop("rev", "author", "date").join(before, "split", "left")
    error = F.when(F.col("own").isNull() & ~F.coalesce(F.col("error") == NOT_UTF8, F.lit(False)), F.concat(F.lit("numstat line before header: "), "line")).otherwise(F.col("error"))
    return ahead.select("pos", "own.rev", "own.author", "own.date", "entity", "added", "deleted", error.alias("error")).where("error is not null or entity is not null")


CHANGE = ("pos", "rev", "author", "date", "entity", "added", "deleted")


def ingested(spark: SparkSession, path: str, vcs: str) -> tuple[DataFrame, int, list[Row]]:
    """The good changes of a log, how many they are, and the first bad line, if any, as
    (pos, error). One pass reads the log; what it writes is read from then on."""
    good = F.col("error").isNull()
    try:
        rows = parsed(spark, path, vcs)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise EngineError(f"cannot open log: {path}") from e
        raise
    # lines ahead of a header are judged once it is known
    sure = F.when(F.col("kind") == HEADED, F.col("error"))
    bad = F.min(F.when(sure.isNotNull(), F.struct("pos", "error")))
    table, seen = written(rows, "log", where=good | (F.col("kind") == AHEAD), bad=bad, changes=F.count_if(good & (F.col("kind") == HEADED)), ahead=F.count_if(F.col("kind") == AHEAD))
    changes, n, bads = table.where(F.col("kind") == HEADED).select(*CHANGE), seen["changes"], [seen["bad"]]
    if seen["ahead"]:
        late, more = written(_after_splits(table), "log-ahead", where=good, bad=F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error"))), changes=F.count_if(good))
        changes, n, bads = changes.unionByName(late.select(*CHANGE)), n + more["changes"], [*bads, more["bad"]]
    return changes, n, sorted((b for b in bads if b is not None), key=lambda b: tuple(b["pos"]))[:1]


def faults(spark: SparkSession, path: str, vcs: str) -> DataFrame:
    """(pos, error) of every bad line of a log."""
    table, _ = written(parsed(spark, path, vcs), "log-faults", where=F.col("error").isNotNull() | (F.col("kind") > HEADED))
    own = table.where((F.col("kind") == HEADED) & F.col("error").isNotNull()).select("pos", "error")
    return own.unionByName(_after_splits(table).where("error is not null").select("pos", "error"))


def log_lines(changes: DataFrame, vcs: str, delimited: Column | None = None) -> DataFrame:
    """(rev, date, author, k, line) of the log of some changes: the commits of (rev, date,
    author), each a header (k 0) with its lines. ``delimited``: in format ``git``, where
    the date stands between < and >."""
    if vcs not in ("git", "git2"):
        raise EngineError(f"unknown vcs `{vcs}`; expected `git` or `git2`")
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    if vcs == "git2":
        head = F.concat(F.lit("--"), F.concat_ws("--", "rev", "date", "author"))
    else:
        date = F.col("date") if delimited is None else F.when(delimited, F.concat(F.lit("<"), "date", F.lit(">"))).otherwise(F.col("date"))
        head = F.concat(F.lit("["), "rev", F.lit("] "), "author", F.lit(" "), date, F.lit(" change"))
    heads = changes.select("rev", "date", "author").distinct().select("*", F.lit(0).alias("k"), head.alias("line"))
    return heads.unionByName(changes.select("rev", "date", "author", F.lit(1).alias("k"), F.concat_ws("\t", count("added"), count("deleted"), "entity").alias("line")))


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Write the lines of commits in order, as so many files; no commit is gathered, and
    one may be cut between two files."""
    order = ["rev", "date", "author", "k", "line"]
    dealt = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select(F.col("line").alias("value")).write.text(path)


def write_log(changes: DataFrame, path: str, vcs: str, files: int | None = None, delimited: Column | None = None) -> None:
    """Write changes as a log that ``read_log`` reads. They are computed once: headers and
    lines, and the bounds of the files, are taken from a table of them."""
    with held(changes, "log-changes") as table:
        write_lines(log_lines(table, vcs, delimited), path, files)


def read_log(spark: SparkSession, path: str, vcs: str, max_rows: int | None = MAX_CHANGE_ROWS) -> DataFrame:
    """The changes of a log of one or more files, in order of their paths, after all its
    lines passed; ``max_rows`` None: no limit. The first bad line of the log is an error."""
    changes, n, bad = ingested(spark, path, vcs)
    if bad:
        raise EngineError(bad[0]["error"])
    if max_rows is not None and n > max_rows:
        raise EngineError(f"log exceeds {max_rows} change rows; narrow with --after or --include")
    return changes
