"""Result tables as aligned text or JSON, line by line.

Rows are fetched one partition after the other and written as they come; the widths of
the columns of a text are an aggregate.  So no table, however long, is held here.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.errors import EngineError, translated
from changelens.plans.runner import cells


def shown(df: DataFrame) -> tuple[list[str], DataFrame]:
    """Headers, and the table as texts; null is empty."""
    table = cells(df)
    return [c.replace("_", "-") for c in table.columns], table.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in table.columns))


def widths(table: DataFrame) -> list[int]:
    """How many characters the longest text of each column has."""
    return [n or 0 for n in table.agg(*(F.max(F.length(f"`{c}`")).alias(str(i)) for i, c in enumerate(table.columns))).first()]


def text_lines(headers: list[str], rows: Iterable[Iterable[str]], wide: list[int]) -> Iterator[str]:
    """The first column to the left, all others to the right, and the number of rows."""
    wide, n = [max(len(h), w) for h, w in zip(headers, wide, strict=True)], -1
    for n, line in enumerate((x for part in ([[h.upper() for h in headers]], rows) for x in part)):
        yield "  " + "  ".join(v.rjust(w) if i else v.ljust(w) for i, (v, w) in enumerate(zip(line, wide, strict=True))) + "\n"
    yield f"\n{n} rows.\n"


def escaped(text: str) -> str:
    """A JSON string; control characters, also U+007F to U+009F, as escapes."""
    known = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(known.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in text)


def json_lines(headers: list[str], rows: Iterable[Iterable[str]]) -> Iterator[str]:
    """An array of one object a line; all values are strings."""
    yield "["
    end = "\n"
    for r in rows:
        yield end + "  {" + ", ".join(f'"{escaped(h)}": "{escaped(v)}"' for h, v in zip(headers, r, strict=True)) + "}"
        end = ",\n"
    yield "\n]\n"


def rendered(df: DataFrame, form: str = "text") -> Iterator[str]:
    """The parts of the text or JSON of a table, one after the other.

    The table is computed once, and is there before the first part is given: a run that
    stops with an error has written nothing.
    """
    if form not in ("text", "json"):
        raise EngineError(f"invalid format `{form}`; expected `text` or `json`")
    headers, table = shown(df)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    with translated():
        wide = widths(table)

    def parts() -> Iterator[str]:
        rows = table.toLocalIterator()
        yield from text_lines(headers, rows, wide) if form == "text" else json_lines(headers, rows)
        table.unpersist()

    return parts()
