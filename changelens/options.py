"""Options of a run, and the limits that the command line checks."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass

from changelens.errors import EngineError

MAX_CHANGESET_SIZE_LIMIT = 200
MAX_CHANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Options:
    """What an analysis depends on besides the changes."""

    analysis: str = "risk"
    rows: int | None = None
    min_revs: int = 5
    min_shared_revs: int = 5
    min_coupling: int = 30
    max_coupling: int = 100
    max_changeset_size: int = 30
    age_time_now: str | None = None
    temporal_period: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    group_file: str | None = None
    grain: str = "file"
    repo: str | None = None
    resolver: str = "table"

    def __post_init__(self):
        if self.temporal_period not in (None, "day"):
            raise EngineError(f"invalid temporal period `{self.temporal_period}`; expected `day`")
        if self.grain not in ("file", "function"):
            raise EngineError(f"invalid grain `{self.grain}`; expected `file` or `function`")


def is_date(text: str) -> bool:
    """Whether a text is a day of the calendar: three integers parted by dashes."""
    m = re.fullmatch(r"([0-9]{1,18})-([0-9]{1,18})-([0-9]{1,18})", text)
    if not m:
        return False
    year, month, day = map(int, m.groups())
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= month <= 12 and 1 <= day <= (29 if month == 2 and leap else monthrange(2023, month)[1])
