"""The one error that users of the engine see."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class EngineError(Exception):
    """A run that can't go on; ``str()`` of it is the message for the user."""


@contextmanager
def translated() -> Iterator[None]:
    """Errors that a plan raises for the user become the engine's."""
    try:
        yield
    except PySparkException as e:
        if e.getCondition() == "USER_RAISED_EXCEPTION":
            raise EngineError(e.getMessageParameters()["errorMessage"]) from e
        raise
