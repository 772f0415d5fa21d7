"""Lookups that are read again after a while."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import DataFrame

from ..tables import Scratch, written

#: Fixed value: seconds after which exit lists are read again.
EVERY_S = 12 * 3_600

T = TypeVar("T")
_log = logging.getLogger(__name__)


class Refreshed(Generic[T]):
    """What ``read`` gives, read again once it is ``every_s`` old; if that fails the last good version stays.

    ``read`` returns a table, which is written once, or anything else that it prepared. A failed read is tried
    again after another ``every_s``. Until the first good one, ``otherwise`` stands in, or the failure is raised.
    """

    def __init__(self, read: Callable[[], T], otherwise: T | None = None, every_s: float = EVERY_S, clock: Callable[[], float] = time.monotonic):
        self.read, self.held, self.every_s, self.clock = read, otherwise, every_s, clock
        self.due: float | None = None
        self._scopes: list[Scratch] = []

    def value(self) -> T:
        now = self.clock()
        if self.due is None or now >= self.due:
            self.due = now + self.every_s
            self._renew()
        return self.held

    def _renew(self) -> None:
        scope = Scratch(keep=True)
        try:
            with scope:
                fresh = self.read()
                self.held = written(fresh, "lookup") if isinstance(fresh, DataFrame) else fresh
        except Exception:
            if self.held is None:
                self.due = None
                raise
            _log.warning("a lookup could not be read again; the last one stays", exc_info=True)
            return
        self._scopes.append(scope)
        for old in self._scopes[:-2]:  # a batch that still runs may read the one before
            old.drop()
        self._scopes = self._scopes[-2:]
