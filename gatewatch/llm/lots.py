"""Lots: what many documents refer to, resolved for all of them at once.

A task that reads documents numbers the values it meets (words, pairs of ids) within a lot and writes, beside
rows that hold these small numbers, the lot's own list of values. Facts about values of the whole corpus are
then joined to those lists, which are far shorter than the documents, and brought back to the lot's rows by
one co-grouping. A lot is closed at a bounded size, so its group fits in a task, whatever values are frequent.
"""

from __future__ import annotations

from itertools import count

from pyspark import TaskContext

#: Bits of a lot's number within its task; the task's number stands above them.
_TASK_SHIFT = 24


def lot_number(k: int) -> int:
    """Number of the k-th lot of this task, over the whole table."""
    return TaskContext.get().partitionId() << _TASK_SHIFT | k


class Numbered(dict):
    """Numbers keys as they come, from 0, or along with others that share ``numbers``."""

    def __init__(self, numbers: count | None = None):
        self.numbers = numbers if numbers is not None else count()

    def __missing__(self, key) -> int:
        self[key] = found = next(self.numbers)
        return found
