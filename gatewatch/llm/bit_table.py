"""A table of bits, of bounded size, that tells what is surely not in a set of 64-bit marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each mark, up to the bound (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28


def bit_table(marks: DataFrame, n: int) -> np.ndarray:
    """A table with the bits of all ``mark`` set: 16 bits for each of the ``n`` marks, but no more than the bound."""
    bits = min(MOST_BITS, max(64, 1 << (max(1, n) * BITS_EACH - 1).bit_length()))
    place = F.col("mark").bitwiseAND(bits - 1)
    cells = marks.groupBy(F.shiftright(place, 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def held_in(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    place = marks & (len(table) * 64 - 1)
    return (table[place >> 6] >> (place & 63) & 1).astype(bool)
