"""Sets of hashes as bitmaps of fixed size: members always pass, and a few others do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAP_BITS = 24


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the ids' low `MAP_BITS` bits; the driver gets at most `2 ** MAP_BITS / 64` numbers."""
    cell = F.col("id").bitwiseAND(F.lit((1 << (MAP_BITS - 6)) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("id", MAP_BITS - 6).bitwiseAND(F.lit(63)).cast("int"))
    got = ids.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[got["cell"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    hashes = hashes.view(np.uint64)
    cell = (hashes & np.uint64((1 << (MAP_BITS - 6)) - 1)).astype(np.int64)
    return ((bitmap[cell] >> ((hashes >> np.uint64(MAP_BITS - 6)) & np.uint64(63))) & np.uint64(1)) == 1
