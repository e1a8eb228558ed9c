"""A filter of fixed size for the larger side of a join with few keys."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the filters that are sent to all tasks, whatever they filter for.
SLOTS = 1 << 17


def among(column: Column, ids: DataFrame) -> Column:
    """True for all values of a bigint column that ``ids`` (one column) has, and for few others.

    At most ``SLOTS`` numbers come to the driver; a constant of as many bits goes to the tasks. Where ``ids`` has very
    many values the filter lets more through, and the join behind it has more to do, but nothing else changes.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    words = [0] * (SLOTS // 64)
    for (n,) in ids.select(slot(F.col(ids.columns[0]))).distinct().collect():
        words[n // 64] |= 1 << (n % 64)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    bits = F.from_json(F.lit(json.dumps(signed)), "array<bigint>")
    return F.getbit(F.get(bits, (slot(column) / 64).cast("int")), (slot(column) % 64).cast("int")) == 1
