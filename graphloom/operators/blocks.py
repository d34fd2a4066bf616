"""What somebody asked, in blocks that may be broadcast."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms or queries in a block: some MB with their vectors.
ASKED = 2_000


def in_blocks(asked: DataFrame, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What run gives for all of asked, which it gets in blocks that may be broadcast."""
    blocks = max(1, math.ceil(asked.count() / ASKED))
    parts = [asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k) for k in range(blocks)]
    return reduce(DataFrame.unionByName, [run(F.broadcast(part)) for part in parts])
