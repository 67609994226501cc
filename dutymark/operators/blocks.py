"""Two tables meet in blocks of bounded size: every row of one sees every row of the other, in some task.

For work that no equality joins (bounds, containment, accumulated scores): keys are dealt by hash, never gathered by a common
word, so that what a task holds does not depend on how often anything occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the right table that are wanted as soon as it is large enough.
CELLS = 64


def tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(low, min(low + size, n)) for low in range(0, n, size))


def meet(left: DataFrame, left_key: str, blocks: int, right: DataFrame, right_key: str, most: int, least: int, find, schema: str) -> DataFrame:
    """find(left rows, right rows) as Arrow tables, once for each of `blocks` blocks of left and each cell of right.

    A cell has `most` rows about; there are up to CELLS of them if each has `least`. Both keys are distinct in their table.
    """
    n = right.count()
    cells = max(1, -(-n // most), min(CELLS, n // least))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    one = left.withColumn("block", F.pmod(F.xxhash64(left_key), F.lit(blocks))).withColumn("cell", every(cells))
    two = right.withColumn("cell", F.pmod(F.xxhash64(right_key), F.lit(cells))).withColumn("block", every(blocks))
    return one.groupBy("block", "cell").cogroup(two.groupBy("block", "cell")).applyInArrow(find, schema)
