"""Numbers in a total order without one partition for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """The rows with a long column ``name``: 1, 2, 3 ... in the order given; rows that are equal in it are numbered in any order.

    Rows are dealt by ranges of the order and sorted there; a partition's numbers begin after the rows of the partitions before it, and
    only these counts, one a partition, come to the driver. Rows are stored once, so a lost executor changes no number.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the upper 31 bits are the partition, the lower 33 the place in it
    placed = cut(dealt.withColumn(name, F.monotonically_increasing_id()))
    part, place = F.shiftright(name, 33).cast("int"), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = list(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=1), strict=False))
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "part_ int, start_ long"))  # a row a partition
    return placed.join(before, part == F.col("part_")).withColumn(name, F.col("start_") + place).drop("part_", "start_")
