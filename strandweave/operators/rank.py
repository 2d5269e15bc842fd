"""Row numbers in an order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def number_rows(df: DataFrame, order: list[Column], name: str = "rank", start: int = 0) -> DataFrame:
    """``name``: start + 1, start + 2 ... in that order. The table is range-sorted once and written; a row's number is its place in
    its partition plus the rows of the partitions before, of which there is one sum per partition."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sums = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.select(*df.columns, (place + F.col("_before") + start + 1).cast("long").alias(name))
