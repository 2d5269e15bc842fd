"""Places in chains by pointer doubling: no chain, however long, is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def places(links: DataFrame, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Of links (id, before: each at most once in its column) two tables: id, head, place of every id whose chain begins at a head, the
    id that nothing is before (it has no row; place counts from it); and id, low of ids in circles, low the circle's smallest ``name`` (by default id).

    A round makes each pointer reach twice as far: one equi-join of the links with themselves, written, so there are as many rounds as the
    longest chain's length has bits; circles show when that many are over."""
    rows = links.select("id", F.col("before").alias("up"), F.lit(1).cast("long").alias("place"), (F.col("id") if name is None else name).alias("low"), F.lit(True).alias("open"))
    rows = cut(rows, "chains")
    for _ in range(rows.count().bit_length() + 1):
        far = rows.select(F.col("id").alias("f_id"), F.col("up").alias("f_up"), F.col("place").alias("f_place"), F.col("low").alias("f_low"))
        met = rows.join(far, F.col("up") == F.col("f_id"), "left")
        rows = met.select("id", F.coalesce("f_up", "up").alias("up"), (F.col("place") + F.coalesce("f_place", F.lit(0))).alias("place"), F.least("low", "f_low").alias("low"), F.col("f_id").isNotNull().alias("open"))
        rows = cut(rows, "chains")
        if not rows.where("open").head(1):
            break
    return rows.where("not open").select("id", F.col("up").alias("head"), "place"), rows.where("open").select("id", "low")
