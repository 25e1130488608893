"""Places in a total order over the whole cluster: no task sees more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.plans.storage import stored


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the row's place from 0 in the order, which should leave no ties: rows are sorted
    in ranges, numbered within each, and moved by the sizes of the ranges before (one row a
    range at the driver)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__range").cast("long"), 33)), "numbered")
    before, upto = {}, 0
    for r in sorted(rows.groupBy("__range").count().collect()):
        before[r["__range"]] = upto
        upto += r["count"]
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("__range")] if before else F.lit(0)
    return rows.withColumn(name, (start + F.col("__at")).cast("long")).drop("__range", "__at")


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of the order, where ``n`` may grow with the table."""
    return numbered(df, order, "__place").where(F.col("__place") < n).drop("__place")
