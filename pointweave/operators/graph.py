"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.plans.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every node of the links (a, b) the least node of its component.

    Each round every node takes the least label among its own, its neighbours' and its
    label's label. Minima are summed map-side, so a hub's links don't meet in one task;
    the joins that spread labels are plain ones, whose hot keys Spark can split. Each
    round is written to the shared folder. An empty table gives no rows.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stored(moved.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
