"""Connected components of a link table by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnforge.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node that it reaches.

    Each round a node takes the smallest label among itself and its neighbours,
    then the label of that label.  Rounds are written tables; only one count a
    round comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "low").alias("next"), F.col("label").alias("was"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        step = stored(lower.join(up, "next").select("node", F.least("next", "jump").alias("label"), "was"), "labels")
        changed = step.where("label != was").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
