"""Connected components of a table of links, by least labels and pointer jumping; labels never come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import drop, materialise


def components(links: DataFrame, folder: str) -> DataFrame:
    """links (a, b): long. A row per node that has a link: node, label (the least node of its component).

    Only the last two rounds' tables stay: a round reads its predecessor alone, and is written when it ends.
    """
    rounds: list[DataFrame] = []
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), folder)
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), folder)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("below"))
        after = materialise(low.join(jump, "low").select("node", F.least("low", "below").alias("label"), "was"), folder)
        if after.filter("label <> was").isEmpty():
            return after.select("node", "label")
        rounds.append(after)
        if len(rounds) > 2:
            drop(rounds.pop(0))
        labels = after.select("node", "label")
